"""Line dedup: a suffix array over line ids by prefix doubling, DataFrame operations only.

The lines that aren't blank, of all documents, are sequences of line ids. A suffix starts at a line that occurs twice or
more. Its path begins with that line's rank; in a step that doubles the depth, suffixes that share a path so far are
sorted by the path that stands one depth on, and the rank of the pair is added to the path. Steps go on until no two
suffixes share a path but such that come to the same end, a line that occurs once or the end of the text; only suffixes that
still share one are ranked again, and documents without such a suffix leave. The order of the paths is the suffix array.
Suffixes with at least `min_lines` lines in common are an interval of it, whose value is the longest common prefix
of its first and its last suffix: their paths tell it, as an equal beginning of k ranks is one of 2**(k - 1) lines, and what
follows is compared in the same way. Each interval keeps its first suffix by document and place; the interval's common
prefix at the others is a later copy. Copies joined where they touch or overlap are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import as_rows, digest, written

MIN_LINES = 3
_DOC = ["doc_id", "h"]


def _filled(text: str):
    """The lines of a text that aren't blank."""
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")


def _sequences(docs: DataFrame) -> DataFrame:
    """doc_id, h (digest of the text), i, line (digest of the trimmed line)."""
    rows = docs.where("text IS NOT NULL").select("doc_id", digest(F.col("text")).alias("h"), F.posexplode(_filled("text")).alias("i", "line"))
    return rows.select("doc_id", "h", "i", digest(F.trim("line")).alias("line"))


def _numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with ranks in the order of the keys, which have gaps. A written table, so that a key that a third of all rows have
    is joined by splitting it, not in one task."""
    return written(rows.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def _suffixes(docs: DataFrame) -> DataFrame:
    """doc_id, h, i, path, term (lines from here to the first that occurs once, or to the end) of each line that occurs twice or more."""
    lines = _sequences(docs)
    many = _numbered(lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("line"), "line")
    by_doc = Window.partitionBy(*_DOC)
    rows = lines.join(many, "line").select(*_DOC, "i", "rank").repartition(*_DOC).dropDuplicates([*_DOC, "i"])
    rows = rows.withColumn("island", F.col("i") - F.row_number().over(by_doc.orderBy("i")))
    term = (F.max("i").over(Window.partitionBy(*_DOC, "island")) - F.col("i") + 1).alias("term")
    table = rows.select(*_DOC, "i", F.array("rank").alias("path"), term, F.lit(True).alias("shared"))
    own, done, step = [*_DOC, "i", "path", "term"], [], 1
    while True:
        ahead = F.coalesce(F.first("path").over(by_doc.orderBy("i").rangeBetween(step, step)), F.array().cast("array<bigint>"))
        seen = written(table.withColumn("next", ahead).withColumn("live", F.max("shared").over(by_doc)), f"depth{step}")
        done.append(seen.where("NOT live").select(*own))
        shared = seen.where("shared")
        if shared.isEmpty():
            break
        ranks = _numbered(shared.groupBy("path", "next").agg(F.count(F.lit(1)).alias("n")), "path", "next")
        step *= 2
        again = shared.join(ranks, ["path", "next"]).select(*own[:3], F.concat("path", F.array("rank")).alias("path"), "term", ((F.col("n") > 1) & (F.col("term") >= step)).alias("shared"))
        table = again.union(seen.where("live AND NOT shared").select(*again.columns))
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out


def _equal_ranks() -> Column:
    """How many ranks two paths begin with in common."""
    differ = F.array_position(F.zip_with("path", "path2", lambda a, b: F.coalesce(a != b, F.lit(True))), True)
    return F.when(differ == 0, F.size("path")).otherwise(differ - 1).cast("int")


def _common(pairs: DataFrame, suffixes: DataFrame) -> DataFrame:
    """id, value: the longest common prefix of two suffixes of each row of pairs (id, and of both doc_id, h, i, path, term, the
    second with a 2 at the end)."""
    known, left = [], pairs.withColumn("value", F.lit(0))
    while True:
        equal = _equal_ranks()
        more = F.when(F.col("path") == F.col("path2"), F.least("term", "term2")).when(equal == 0, 0).otherwise(F.pow(F.lit(2), equal - 1).cast("int"))
        over = (F.col("path") == F.col("path2")) | (equal == 0) | (F.least("term", "term2") <= more)
        left = written(left.select("id", *_DOC, "i", "doc_id2", "h2", "i2", (F.col("value") + more).alias("value"), over.alias("over")), "compared")
        known.append(left.where("over").select("id", "value"))
        left = left.where("NOT over")
        if left.isEmpty():
            break
        for n in ("", "2"):  # what follows the lines that are known to be equal
            to = suffixes.select(*[F.col(c).alias(f"to_{c}") for c in (*_DOC, "i")], F.col("path").alias(f"path{n}"), F.col("term").alias(f"term{n}"))
            same = F.col(f"doc_id{n}").eqNullSafe(F.col("to_doc_id")) & (F.col(f"h{n}") == F.col("to_h")) & (F.col(f"i{n}") + F.col("value") == F.col("to_i"))
            left = left.join(to, same).drop("to_doc_id", "to_h", "to_i")
    out = known[0]
    for part in known[1:]:
        out = out.union(part)
    return out


def intervals(docs: DataFrame, min_lines: int = MIN_LINES) -> tuple[DataFrame, DataFrame]:
    """(members, intervals): members have doc_id, h, i and the interval's id; intervals have id, value (lines that all
    members have in common, at least min_lines) and first (struct of doc_id, h, i)."""
    suffixes = written(_suffixes(docs), "suffixes")
    # an interval's name: the ranks of its first 2**k lines, and of as many that end with line min_lines
    k = min_lines.bit_length() - 1
    depth = min_lines - 2**k
    tail = F.slice(F.first("path").over(Window.partitionBy(*_DOC).orderBy("i").rangeBetween(depth, depth)), 1, k + 1)
    named = suffixes.withColumn("tail", tail if depth else F.array().cast("array<bigint>")).withColumn("head", F.slice("path", 1, k + 1))
    named = written(named.where((F.col("term") >= min_lines) & (F.size("head") > k) & ((F.size("tail") > k) if depth else F.lit(True))), "named")
    ends = F.struct("path", *_DOC, "i", "term")
    groups = named.groupBy("head", "tail").agg(F.count(F.lit(1)).alias("n"), F.min(ends).alias("a"), F.max(ends).alias("b"), F.min(F.struct(*_DOC, "i")).alias("first")).where("n > 1")
    groups = written(groups.withColumn("id", F.monotonically_increasing_id()), "groups")
    both = groups.select("id", "a.*", *[F.col(f"b.{c}").alias(f"{c}2") for c in (*_DOC, "i", "path", "term")])
    # where both suffixes of an interval move on by a line to those of another, only the last of such a row is compared
    along = Window.partitionBy(*_DOC, "doc_id2", "h2", "step")
    rows = both.withColumn("step", F.col("i") - F.col("i2"))
    rows = rows.withColumn("island", F.col("i") - F.row_number().over(along.orderBy("i")))
    last = F.max(F.struct("i", "id")).over(Window.partitionBy(*_DOC, "doc_id2", "h2", "step", "island"))
    rows = written(rows.withColumn("last", last), "rows")
    value = _common(rows.where(F.col("id") == F.col("last.id")).select(*both.columns), suffixes).withColumnRenamed("id", "last_id")
    values = rows.join(value, F.col("last.id") == F.col("last_id")).select("id", (F.col("value") + F.col("last.i") - F.col("i")).alias("value"))
    return named.select(*_DOC, "i", "head", "tail").join(groups.select("head", "tail", "id"), ["head", "tail"]).select(*_DOC, "i", "id"), written(groups.select("id", "first").join(values, "id"), "intervals")


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, h, first and last (numbers of lines that aren't blank, from 0) of each maximal run of later copies.

    A copy is later than another by (doc_id, digest of the text, line). Rows with the same doc_id and text are one
    document. Null and empty texts have no lines; an empty table has no runs. Copies may overlap: of a line ten times over,
    the first stays if min_lines is 1."""
    if min_lines < 1:
        raise ValueError("min_lines is 1 or more")
    members, found = intervals(docs, min_lines)
    later = members.join(found, "id").where(~F.struct(*_DOC, "i").eqNullSafe(F.col("first"))).select(*_DOC, "i", (F.col("i") + F.col("value") - 1).alias("last"))
    by_doc = Window.partitionBy(*_DOC).orderBy("i")
    reached = F.max("last").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    starts = later.withColumn("new", F.when(F.col("i") <= reached + 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(by_doc))
    return starts.groupBy(*_DOC, "run").agg(F.min("i").alias("first"), F.max("last").alias("last")).drop("run")


def without_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """All rows of docs with text less its later copies, n_lines (of those that aren't blank), n_removed, and runs (first,
    last); columns of docs with these three names in any case are replaced. A text with a copy loses its blank lines too; other texts stay as they are to the letter, null ones null
    with 0 lines."""
    runs = repeated_runs(docs, min_lines).groupBy(*_DOC).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))
    runs = written(runs, "runs")
    out = as_rows(docs).join(runs.hint("merge"), F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (digest(F.col("row.text")) == F.col("h")), "left")
    lines = _filled("row.text")
    kept = F.filter(lines, lambda x, i: ~F.exists("runs", lambda r: (i >= r["first"]) & (i <= r["last"])))
    own = [c for c in docs.columns if c.lower() not in ("text", "n_lines", "n_removed", "runs")]
    none = F.array().cast("array<struct<first:int,last:int>>")
    return out.select(
        *[F.col(f"row.`{c}`") for c in own],
        F.when(F.col("runs").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.aggregate("runs", F.lit(0).cast("bigint"), lambda a, r: a + r["last"] - r["first"] + 1), F.lit(0).cast("bigint")).alias("n_removed"),
        F.coalesce("runs", none).alias("runs"),
    )


def op4(docs: DataFrame) -> DataFrame:
    return without_runs(docs.select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_removed")


#: The same rows, with windows of lines in place of ranks.
OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, h, unnest(ls) AS line, unnest(range(len(ls))) AS i
  FROM (SELECT doc_id, md5(text) AS h, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS ls FROM documents WHERE text IS NOT NULL)),
once AS (SELECT DISTINCT doc_id, h, i, md5(trim(line, ' ')) AS line FROM lines),
windows AS (
  SELECT doc_id, h, i, line || lead(line, 1) OVER w || lead(line, 2) OVER w AS three
  FROM once WINDOW w AS (PARTITION BY doc_id, h ORDER BY i)),
later AS (
  SELECT doc_id, h, i FROM (SELECT doc_id, h, i, row_number() OVER (PARTITION BY three ORDER BY doc_id, h, i) AS n FROM windows WHERE three IS NOT NULL) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, h, i + k AS i FROM later, (SELECT unnest([0, 1, 2]) AS k)),
changed AS (
  SELECT l.doc_id, l.h, count(g.i) AS n_removed, coalesce(string_agg(CASE WHEN g.i IS NULL THEN l.line END, chr(10) ORDER BY l.i), '') AS text
  FROM (SELECT DISTINCT doc_id, h, line, i FROM lines) l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.h = g.h AND l.i = g.i
  GROUP BY l.doc_id, l.h HAVING count(g.i) > 0)
SELECT d.doc_id, CASE WHEN c.doc_id IS NULL THEN d.text ELSE c.text END AS text,
  CAST(coalesce(len(list_filter(string_split(d.text, chr(10)), lambda x: trim(x, ' ') <> '')), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN changed c ON d.doc_id = c.doc_id AND md5(d.text) = c.h
"""
