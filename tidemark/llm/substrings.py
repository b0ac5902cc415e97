"""Substring dedup by hashing lines, cut further into sentences.

A line ends at a line feed. Whole lines alone would miss passages pasted into the middle of a line, so a line's units
are its sentences: one ends at . ! or ? before a blank, but sentences are joined until they have `UNIT_WORDS` words,
since shorter ones repeat by chance. Units are normalised (case folded, white space collapsed) and their digests grouped
over all documents. The earliest occurrence, by doc_id, text and place, stays. A run of neighbouring units that all
occur earlier is removed if it has `min_words` words or more.

A line that occurs earlier is a run of units that do, so of whole lines with `min_words` words or more every later
copy goes. Later copies of shorter lines, such as headings or one-word answers, stay: they repeat in texts that have
nothing else in common. A passage without a whole unit is not found.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.columns import of_texts
from tidemark.llm.common import as_rows, small_batches, written

MIN_WORDS, UNIT_WORDS = 4, 4
_BORDER = re.compile(r"(?<=[.!?])[ \t]|(\n)")


def units_of(text: str) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of each unit with a word; offsets count characters of the text as it is."""
    out, words, begin, at = [], [], 0, 0
    parts = [*_BORDER.split(text), "\n"]
    for piece, line_feed in zip(parts[::2], parts[1::2], strict=True):
        if not words:
            begin = at
        words += piece.casefold().split()
        at += len(piece)
        if words and (line_feed or len(words) >= UNIT_WORDS):
            out.append((begin, at, len(words), hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=16).digest()))
            words = []
        at += 1
    return out


def _units(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), u (number of the unit), start, stop, words, digest."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, n = [], 0
            for text in batch:
                out.append([*zip(*units_of(text), strict=True)] or [(), (), (), ()])
                n += len(out[-1][0])
                if n > 20_000:
                    yield pd.DataFrame(out, columns=_COLUMNS)
                    out, n = [], 0
            yield pd.DataFrame(out, columns=_COLUMNS)

    rows = docs.where("text IS NOT NULL AND text <> ''").select("doc_id", F.xxhash64("text").alias("h"), "text")
    cut = of_texts(run, "start array<int>, stop array<int>, words array<int>, digest array<binary>")
    parts = F.arrays_zip(*[F.col(f"cut.{c}").alias(c) for c in _COLUMNS])
    return rows.select("doc_id", "h", cut("text").alias("cut")).select("doc_id", "h", F.posexplode(parts).alias("u", "unit")).select("doc_id", "h", "u", "unit.*")


_COLUMNS = ["start", "stop", "words", "digest"]


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, h (hash of the text), start, stop, words, units and first_doc_id of each span to remove.

    start and stop are character offsets into the text as given; first_doc_id has the earliest occurrence of the span's
    first unit. Null and empty texts have no spans; long ones are read whole. Rows with the same doc_id and text are one
    document: its spans come out once. Texts that share a doc_id are ordered by their hash, so there are no ties. Null ids
    sort first. Other columns play no part. An empty table gives no rows."""
    place = F.struct("doc_id", "h", "u")
    with small_batches(docs.sparkSession):
        units = written(_units(docs), "units")
    many = units.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    many = written(many.where("n > 1").select("digest", "first"), "many")
    again = units.join(many, "digest").where(~place.eqNullSafe(F.col("first")))
    again = again.select("doc_id", "h", "u", "start", "stop", "words", F.col("first.doc_id").alias("first_doc_id")).dropDuplicates(["doc_id", "h", "u"])
    by_doc = Window.partitionBy("doc_id", "h")
    runs = again.withColumn("run", F.col("u") - F.row_number().over(by_doc.orderBy("u")))
    spans = runs.groupBy("doc_id", "h", "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("units"), F.min_by("first_doc_id", "u").alias("first_doc_id")
    )
    return spans.where(F.col("words") >= min_words).drop("run")


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the spans cut out of text and n_chars set anew; texts without a span stay as they are to the letter.
    A separator that a cut leaves at either side is dropped with it."""

    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(text, spans, strict=True):
            if t is not None and own is not None and len(own):
                kept, at = [], 0
                for s in sorted(own, key=lambda x: x["start"]):
                    kept.append(t[at : s["start"]])
                    at = s["stop"] + 1
                t = "".join([*kept, t[at:]]).strip()
            out.append(t)
        return pd.Series(out)

    cut_udf = F.pandas_udf(cut, "string")
    # one row per changed document: its spans, at most one for every `min_words` of its words
    per_doc = written(spans.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    out = as_rows(docs).join(per_doc.hint("merge"), F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("row.text") == F.col("h")), "left")
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(cut_udf("row.text", "spans"))
    return out.withColumn("text", text).select(*[new_text(c, F.col("text")) for c in docs.columns])


def new_text(name: str, text: Column) -> Column:
    """Column `name` of a documents row whose text has become `text`."""
    return {"text": text, "n_chars": F.length(text).cast("bigint")}.get(name, F.col(f"row.`{name}`")).alias(name)


def op9(docs: DataFrame) -> DataFrame:
    """Every removed span with its original offsets and the document that keeps its first copy; cases as in repeated_spans."""
    return repeated_spans(docs).drop("h")
