"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of word shingles becomes a signature of 60 minima, b = 16 bits each, in 15 chunks of 4. If two
signatures differ in at most 29 places, some chunk differs in at most one (pigeonhole: 15 chunks with 2 errors each
would be 30). The allowed error is enumerated by leaving out each of a chunk's places in turn, so two such signatures
share at least one of 60 exact keys: all pairs within distance 29 meet in a bucket, whatever the bucket's size. At a
similarity of 0.8 a signature differs in 12 places on average, and in more than 29 with probability 2.1e-7, at which
a link is missed unless others join its two ends; every link is confirmed on the full sets.

Equal sets are one class from the start. No pairs of a bucket are written out. A bucket is dealt into blocks, each of
which also gets the bucket's leader, its class of least hash: a class goes to one block of a bucket, and a block passes
on a spanning forest around the leader, with fewer edges than rows. So a family of n near copies makes some n edges,
however many blocks it has. Only buckets of several blocks whose classes aren't in one component by then are compared
across blocks, and there only the classes outside the bucket's largest component, each with all. Components of all
edges are families: two classes within the distance that share a key are always in one. Inside a family every two
classes that aren't linked yet are compared on their full sets, dealt in the same way, and again only links between
different components go on. In families of more than one block some links are found beforehand, by trying all against
one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.columns import of_texts
from tidemark.llm.common import as_rows, small_batches, tidy, written
from tidemark.llm.components import components

CHUNKS, WIDTH, DISTANCE = 15, 4, 29
PLACES = CHUNKS * WIDTH
#: Tries of all classes of a large family against one of them; they change the cost, not the result.
ROUNDS = 3
#: Rows of a bucket in one block, and when blocks are compared with each other; shingles of a family's sets in one block;
#: pairs tried in one block.
BLOCK, ACROSS, SHINGLES, PAIRS = 2000, 16_000, 500_000, 4000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SPREAD = np.random.default_rng(36).integers(0, 2**63, (2, PLACES), dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    return h ^ (h >> np.uint64(29))


class Words(dict):
    """word -> 64-bit hash, a bounded number remembered."""

    def __missing__(self, word: bytes) -> int:
        out = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) >= 200_000:
            self.clear()
        self[word] = out
        return out


def shingle_sets(texts: list[bytes], k: int, words: Words) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Letters A-Z are lower-cased and words parted at ASCII white space, which is what bytes do; fewer than k words are one shingle, none an empty set."""
    out: list[np.ndarray] = []
    for text in texts:
        own = text.lower().split()
        if not own:
            out.append(np.zeros(0, np.uint64))
            continue
        h = np.fromiter(map(words.__getitem__, own), np.uint64, len(own))
        n = max(1, len(own) - k + 1)
        s = np.full(n, len(own) if len(own) < k else k, np.uint64)
        for i in range(min(k, len(own))):
            s = _mixed(s * _M1 + h[i : i + n])
        out.append(np.unique(s))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(n, 60) of 16-bit minima of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *[len(s) for s in sets]])[:-1]
    out = np.empty((len(sets), PLACES), np.uint16)
    for j in range(PLACES):
        v = ((flat * (_SPREAD[0, j] | np.uint64(1)) + _SPREAD[1, j]) >> np.uint64(32)).astype(np.uint32)
        out[:, j] = np.minimum.reduceat(v, starts) & 0xFFFF
    return out


def keys(sig: np.ndarray) -> np.ndarray:
    """(n, 60) bucket keys: for each chunk and each place left out of it, the other three values and which they are."""
    out = np.empty((len(sig), PLACES), np.int64)
    wide = sig.astype(np.int64).reshape(len(sig), CHUNKS, WIDTH)
    for c in range(CHUNKS):
        for o in range(WIDTH):
            a, b, d = [wide[:, c, i] for i in range(WIDTH) if i != o]
            out[:, c * WIDTH + o] = ((c * WIDTH + o) << 48) | (a << 32) | (b << 16) | d
    return out


def _slices(items: list[bytes], most: int = 1_000_000) -> Iterator[slice]:
    """Runs of texts of bounded total length; a longer one stands alone, whole."""
    at = n = 0
    for i, x in enumerate(items):
        if i > at and n + len(x) > most:
            yield slice(at, i)
            at, n = i, 0
        n += len(x)
    if at < len(items):
        yield slice(at, len(items))


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, cls (digest of the set; null if it is empty) and sig of each row."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = Words()
        for batch in batches:
            texts = [t if t is not None else b"" for t in batch]
            for part in _slices(texts):
                sets = shingle_sets(texts[part], k, words)
                some = [i for i, s in enumerate(sets) if len(s)]
                sigs = signatures([sets[i] for i in some]) if some else None
                cls, sig = [None] * len(sets), [None] * len(sets)
                for at, i in enumerate(some):
                    cls[i], sig[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), sigs[at].tobytes()
                yield pd.DataFrame({"n_shingles": [len(s) for s in sets], "cls": cls, "sig": sig})

    sketched = of_texts(run, "n_shingles bigint, cls binary, sig binary")
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), sketched(F.col("text").cast("binary")).alias("sketch"))
    return rows.select("doc_id", "h", "sketch.*")


def _keyed(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                sig = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(-1, PLACES)
                yield pd.DataFrame({"cls": pdf["cls"], "keys": list(keys(sig))})

    return classes.select("cls", "sig").mapInPandas(tidy(run), "cls bigint, keys array<bigint>").select("cls", F.explode("keys").alias("key"))


def _forest(n: int, neighbours: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of n nodes, around the first of them as far as that goes, so that buckets with the same first classes give the same edges; neighbours(i, left) are those of the nodes `left` that i is tied to."""
    left, edges = np.arange(n), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop(0)
            tied = neighbours(i, left)
            edges += [(i, j) for j in left[tied]]
            queue += left[tied].tolist()
            left = left[~tied]
    return edges


def _spanning(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Which of the edges make a spanning forest of all of them."""
    nodes, names = pd.factorize(pd.concat([a, b], ignore_index=True))
    up, keep = list(range(len(names))), np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(nodes[: len(a)].tolist(), nodes[len(a) :].tolist(), strict=True)):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[max(x, y)], keep[i] = min(x, y), True
    return keep


def _near(sig: np.ndarray, n: np.ndarray, i, j, percent: int) -> np.ndarray:
    """Whether rows i and j are within the distance and their sizes allow the similarity."""
    return ((sig[j] != sig[i]).sum(axis=1) <= DISTANCE) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))


def _within(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): forests of the pairs within the distance in each block of members (key, cls, n, sig, nb, low), where low is the
    least hash of a cls of the key."""
    r = F.xxhash64("cls")
    block = F.when(r == F.col("low"), F.sequence(F.lit(0), F.col("nb") - 1)).otherwise(F.array(F.pmod(r, "nb").cast("int")))
    dealt = members.select("key", "cls", r.alias("r"), "n", "sig", F.explode(block).alias("b")).repartition("key", "b").sortWithinPartitions("key", "b", "r", "cls")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole(batches, ["key", "b"]):
            sig, n, cls = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(-1, PLACES), pdf["n"].to_numpy(), pdf["cls"].to_numpy()
            starts = _starts(pdf, ["key", "b"])
            sizes = np.diff([*starts, len(pdf)])
            two = starts[sizes == 2]
            two = two[_near(sig, n, two, two + 1, percent)]  # all buckets of two at once
            left, right = [two], [two + 1]
            for at, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
                if edges := _forest(size, lambda i, rest, at=at: _near(sig, n, np.full(1, at + i), at + rest, percent)):  # noqa: B023
                    edges = at + np.array(edges)
                    left.append(edges[:, 0])
                    right.append(edges[:, 1])
            edges = pd.DataFrame({"a": cls[np.concatenate(left)], "b": cls[np.concatenate(right)]}).drop_duplicates()
            yield edges[_spanning(edges["a"], edges["b"])]

    return dealt.mapInPandas(tidy(run), "a bigint, b bigint")


def _dealt(rows: DataFrame, key: str, weight: Column, most: int) -> DataFrame:
    """rows (key, cls, comp, ...) of the keys with several comps, dealt so that each row outside its key's heaviest comp,
    `top`, meets every row of the key in some group (key, i, j); sorted by them. No group outweighs `most` by much on
    either side. A row that is there to be asked about has asked = 1; in a key of one group the rows outside top are
    asked about and none stands twice."""
    comps = rows.groupBy(key, "comp").agg(F.sum(weight).alias("w"))
    parts = comps.groupBy(key).agg(F.max(F.struct("w", "comp")).alias("top"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    blocks = lambda w: F.greatest(F.ceil(w / most), F.lit(1)).cast("int")
    parts = written(parts.select(key, F.col("top.comp").alias("top"), blocks(F.col("w")).alias("na"), blocks(F.col("w") - F.col("top.w")).alias("no")), "parts")
    at = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    held = F.transform(F.sequence(F.lit(0), F.col("no") - 1), lambda i: F.struct(i.alias("i"), at("na").alias("j"), F.lit(0).alias("asked")))
    asks = F.transform(F.sequence(F.lit(0), F.col("na") - 1), lambda j: F.struct(at("no").alias("i"), j.alias("j"), F.lit(1).alias("asked")))
    twice = (F.col("comp") != F.col("top")) & ((F.col("na") > 1) | (F.col("no") > 1))
    spots = F.when(twice, F.concat(held, asks)).otherwise(held)
    out = rows.join(parts, key).select(*rows.columns, "top", F.explode(spots).alias("at")).select(*rows.columns, "top", "at.*")
    return out.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "asked", "cls")


def _xy(rows: DataFrame) -> str:
    """The schema of pairs of classes of rows."""
    kind = rows.schema["cls"].dataType.simpleString()
    return f"x {kind}, y {kind}"


def _tied(group: pd.DataFrame, ask: Callable[[int, int], np.ndarray]) -> list[tuple]:
    """One tie (x, y) for each two comps of a group of _dealt that come together; ask(i, n) says which of the first n
    rows, those that aren't there to be asked about, row i is tied to."""
    cls, comps, n = group["cls"].to_numpy(), pd.factorize(group["comp"])[0], int((group["asked"] == 0).sum())
    asked = np.arange(n, len(group)) if n < len(group) else np.flatnonzero((group["comp"] != group["top"]).to_numpy())
    found = []
    for i in asked:
        if (comps == comps[i]).all():
            break
        for j in np.flatnonzero(ask(i, n) & (comps[:n] != comps[i])):
            if comps[j] != comps[i]:  # one tie for each component that it reaches
                found.append((cls[i], cls[j]))
                comps[comps == comps[j]] = comps[i]
    return found


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """(x, y): enough pairs within the distance to join all comps that a key of rows (key, cls, comp, n, sig) joins."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, ["key", "i", "j"]):
            sig, n = np.frombuffer(b"".join(group["sig"]), np.uint16).reshape(-1, PLACES), group["n"].to_numpy()
            yield pd.DataFrame(_tied(group, lambda i, m: _near(sig, n, np.full(1, i), np.arange(m), percent)), columns=["x", "y"])  # noqa: B023

    return _dealt(rows, "key", F.lit(1), ACROSS).mapInPandas(tidy(run), _xy(rows))


def _joined(labels: DataFrame, found: DataFrame) -> DataFrame:
    """labels (cls, comp, ...) with comps that the pairs (x, y) of found tie made one."""
    name = lambda a, b: labels.select(F.col("cls").alias(a), F.col("comp").alias(b))
    edges = found.join(name("x", "a"), "x").join(name("y", "b"), "y").where("a <> b").select("a", "b")
    new = components(edges).select(F.col("node").alias("comp"), F.col("label").alias("to"))
    return written(labels.join(new, "comp", "left").withColumn("comp", F.coalesce("to", "comp")).select(*labels.columns), "own")


def _with_all(labels: DataFrame, classes: DataFrame) -> DataFrame:
    """labels (cls, comp), and the classes that it lacks as comps of their own."""
    return written(labels.union(classes.select("cls").distinct().join(labels, "cls", "left_anti").select("cls", F.col("cls").alias("comp"))), "labels")


def _families(members: DataFrame, percent: int) -> DataFrame:
    """(cls, fam): components over all pairs that share a bucket of members and are within the distance, and whose sizes
    allow the similarity. Classes without such a pair are left out."""
    edges = written(_within(members, percent).distinct(), "edges")
    # first one edge a class, to its least parent; then what other edges join of the few components that this leaves
    labels = components(edges.groupBy("b").agg(F.min_by("a", F.xxhash64("a")).alias("a"))).withColumnsRenamed({"node": "cls", "label": "comp"})
    labels = _with_all(labels, edges.select(F.col("a").alias("cls")))
    labels = _joined(labels, edges.select(F.col("a").alias("x"), F.col("b").alias("y")))
    large = members.where("nb > 1").select("key", "cls", "n", "sig")
    if not large.isEmpty():
        # a class without a pair so far may have one in another block
        labels = _with_all(labels, large)
        found = written(_across(large.join(labels, "cls"), percent), "found")
        if not found.isEmpty():
            labels = _joined(labels, found)
    return labels.withColumnRenamed("comp", "fam")


def _compared(rows: DataFrame, percent: int) -> DataFrame:
    """(x, y): enough links to join all classes of rows (fam, cls, comp, set) that links join, beyond their comps.

    In a group, each class that is asked about is measured against all others at once: its shingles are marked, and the
    marks under each set summed."""

    def links(group: pd.DataFrame) -> list[tuple]:
        sets = [np.frombuffer(s, np.uint64) for s in group["set"]]
        sizes = np.array([len(s) for s in sets])
        distinct, flat = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum([0, *sizes])[:-1]
        marks = np.zeros(len(distinct), np.int32)

        def ask(i: int, n: int) -> np.ndarray:
            own, end = flat[starts[i] : starts[i] + sizes[i]], starts[n - 1] + sizes[n - 1]
            marks[own] = 1
            both = np.add.reduceat(marks[flat[:end]], starts[:n])
            marks[own] = 0
            return 100 * both >= percent * (sizes[:n] + sizes[i] - both)

        return _tied(group, ask)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, ["fam", "i", "j"]):
            if (group["asked"] == 0).any():
                yield pd.DataFrame(links(group), columns=["x", "y"])

    return _dealt(rows, "fam", F.length("set"), 8 * SHINGLES).mapInPandas(tidy(run), _xy(rows))


def _starts(pdf: pd.DataFrame, by: list[str]) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(pdf), bool)
    if len(pdf):
        new[1:] = False
        for c in by:
            v = pdf[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _whole(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted batches cut anew so that no run of equal keys spans two."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        if held and tuple(pdf[by].iloc[0]) != tuple(held[-1][by].iloc[-1]):
            yield pd.concat(held, ignore_index=True)
            held = []
        at = int(_starts(pdf, by)[-1])
        if at:
            yield pd.concat([*held, pdf.iloc[:at]], ignore_index=True)
            held = []
        held.append(pdf.iloc[at:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of equal keys of sorted batches."""
    for pdf in _whole(batches, by):
        starts = _starts(pdf, by)
        for a, b in zip(starts, [*starts[1:], len(pdf)], strict=True):
            yield pdf.iloc[a:b]


def _tried(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (x, y) whose full sets are similar enough. Many x are tried against one y; they are dealt into blocks, each of which gets y's set once."""
    counts = written(pairs.groupBy("y").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("nb")), "counts")
    own = pairs.join(sets, pairs["x"] == sets["cls"]).select("y", "x", "set").join(counts, "y")
    own = own.select("y", F.pmod(F.xxhash64("x"), F.col("nb")).cast("int").alias("b"), F.lit(1).alias("kind"), "x", "set")
    one = counts.join(sets, counts["y"] == sets["cls"]).select("y", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"), F.lit(0).alias("kind"), F.col("y").alias("x"), "set")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        against = None
        for pdf in batches:
            out = []
            for y, kind, x, s in zip(pdf["y"], pdf["kind"], pdf["x"], pdf["set"], strict=True):
                a = np.frombuffer(s, np.uint64)
                if kind == 0:
                    against = a
                    continue
                both = len(np.intersect1d(a, against, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(against) - both):
                    out.append((x, y))
            yield pd.DataFrame(out, columns=["x", "y"])

    return one.union(own).repartition("y", "b").sortWithinPartitions("y", "b", "kind").mapInPandas(tidy(run), _xy(sets))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id that links reach, itself included), kept (doc_id is that).

    One row for each row of docs. Empty or null text has 0 shingles and no links. A null doc_id takes part in links;
    it is nobody's component_id unless all of its component have none. Rows that share a doc_id but not a text are
    different documents. Empty table: no rows."""
    return _resolved(docs, k, percent).drop("h")


def _resolved(docs: DataFrame, k: int, percent: int) -> DataFrame:
    with small_batches(docs.sparkSession):
        rows = written(sketch(docs, k), "sketch").withColumnRenamed("cls", "digest")
    classes = rows.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "h")).alias("one"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")
    )
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")  # a number for each, fixed by writing it
    members = written(_members(classes), "members")
    families = _families(members, percent)
    labels = _linked(families, _sets(docs, classes.join(families, "cls", "left_semi").select("cls", "digest", "one.*"), k), percent)
    joined = classes.select("cls", "digest", "low").join(labels, "cls", "left").select("digest", "low", F.coalesce("comp", "cls").alias("comp"))
    lows = written(joined.groupBy("comp").agg(F.min("low").alias("component_id")), "lows")
    ids = written(joined.select("digest", "comp").join(lows, "comp").select("digest", "component_id"), "ids")
    out = rows.select("doc_id", "h", "n_shingles", "digest").join(ids, "digest", "left")
    # an empty text stands for itself
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "h", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _members(classes: DataFrame) -> DataFrame:
    """key, cls, n, sig of each class in each of its buckets of two or more, with nb (blocks of the bucket, a power of two:
    blocks of two buckets are equal or inside each other) and low (least hash of a cls of the bucket)."""
    keyed = _keyed(classes)
    nb = F.pow(F.lit(2), F.greatest(F.ceil(F.log2(F.col("m") / BLOCK)), F.lit(0))).cast("int")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.xxhash64("cls")).alias("low")).where("m > 1").select("key", nb.alias("nb"), "low")
    # by sort and merge at every size, as both tables grow with the input
    return keyed.join(written(shared, "shared").hint("merge"), "key").join(classes.select("cls", "n", "sig").hint("merge"), "cls")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cls, set) of the wanted (cls, digest, doc_id, h) classes, from the text of one document each: by id and text, as
    many may have no id or share one."""
    wanted = wanted.withColumnsRenamed({"doc_id": "w_id", "h": "w_h"}).hint("merge")
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("h") == F.col("w_h"))).select("cls", "digest", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for pdf in batches:
            texts, own = [t if t is not None else b"" for t in pdf["text"]], list(zip(pdf["cls"], pdf["digest"], strict=True))
            for part in _slices(texts):
                out = [(c, s.tobytes()) for (c, d), s in zip(own[part], shingle_sets(texts[part], k, words), strict=True) if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d]
                yield pd.DataFrame(out, columns=["cls", "set"])

    with small_batches(docs.sparkSession):
        return written(texts.mapInPandas(tidy(run), "cls bigint, set binary").dropDuplicates(["cls"]), "sets")


def _linked(families: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(cls, comp) of the classes of all families: comp is the least class that links reach."""
    labels = written(families.select("fam", "cls", F.col("cls").alias("comp")), "own")

    large = sets.join(labels, "cls").groupBy("fam").agg(F.sum(F.length("set")).alias("bytes")).where(F.col("bytes") > 8 * SHINGLES).select("fam")
    large = written(large, "large")
    for salt in range(ROUNDS if not large.isEmpty() else 0):
        rows = labels.join(large, "fam")
        ones = rows.groupBy("fam").agg(F.min(F.struct(F.xxhash64("cls", F.lit(salt)).alias("r"), "cls", "comp")).alias("one"))
        ones = written(ones.select("fam", F.col("one.cls").alias("y"), F.col("one.comp").alias("its")), "ones")
        pairs = written(rows.join(ones, "fam").where("comp <> its").select(F.col("cls").alias("x"), "y"), "pairs")
        found = written(_tried(pairs, sets, percent), "found")
        if not found.isEmpty():
            labels = _joined(labels, found)
    found = written(_compared(labels.join(sets, "cls"), percent), "found")
    return (labels if found.isEmpty() else _joined(labels, found)).select("cls", "comp")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that are not kept; equal rows of a kept document all stay."""
    gone = _resolved(docs, k, percent).where("NOT kept").select("doc_id", "h").distinct()
    gone = written(gone, "gone")
    return as_rows(docs).join(gone.hint("merge"), F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("row.text") == F.col("h")), "left_anti").select("row.*")


def op1(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, k=4, percent=80)
