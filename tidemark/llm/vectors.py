"""Searches over vectors: exact inner products by ball trees, and near neighbours by one-bit codes.

The rows are cut into cells by hyperplanes that are fitted on a bounded sample, and cells into shards of bounded size
(a cell of many equal vectors has many shards). Each shard's index is built once and written. A query is searched in its own
shard first; then the shards are taken in waves, and in each wave a query goes only to those whose centre and radius
allow something as good as its kth best so far, which is passed on from wave to wave. A task holds one index and
streams queries through it. No row is a product row: rows are shuffled once, and queries once for each shard they reach.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, tidy, written

#: Rows of a shard and of a tree's leaf; queries that go through an index in one task; shards of a wave.
SHARD, LEAF, BLOCK, WAVE = 8192, 128, 4096, 1024
#: Rows that the hyperplanes of the cells are fitted on, and cells at most. They change the cost, not the result of a search.
SAMPLE, CELLS = 20_000, 1024
_SHARD = ["d", "cell", "s"]


def sound(vectors: DataFrame, zero: bool) -> DataFrame:
    """vec_id, v (doubles): rows whose vector isn't null or empty and has no null or non-finite component; without zero, all-zero ones go too."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = vectors.select("vec_id", v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & F.col("vec_id").isNotNull()).where(~bad)
    return out if zero else out.where(F.exists("v", lambda x: x != 0))


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.float64)


class Cells:
    """Hyperplanes in a binary tree, each through the middle of its sample rows across their widest line."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.ways, self.cuts, self.kids = [], [], []
        self._node(sample, depth)
        self.ways, self.cuts, self.kids = np.array(self.ways), np.array(self.cuts), np.array(self.kids)

    def _node(self, v: np.ndarray, depth: int) -> int:
        at = len(self.kids)
        self.ways.append(np.zeros(v.shape[1]))
        self.cuts.append(0.0)
        self.kids.append((at, at))
        if depth and len(v) > 1:
            far = v[((v - v.mean(axis=0)) ** 2).sum(axis=1).argmax()]
            way = far - v[((v - far) ** 2).sum(axis=1).argmax()]
            along = v @ way
            cut = float(np.median(along))
            over = along > cut
            if over.any() and not over.all():
                self.ways[at], self.cuts[at] = way, cut
                self.kids[at] = (self._node(v[~over], depth - 1), self._node(v[over], depth - 1))
        return at

    def of(self, v: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(v), np.int64)
        while True:
            over = (v * self.ways[at]).sum(axis=1) > self.cuts[at]
            down = self.kids[at, over.astype(np.int64)]
            if (down == at).all():
                return at
            at = down


def _sharded(rows: DataFrame) -> DataFrame:
    """rows (row, vec_id, v) with d (length of v), cell and s: shards of about SHARD rows at most, near vectors together."""
    n = rows.count()
    picked = rows.where(F.pmod(F.xxhash64("row"), F.lit(max(1, n // SAMPLE))) == 0).select("v").limit(2 * SAMPLE).toPandas()["v"]
    lengths = picked.map(len)
    length = int(lengths.mode()[0]) if len(lengths) else 0  # the hyperplanes are for the commonest length; others have one cell each
    depth = max(0, min(int(CELLS).bit_length() - 1, int(np.ceil(np.log2(max(1, n / SHARD)))) + 1 if n > SHARD else 0))
    cells = Cells(_matrix(picked[lengths == length]), depth) if length else None

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = pdf["v"].map(len).to_numpy(np.int32)
            cell = np.zeros(len(pdf), np.int32)
            if len(own := np.flatnonzero(d == length)):
                cell[own] = cells.of(_matrix(pdf["v"].iloc[own]))
            yield pdf.assign(d=d, cell=cell)

    with small_batches(rows.sparkSession):
        placed = written(rows.select("row", "vec_id", "v").mapInPandas(tidy(place), "row bigint, vec_id bigint, v array<double>, d int, cell int"), "placed")
    salts = written(placed.groupBy("d", "cell").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("salts")), "salts")
    return placed.join(salts, ["d", "cell"]).withColumn("s", F.pmod(F.xxhash64("row", F.lit(1)), F.col("salts")).cast("int")).drop("salts")


def _indexed(sharded: DataFrame, build: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """One row for each shard: d, cell, s, centre, radius, index (the arrays of build(ids, vectors) as bytes)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["vec_id", "row"])
        v = _matrix(group["v"])
        centre = v.mean(axis=0)
        radius = float(np.sqrt(((v - centre) ** 2).sum(axis=1)).max())
        out = io.BytesIO()
        np.savez(out, **build(group["vec_id"].to_numpy(), v))
        first = group.iloc[0]
        return pd.DataFrame({"d": [first["d"]], "cell": [first["cell"]], "s": [first["s"]], "centre": [centre], "radius": [radius], "index": [out.getvalue()]})

    return sharded.groupBy(*_SHARD).applyInPandas(run, "d int, cell int, s int, centre array<double>, radius double, index binary")


def _visited(index: DataFrame, asked: DataFrame, find: Callable, score: str) -> DataFrame:
    """row, query_id, vec_id, score, beyond: what find(arrays, ids, vectors, bounds) finds for the queries of asked
    (d, cell, s, row, vec_id, v, bound) in their shards. Queries of one shard are dealt into blocks, each with the index."""
    asked = written(asked, "asked")
    blocks = written(asked.groupBy(*_SHARD).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nb")), "blocks")
    none = lambda t: F.lit(None).cast(t)
    held = index.join(blocks, _SHARD).select(
        *_SHARD, F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"), F.lit(0).alias("kind"), "index", none("bigint").alias("row"), none("bigint").alias("vec_id"), none("array<double>").alias("v"), none("double").alias("bound")
    )
    put = asked.join(blocks, _SHARD).select(*_SHARD, F.pmod(F.xxhash64("row"), F.col("nb")).cast("int").alias("b"), F.lit(1).alias("kind"), none("binary").alias("index"), "row", "vec_id", "v", "bound")
    by = [*_SHARD, "b"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrays = None
        for pdf in batches:
            kinds = pdf["kind"].to_numpy()
            cuts = sorted({0, len(pdf), *np.flatnonzero(kinds == 0).tolist()})
            for a, b in zip(cuts, cuts[1:], strict=False):
                if kinds[a] == 0:
                    arrays = dict(np.load(io.BytesIO(pdf["index"].iloc[a])))
                    a += 1
                if a < b:
                    own = pdf.iloc[a:b]
                    ids = own["vec_id"].to_numpy(np.int64)
                    out = pd.DataFrame(find(arrays, ids, _matrix(own["v"]), own["bound"].to_numpy(np.float64)), columns=["at", "vec_id", "score", "beyond"])
                    at = out.pop("at").to_numpy(np.int64)
                    yield out.assign(row=own["row"].to_numpy(np.int64)[at], query_id=ids[at])[["row", "query_id", "vec_id", "score", "beyond"]]

    with small_batches(index.sparkSession):
        both = held.union(put).repartition(*by).sortWithinPartitions(*by, "kind")
        return written(both.mapInPandas(tidy(run), f"row bigint, query_id bigint, vec_id bigint, score {score}, beyond string"), "found")


def _ranked(found: DataFrame, k: int, largest: bool) -> DataFrame:
    """The best k of each query row, with their rank; ties to the smaller vec_id."""
    best = [F.col("score").desc(), F.col("beyond").desc_nulls_last()] if largest else [F.col("score")]
    by = Window.partitionBy("row").orderBy(*best, "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _searched(rows: DataFrame, every: int, k: int, build: Callable, find: Callable, reach: Callable, score: str, largest: bool) -> DataFrame:
    """query_id, rank, vec_id, score. reach(queries, bounds, centres, radii): which queries may find in which shards
    something as good as their bound, the kth score known so far (NaN: none)."""
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "rows")  # a number for each row, fixed by writing it
    sharded = _sharded(rows)
    index = written(_indexed(sharded, build), "index")
    queries = written(sharded.where(F.col("vec_id") % every == 0), "queries")
    best = written(_ranked(_visited(index, queries.withColumn("bound", F.lit(float("nan"))).select(*_SHARD, "row", "vec_id", "v", "bound"), find, score), k, largest), "best")

    def wave(roots: list) -> DataFrame:
        bounds = best.where(F.col("rank") == k).select("row", F.col("score").cast("double").alias("bound"))
        by_length = {}
        for r in roots:
            by_length.setdefault(r["d"], []).append(r)
        table = {d: (np.array([r["centre"] for r in own]), np.array([r["radius"] for r in own]), np.array([(r["cell"], r["s"]) for r in own])) for d, own in by_length.items()}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for d, own in pdf.groupby("d"):
                    if d not in table:
                        continue
                    centres, radii, names = table[d]
                    home = (own["cell"].to_numpy()[:, None] == names[:, 0]) & (own["s"].to_numpy()[:, None] == names[:, 1])
                    who, where = np.nonzero(reach(_matrix(own["v"]), own["bound"].to_numpy(np.float64), centres, radii) & ~home)
                    for a in range(0, len(who), 5000):
                        i, j = who[a : a + 5000], where[a : a + 5000]
                        yield own.iloc[i].assign(cell=names[j, 0].astype(np.int32), s=names[j, 1].astype(np.int32))[[*_SHARD, "row", "vec_id", "v", "bound"]]

        asked = queries.join(bounds, "row", "left").withColumn("bound", F.coalesce("bound", F.lit(float("nan"))))
        go = asked.select(*_SHARD, "row", "vec_id", "v", "bound").mapInPandas(tidy(run), "d int, cell int, s int, row bigint, vec_id bigint, v array<double>, bound double")
        found = _visited(index, go, find, score)
        return written(_ranked(best.drop("rank").union(found), k, largest), "best")

    held: list = []
    for root in index.select(*_SHARD, "centre", "radius").toLocalIterator():  # the driver holds WAVE of them at once
        held.append(root)
        if len(held) == WAVE:
            best, held = wave(held), []
    if held:
        best = wave(held)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


# ---- exact inner products


class BallTree:
    """A ball tree of integer vectors: each node has a centre, a radius, its least id, and its rows from start to stop.

    Rows are in the order of the leaves; leaves have no children (-1)."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.order, self.nodes = np.arange(len(ids)), []
        self._node(ids, v, 0, len(ids))
        centre, radius, low, kids, spans = zip(*self.nodes, strict=True)
        self.centres, self.radii, self.low, self.kids, self.spans = np.array(centre), np.array(radius), np.array(low), np.array(kids), np.array(spans)
        self.ids, self.v = ids[self.order], v[self.order]
        self.lengths = np.sqrt((self.centres**2).sum(axis=1))

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> BallTree:
        out = cls.__new__(cls)
        out.__dict__.update(arrays)
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        return {k: getattr(self, k) for k in ("centres", "radii", "low", "kids", "spans", "ids", "v", "lengths")}

    def _node(self, ids: np.ndarray, v: np.ndarray, start: int, stop: int) -> int:
        rows = self.order[start:stop]
        own = v[rows]
        centre = own.mean(axis=0)
        away = np.sqrt(((own - centre) ** 2).sum(axis=1))
        at = len(self.nodes)
        kids = (-1, -1)
        self.nodes.append((centre, float(away.max()) * (1 + 1e-12) + 1e-9, int(ids[rows].min()), kids, (start, stop)))
        if len(rows) > LEAF and away.max() > 0:
            far = own[away.argmax()]
            other = own[((own - far) ** 2).sum(axis=1).argmax()]
            self.order[start:stop] = rows[np.argsort(own @ (far - other), kind="stable")]  # halves along the widest line: depth stays logarithmic
            half = start + len(rows) // 2
            kids = (self._node(ids, v, start, half), self._node(ids, v, half, stop))
            self.nodes[at] = (*self.nodes[at][:3], kids, (start, stop))
        return at

    def search(self, q: np.ndarray, own_id: int, k: int, bound: float) -> list[tuple[int, int]]:
        """(score, id) of the best k other than own_id; bound is a score that k rows somewhere are known to reach.

        Nodes are visited by their upper bound, q . centre + |q| radius, greatest first; one is left out when it can't
        reach the kth score, or can only reach it with larger ids."""
        length = float(np.sqrt((q * q).sum()))
        upper = np.floor(self.centres @ q + length * self.radii * (1 + 1e-9) + 1e-6 + 1e-9 * length + 1e-12 * length * self.lengths)
        queue, best = [(-upper[0], 0)], []  # best: a heap of (score, -id), the worst first
        while queue:
            top, node = heapq.heappop(queue)
            top = -top
            if top < bound or (len(best) == k and (top < best[0][0] or (top == best[0][0] and self.low[node] > -best[0][1]))):
                if top < bound or top < best[0][0]:
                    break
                continue
            if self.kids[node, 0] >= 0:
                for kid in self.kids[node].tolist():
                    heapq.heappush(queue, (-upper[kid], kid))
                continue
            start, stop = self.spans[node]
            ids, scores = self.ids[start:stop], self.v[start:stop] @ q
            good = ids != own_id
            least = max(bound, best[0][0]) if len(best) == k else bound
            if not np.isneginf(least):
                good &= scores >= least
            ids, scores = ids[good], scores[good]
            if len(ids) > k:
                order = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[order], scores[order]
            for s, i in zip(scores.tolist(), ids.tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
        return [(int(s), -i) for s, i in best]


def _beyond(score: int) -> str | None:
    """For scores that a long can't tell apart: text that sorts as they do."""
    if -(2**63) < score < 2**63 - 1:
        return None
    digits = str(abs(score))
    if score > 0:
        return f"1{len(digits):05d}{digits}"
    return f"0{99999 - len(digits):05d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def _inner(k: int) -> Callable:
    def find(arrays, query_ids, queries, bounds):
        tree, most, out = BallTree.of(arrays), max(np.abs(arrays["v"]).max(), 1), []
        whole = None
        for at, (qid, q, bound) in enumerate(zip(query_ids.tolist(), queries, bounds, strict=True)):
            # sums of products below 2**53 are exact in doubles; beyond that all rows are scored in whole numbers
            if most * max(np.abs(q).max(), 1) * len(q) < 2**53:
                found = tree.search(q, qid, k, -np.inf if np.isnan(bound) else bound)
            else:
                whole = whole if whole is not None else [[int(x) for x in row] for row in tree.v]
                q = [int(x) for x in q]
                scores = ((sum(a * b for a, b in zip(q, row, strict=True)), -i) for i, row in zip(tree.ids.tolist(), whole, strict=True) if i != qid)
                found = [(s, -i) for s, i in heapq.nlargest(k, scores)]
            out += [(at, i, min(max(s, -(2**63)), 2**63 - 1), _beyond(s)) for s, i in found]
        return out

    return find


def _may_reach(q: np.ndarray, bounds: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    length = np.sqrt((q**2).sum(axis=1))[:, None]
    upper = q @ centres.T + length * radii
    slack = 1e-9 * length * (np.sqrt((centres**2).sum(axis=1)) + radii) + 1e-6
    return ~(upper + slack < bounds[:, None])


def top_inner(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest integer inner products of floor(scale * x) for each query row.

    Ties go to the smaller vec_id. Repeated rows count each, as candidates and as queries, which then have a list each; no
    row with the query's id is its candidate. Vectors of other lengths are no candidates of a query. Scores beyond 64
    bits are ranked as they are and returned as the nearest long. Empty table: no rows."""
    rows = sound(vectors, zero=True).select("vec_id", F.transform("v", lambda x: _floored(x * scale)).alias("v"))
    return _searched(rows, every, k, lambda ids, v: BallTree(ids, v).arrays(), _inner(k), _may_reach, "bigint", largest=True)


def _floored(x):
    """The greatest whole number up to x, as a double; doubles from 2**53 on are whole, and a long would not hold all."""
    return F.when(F.abs(x) >= 2.0**53, x).otherwise(F.floor(x).cast("double"))


# ---- near neighbours by one-bit codes


def rotation(d: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal (d, d) matrix, the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def codes(v: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits of the rotated unit residuals, residual lengths, <code, unit residual>)."""
    left = (v - centre) @ turn
    length = np.sqrt((left**2).sum(axis=1))
    unit = left / np.where(length > 0, length, 1)[:, None]
    signs = unit >= 0
    agree = np.abs(unit).sum(axis=1) / np.sqrt(v.shape[1])
    return np.packbits(signs, axis=1), length, np.where(length > 0, agree, 1.0)


#: The eight signs of every byte.
_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1


def code_products(bits: np.ndarray, left: np.ndarray) -> np.ndarray:
    """(queries, codes): inner products of rotated queries with codes (signs over the root of the dimension), straight from the
    packed bits: a table of the 256 sums of each eight components, and one look-up for each byte."""
    d = left.shape[1]
    eights = np.zeros((len(left), bits.shape[1] * 8), np.float32)
    eights[:, :d] = left / np.sqrt(d)
    table = eights.reshape(len(left), -1, 8) @ _SIGNS.T
    out = table[:, 0, :][:, bits[:, 0]]
    for j in range(1, bits.shape[1]):
        out += table[:, j, :][:, bits[:, j]]
    return out


#: Deviations between an estimate and its bound.
ERROR_BOUND = 2.5


def _coded(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
    centre = v.mean(axis=0)
    bits, length, agree = codes(v, centre, rotation(v.shape[1]))
    return {"ids": ids, "v": v, "centre": centre, "bits": bits, "length": length, "agree": agree}


def _nearest(k: int, width: float = ERROR_BOUND) -> Callable:
    def find(arrays, query_ids, queries, bounds):
        ids, v, bits, length, agree = (arrays[x] for x in ("ids", "v", "bits", "length", "agree"))
        d = v.shape[1]
        spread = np.sqrt(np.maximum(1 - agree**2, 0) / np.maximum(agree**2, 1e-12) / max(d - 1, 1))
        left = (queries - arrays["centre"]) @ rotation(d)
        q_length = np.sqrt((left**2).sum(axis=1))
        out = []
        for at in range(0, len(queries), 64):
            part = slice(at, at + 64)
            inner = code_products(bits, left[part]).astype(np.float64) / agree
            away = length**2 + q_length[part, None] ** 2 - 2 * length * inner
            low = away - 2 * length * q_length[part, None] * (width * spread + 1e-6)  # the look-ups add in single precision
            order = np.argpartition(away, min(k, len(ids) - 1), axis=1)[:, : k + 1]
            for j, (qid, q, bound) in enumerate(zip(query_ids[part].tolist(), queries[part], bounds[part], strict=True)):
                exact = ((v[order[j]] - q) ** 2).sum(axis=1)
                exact = np.sort(exact[ids[order[j]] != qid])
                kth = exact[k - 1] if len(exact) >= k else np.inf  # a kth distance that is reached for sure
                if not np.isnan(bound):
                    kth = min(kth, bound * bound * (1 + 1e-12))
                hopeful = low[j] <= kth
                hopeful[order[j]] = True
                again = np.flatnonzero(hopeful & (ids != qid))
                exact = np.sqrt(((v[again] - q) ** 2).sum(axis=1))
                best = np.lexsort((ids[again], exact))[:k]
                out += zip([at + j] * len(best), ids[again[best]].tolist(), exact[best].tolist(), [None] * len(best), strict=True)
        return out

    return find


def _may_be_near(q: np.ndarray, bounds: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    square = (q**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * q @ centres.T
    slack = 1e-9 * ((q**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1))
    return ~(np.sqrt(np.maximum(square - slack, 0)) - radii * (1 + 1e-9) > bounds[:, None])


def near_neighbours(vectors: DataFrame, every: int = 100, k: int = 10, width: float = ERROR_BOUND) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query row by Euclidean distance.

    Every vector has a code: the signs of its residual from its shard's mean, randomly rotated. With its length and its
    agreement with the code they estimate each distance; vectors whose lower bound (estimate less `width` deviations)
    is within the kth exact distance known are measured exactly. Ties, repeated rows and ids, other lengths and empty
    tables as in top_inner."""
    return _searched(sound(vectors, zero=False), every, k, _coded, _nearest(k, width), _may_be_near, "double", largest=False)


def op2(embeddings: DataFrame) -> DataFrame:
    """top_inner of the vectors; null vectors and such with null or non-finite components take no part, nor do null ids.
    Columns of other names play no part."""
    return top_inner(embeddings)


def op3(embeddings: DataFrame) -> DataFrame:
    """near_neighbours of the vectors; null and zero vectors and such with null or non-finite components take no part, nor do
    null ids. Columns of other names play no part."""
    return near_neighbours(embeddings)


OP2_SQL = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
