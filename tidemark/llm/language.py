"""Language ID with hyperdimensional profiles.

Each letter gets a random vector of +1 and -1 made from its code point alone. A trigram is bound by multiplying its
letters' vectors, permuted (rotated) by 2, 1 and 0 places. A language's prototype is the bundle (sum) of the trigrams
of its training texts; a text is the bundle of its own, and goes to the language of the greatest cosine.

Bundles are linear, so a text's inner product with a prototype is the sum over its trigrams of one number per
(trigram, language). The text's own norm is the same for all languages and cancels in the ranking and in the score.
Training ships one vector per language and task to the shuffle, and to the driver one vector per language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tidemark.llm.columns import of_texts
from tidemark.llm.common import fresh, small_batches, tidy

UNKNOWN = "und"
DIMENSIONS = 2048
#: Languages are a small closed set of labels; training refuses to bring more prototypes than this to the driver.
MAX_LANGUAGES = 1000
_PIECE = 1 << 18  # characters looked at together
#: Fewer letters than this say too little for a floor under the cosine: of learned texts of one or two words (sf0.01) some are no nearer than noise.
FEW_LETTERS = 16


def noise(dimensions: int = DIMENSIONS) -> float:
    """A cosine that a text sharing no trigram with a language hardly reaches: four deviations of that of two random vectors, 0.088 for 2048 dimensions."""
    return 4 / dimensions**0.5


class Letters:
    """Random vectors by code point, made on first use; the same in every process."""

    def __init__(self, dimensions: int):
        self.dimensions, self.known = dimensions, {}

    def __call__(self, cp: int) -> np.ndarray:
        v = self.known.get(cp)
        if v is None:
            v = self.known[cp] = np.random.default_rng(cp).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1
        return v

    def bind(self, triples: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """Vectors of (n, 3) code points, a block at a time."""
        cps, inverse = np.unique(triples, return_inverse=True)
        table = np.stack([self(int(c)) for c in cps]) if len(cps) else np.zeros((0, self.dimensions), np.int8)
        inverse = inverse.reshape(triples.shape)
        first, second = np.roll(table, 2, axis=1), np.roll(table, 1, axis=1)
        for at in range(0, len(triples), 2048):
            part = slice(at, at + 2048)
            yield part, (first[inverse[part, 0]] * second[inverse[part, 1]] * table[inverse[part, 2]]).astype(np.float32)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct (n, 3) code points, for each place in the joined text the trigram that starts there or -1, start of each text).

    Letters are lower-cased; every other character is a border, 0. A trigram has a letter in its middle, so none
    spans two words or two texts."""
    lowered = [t.lower() for t in texts]
    joined = "\n".join(["", *lowered, ""])
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    starts = np.cumsum([0, *[len(t) + 1 for t in lowered]])[:-1]  # the trigram at a text's border has its first letter in the middle
    there = np.flatnonzero(np.bincount(cp))
    letters = np.array([c for c in there if chr(c).isalpha()], np.int64)
    ids = np.zeros(int(there[-1]) + 1, np.int64)
    ids[letters] = np.arange(1, len(letters) + 1)
    s, k = ids[cp], len(letters) + 1
    code = (s[:-2] * k + s[1:-1]) * k + s[2:]
    ok = s[1:-1] > 0
    if k**3 <= 1 << 21:
        distinct = np.flatnonzero(np.bincount(code[ok], minlength=1))
        lookup = np.full(k**3, -1, np.int64)
        lookup[distinct] = np.arange(len(distinct))
        place = np.where(ok, lookup[code], -1)
    else:
        distinct, found = np.unique(code[ok], return_inverse=True)
        place = np.full(len(code), -1, np.int64)
        place[ok] = found
    back = np.concatenate([[0], letters])
    triples = np.stack([back[distinct // (k * k)], back[distinct // k % k], back[distinct % k]], axis=1) if len(distinct) else np.zeros((0, 3), np.int64)
    return triples, place, starts


def _packed(triples: np.ndarray) -> np.ndarray:
    return (triples[:, 0] << 42) | (triples[:, 1] << 21) | triples[:, 2]


def _unpacked(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes >> 42, (codes >> 21) & 0x1FFFFF, codes & 0x1FFFFF], axis=1)


def _pieces(texts: list[str]) -> Iterator[list[int]]:
    """Runs of text numbers of bounded total length; a longer text stands alone, whole."""
    run, n = [], 0
    for i, t in enumerate(texts):
        if run and n + len(t) > _PIECE:
            yield run
            run, n = [], 0
        run.append(i)
        n += len(t)
    if run:
        yield run


def _squares(place: np.ndarray, starts: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places with a trigram, the text of each, sum of the squared trigram counts of each text: its bundle's squared norm over the dimensions, to a few hundredths, as trigrams are nearly orthogonal)."""
    where = np.flatnonzero(place >= 0)
    text = np.searchsorted(starts, where, "right") - 1
    pairs, n = np.unique(text * max(1, distinct) + place[where], return_counts=True)
    return where, text, np.bincount(pairs // max(1, distinct), n.astype(np.float64) ** 2, len(starts))


def train(labelled: DataFrame, dimensions: int = DIMENSIONS, even: bool = False) -> dict[str, np.ndarray]:
    """Prototypes of unit length from all rows of (text, lang); null texts and languages are left out. No rows: no prototypes.

    even: every text has the same weight, however long, so none drowns its language's others."""

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts):
            codes, inverse = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return codes, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(codes))

        for pdf in batches:
            for lang, own in pdf.groupby("lang", sort=False):
                texts = own["text"].tolist()
                for run in _pieces(texts):
                    triples, place, starts = trigrams([texts[i] for i in run])
                    if len(triples):
                        parts = held.setdefault(lang, [])
                        if even:
                            where, text, squares = _squares(place, starts, len(triples))
                            n = np.bincount(place[where], np.rint(2**24 / np.sqrt(squares[text])), len(triples))
                        else:
                            n = np.bincount(place[place >= 0], minlength=len(triples)).astype(np.float64)
                        parts.append((_packed(triples), n))
                        if len(parts) > 16:
                            held[lang] = [merged(parts)]
        letters = Letters(dimensions)
        for lang, parts in held.items():
            codes, counts = merged(parts)
            total = np.zeros(dimensions)
            for part, vectors in letters.bind(_unpacked(codes)):
                total += counts[part] @ vectors.astype(np.float64)  # whole numbers below 2**53: exact in any order
            yield pd.DataFrame({"lang": lang, "place": np.arange(dimensions, dtype=np.int32), "value": total.astype(np.int64)})

    rows = labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    sums = rows.mapInPandas(tidy(bundle), "lang string, place int, value bigint").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    with small_batches(labelled.sparkSession):
        cells = sums.limit(MAX_LANGUAGES * dimensions + 1).toPandas()
    if len(cells) > MAX_LANGUAGES * dimensions:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    out = {}
    for lang, own in sorted(cells.groupby("lang")):
        v = np.zeros(dimensions)
        v[own["place"].to_numpy()] = own["value"].to_numpy()
        if norm := np.linalg.norm(v):
            out[lang] = v / norm
    return out


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str], floor: float = 0.0, evenly: dict[str, np.ndarray] | None = None) -> DataFrame:
    """Columns `keep` of docs with lang_pred and score (0 to 1: the best language's share of the positive cosines).

    Null text, text without a letter, or no prototypes: `und` with score 0; so are texts of FEW_LETTERS or more whose
    best cosine with prototypes and those of `evenly` is below a floor above 0. Ties go to the first language by name.
    Texts are looked at whole. None of `keep` may be called lang_pred or score."""
    names = sorted(prototypes)
    columns = [*[prototypes[n] for n in names], *(evenly or {}).values()]
    weights = np.stack(columns, axis=1).astype(np.float32) if names else None
    dimensions = len(weights) if names else 0

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters = Letters(dimensions)
        known, table = np.zeros(0, np.int64), np.zeros((0, len(columns)))

        def looked_up(triples: np.ndarray) -> np.ndarray:
            nonlocal known, table
            codes = _packed(triples)
            new = np.setdiff1d(codes, known)
            if len(new):
                if len(known) > 2_000_000:
                    known, table, new = known[:0], table[:0], np.unique(codes)
                rows = np.concatenate([v @ weights for _, v in letters.bind(_unpacked(new))]).astype(np.float64)
                order = np.argsort(both := np.concatenate([known, new]), kind="stable")
                known, table = both[order], np.concatenate([table, rows])[order]
            return table[np.searchsorted(known, codes)]

        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch]
            pred, best = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            for run in _pieces(texts) if names else ():
                triples, place, starts = trigrams([texts[i] for i in run])
                if not len(triples):
                    continue
                w = np.concatenate([looked_up(triples), np.zeros((1, len(columns)))])
                cells = np.concatenate([place, [-1]])  # a last cell, so that every start is inside
                sums = np.stack([np.add.reduceat(w[cells, j], starts) for j in range(len(columns))], axis=1)
                some = np.add.reduceat(cells >= 0, starts) > 0
                sums = np.where(some[:, None], sums, 0)
                nearest, sums = sums.max(axis=1), sums[:, : len(names)]
                top, share = sums.argmax(axis=1), np.clip(sums, 0, None)
                total = share.sum(axis=1)
                if floor > 0:
                    _, text, squares = _squares(place, starts, len(triples))
                    some &= (np.bincount(text, minlength=len(run)) < FEW_LETTERS) | (nearest >= floor * np.sqrt(dimensions * squares))
                for at, i in enumerate(run):
                    if some[at]:
                        pred[i] = names[top[at]]
                        best[i] = share[at].max() / total[at] if total[at] > 0 else 0.0
            yield pd.DataFrame({"lang_pred": pred, "score": best})

    kept, found = [F.col(f"`{c}`") for c in keep], fresh(keep, "_found")
    scored = of_texts(score, "lang_pred string, score double")
    return docs.select(*kept, scored("text").alias(found)).select(*kept, f"{found}.lang_pred", f"{found}.score")


def fold(doc_id: Column) -> Column:
    """A document's fold, 0 to 2, from the CRC of its id as text; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0))


def op6(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned only from the folds that aren't held out.

    Null text and text without a letter are `und` with score 0, as is everything where nothing is labelled; texts are
    looked at whole, however long; of equal scores the first language by name is predicted. Repeated rows are rows of their own, in
    learning too, and null ids are in fold 0. An empty table gives no rows."""
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", fold(F.col("doc_id")) == 1)
    return predict(rows, train(rows.where("NOT held_out")), ["doc_id", "held_out"])
