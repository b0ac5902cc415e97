"""Best-fit packing by exact-complement hashing.

Documents become token pieces of at most `size`; only longer ones are cut. The plan is made on the histogram of piece
lengths, which has at most `size` entries whatever the corpus: for the longest length in stock, sums of one, two and
three lengths in stock that exactly fill its gap are looked up in an index that is made once and follows the stock, and
a combination is used as many times as the stock allows; what has no exact complement is placed best-fit. The plan is a bounded list of (lengths, times). Pieces of one
length are numbered without gathering them (counts per length and salt, then places inside each), and a piece's number
finds its sequence and offset in the plan.
"""

from __future__ import annotations

import bisect
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import chunks, default_path
from tidemark.llm.columns import of_numbers, of_texts
from tidemark.llm.common import small_batches, written

SIZE = 2048
END = 0
#: Pieces of one length that are numbered together.
SALT_ROWS = 10_000


def _lowered(text: str) -> str:
    """The text in lower case, as the tokenizer has it letter by letter, unless a letter or a special token could come out
    differently. The tokenizer composes letters and marks before it lowers them, and not all capitals have the composed
    forms of their small letters: a text that composing changes, before or after, stays as it is."""
    if "<" in text:
        return text
    low = text.lower()
    if text.isascii() or _latin(text):
        return low
    composed = "Σ" not in text and "İ" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)
    return low if composed else text


def _latin(text: str) -> bool:
    """Whether all is in the first 256 code points, of which none composes with another."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """The library's ids of texts, as packed 32-bit numbers. Chunks between blanks that aren't remembered are encoded
    many at once, parted by a special token: the library cuts those out before anything else, so the chunks stay apart."""

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.special = [t for t, _ in special]
        self.border, self.border_id = special[0] if special else (None, -1)
        end = self.tokenizer.model.end_of_word_suffix or "</w>"
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(end)]] = True
        self.known: dict[str, bytes] = {}
        self.most = most

    def _packed(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, new: set[str]) -> None:
        known = self.known
        stems = {c[:-1] if c[-1:] in ",." and c[:-1].isalpha() else c for c in new}  # a word and its mark are two words to the library
        stems = (stems | {",", "."}).difference(known)
        for c in [c for c in stems if self.border is None or "<" in c and any(t in c for t in self.special)]:
            known[c] = self._packed(c).tobytes()
        words = [c for c in stems if c.isalpha() and c.lower().isalpha()]
        if words:  # all letters: one word each, whose last id alone has the mark of a word's end
            ids = self._packed(" ".join(words))
            cuts = np.flatnonzero(self.ends[ids]).tolist()
            if len(cuts) == len(words):
                whole = ids.tobytes()
                for c, a, b in zip(words, [-1, *cuts], cuts, strict=False):
                    known[c] = whole[4 * a + 4 : 4 * b + 4]
        if many := [c for c in stems if c not in known]:
            ids = self._packed(self.border.join(many))
            cuts = np.flatnonzero(ids == self.border_id).tolist()
            whole = ids.tobytes()
            for c, a, b in zip(many, [-1, *cuts], [*cuts, len(ids)], strict=True):
                known[c] = whole[4 * a + 4 : 4 * b]
        for c in new.difference(known):
            known[c] = known[c[:-1]] + known[c[-1]]

    def __call__(self, texts: pd.Series) -> Iterator[tuple[int, bytes]]:
        """(number of the text, its ids) in order, for runs of texts of bounded total length; null is empty."""
        whole = [t if isinstance(t, str) else "" for t in texts]
        at = 0
        while at < len(whole):
            to, n = at, 0
            while to < len(whole) and (to == at or n + len(whole[to]) <= 1 << 20):
                n += len(whole[to])
                to += 1
            split = [chunks(_lowered(t)) for t in whole[at:to]]
            if len(self.known) > self.most:
                self.known.clear()
            if new := set().union(*split).difference(self.known):
                self._learn(new)
            for k, own in enumerate(split):
                yield at + k, b"".join(map(self.known.__getitem__, own))
            at = to


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker process."""
    return Encoder(path)


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece. Null text is empty: one piece with the end id alone."""
    path = path or default_path()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder, end = _encoder(path), np.array([END], "<u4").tobytes()
        for batch in batches:
            lengths, crcs = [], []
            for _, packed in encoder(batch):
                ids = packed + end
                parts = [ids[first : first + 4 * size] for first in range(0, len(ids), 4 * size)]
                lengths.append([len(part) // 4 for part in parts])
                crcs.append([zlib.crc32(part) for part in parts])
            yield pd.DataFrame({"length": lengths, "ids_crc32": crcs})
        if len(encoder.known) > 100_000:  # the worker lives on
            encoder.known.clear()

    cut = of_texts(run, "length array<bigint>, ids_crc32 array<bigint>")
    parts = F.arrays_zip(F.col("cut.length").alias("length"), F.col("cut.ids_crc32").alias("ids_crc32"))
    rows = docs.select("doc_id", cut("text").alias("cut")).select("doc_id", F.posexplode(parts).alias("piece", "part"))
    return rows.select("doc_id", "piece", (F.col("piece").cast("bigint") * size).alias("start"), "part.length", "part.ids_crc32")


Plan = list[tuple[tuple[int, ...], int]]


def plan(stock: dict[int, int], size: int = SIZE) -> Plan:
    """(lengths in order, times) of sequences that together use up the stock of lengths: the fewest that come of exact
    complements of up to three, two or one lengths."""
    sums = pair_sums([x for x, n in stock.items() if n], size)
    return min((exact(stock, size, most, sums) for most in (3, 2, 1)), key=lambda made: sum(times for _, times in made))


def pair_sums(lengths: list[int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(longer ones, starts): the pairs of lengths of sum s have the longer lengths longer[starts[s] : starts[s + 1]],
    greatest first. At most size**2 / 4 pairs."""
    have = np.array(sorted(lengths), np.int64)
    a, b = np.nonzero(have[:, None] + have[None, :] < size)
    a, b = have[a[a >= b]], have[b[a >= b]]
    order = np.lexsort((-a, a + b))
    return a[order].astype(np.int32), np.searchsorted((a + b)[order], np.arange(size + 1))


class Complements:
    """What fills a gap exactly: a hash table from sums to combinations of one, two or three lengths in stock.

    A single is the stock itself, pairs are listed by sum, and a triple is a first length and a pair of the remaining sum.
    The lists are made once: stock only runs out, so an entry whose lengths don't suffice any more never comes back, and
    each sum's place in its list only moves on."""

    def __init__(self, left: np.ndarray, size: int, most: int, sums: tuple[np.ndarray, np.ndarray]):
        self.left, self.size, self.most = left, size, most
        self.longer, self.starts = sums
        self.at = self.starts[:-1].tolist()
        self.end = self.starts[1:].tolist()
        self.first: dict[int, int] = {}

    def _pair(self, total: int, *held: int) -> tuple[int, int] | None:
        """The pair in stock of this sum with the longest length, beside the held lengths."""
        left, head = self.left, True
        for k in range(self.at[total], self.end[total]):
            a = int(self.longer[k])
            b = total - a
            if left[a] > (a == b) and left[b] > 0:
                if left[a] > (a == b) + held.count(a) and left[b] > (a == b) + held.count(b):
                    return a, b
                head = False  # only the held ones stand against it
            elif head:
                self.at[total] = k + 1
        return None

    def find(self, x: int) -> tuple[int, ...] | None:
        """One, two or three lengths in stock that fill x up to the size, next to one x itself; x is the longest in stock."""
        gap = self.size - x
        if gap <= x and self.left[gap] > (gap == x):
            return (gap,)
        if self.most > 1 and (found := self._pair(gap, x)):
            return found
        if self.most > 2:
            # while x is the longest, a first length that fits no pair once fits none later
            for a in range(self.first.get(x, min(gap - 2, x)), (gap - 1) // 3, -1):
                self.first[x] = a
                if self.left[a] > (a == x) and (found := self._pair(gap - a, x, a)):
                    return (a, *found)
            self.first[x] = 0
        return None


def exact(stock: dict[int, int], size: int, most: int, sums: tuple[np.ndarray, np.ndarray] | None = None) -> Plan:
    """Exact complements of up to `most` lengths for the longest first, then best fit."""
    left = np.zeros(size + 1, np.int64)
    for length, n in stock.items():
        left[length] += n
    out: Plan = []

    def use(lengths: tuple[int, ...]) -> None:
        need = {x: lengths.count(x) for x in lengths}
        times = min(int(left[x]) // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * times
        out.append((lengths, times))

    if left[size]:
        use((size,))
    complements = Complements(left, size, most, sums or pair_sums(np.flatnonzero(left).tolist(), size))
    rest: dict[int, int] = {}
    for x in range(size - 1, 0, -1):
        while left[x]:
            if (found := complements.find(x)) is None:
                rest[x], left[x] = int(left[x]), 0
            else:
                use((x, *found))
    return out + best_fit(rest, size)


def best_fit(stock: dict[int, int], size: int) -> Plan:
    """Best-fit decreasing over a histogram: equal bins are one entry with a count, split when only some of them get a length."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps: list[int] = []

    def put(lengths: tuple[int, ...], times: int) -> None:
        gap = size - sum(lengths)
        if gap not in bins:
            bins[gap] = []
            bisect.insort(gaps, gap)
        bins[gap].append((lengths, times))

    for x in sorted(stock, reverse=True):
        n = stock[x]
        while n:
            at = bisect.bisect_left(gaps, x)
            if at == len(gaps):
                k = size // x  # new bins take as many as go in
                if n >= k:
                    put((x,) * k, n // k)
                    n %= k
                else:
                    put((x,) * n, 1)
                    n = 0
                continue
            gap = gaps[at]
            lengths, times = bins[gap].pop()
            if not bins[gap]:
                del bins[gap], gaps[at]
            k = gap // x
            if n >= k * times:
                put(lengths + (x,) * k, times)
                n -= k * times
            elif n >= k:
                put(lengths, times - n // k)
                put(lengths + (x,) * k, n // k)
                n %= k
            else:
                if times > 1:
                    put(lengths, times - 1)
                put(lengths + (x,) * n, 1)
                n = 0
    return [b for group in bins.values() for b in group]


def places(made: Plan) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, by the number of a piece of it: (first number, first sequence, how many per sequence, index of its offsets), offsets."""
    by: dict[int, list[tuple[int, int, int, list[int]]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, times in made:
        offsets: dict[int, list[int]] = {}
        at = 0
        for x in lengths:
            offsets.setdefault(x, []).append(at)
            at += x
        for x, own in offsets.items():
            by.setdefault(x, []).append((used.get(x, 0), sequence, len(own), own))
            used[x] = used.get(x, 0) + times * len(own)
        sequence += times
    out = {}
    for x, rows in by.items():
        flat = np.array([o for r in rows for o in r[3]], np.int64)
        begins = np.cumsum([0, *[r[2] for r in rows]])[:-1]
        out[x] = (*[np.array([r[i] for r in rows], np.int64) for i in range(3)], begins, flat)
    return out


def pack(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """The pieces with sequence_id and offset. A length has a salt for every SALT_ROWS of its pieces, so no window is large however
    many share it; pieces are told apart by a number that they are written with, as rows may repeat."""
    columns = parts.columns
    parts = written(parts.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    stock = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}  # at most `size` rows
    salts = parts.sparkSession.createDataFrame([(x, -(-n // SALT_ROWS)) for x, n in stock.items()], "length bigint, _salts int")
    salted = parts.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("_row"), F.col("_salts")).cast("int")).drop("_salts")
    counts = written(salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")), "counts")
    table = places(plan(stock, size))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    firsts = written(counts.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_first")), "firsts")
    order = Window.partitionBy("length", "_salt").orderBy("_row")
    numbered = salted.withColumn("_k", F.row_number().over(order) - 1).join(firsts, ["length", "_salt"])

    def place(lengths: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        lengths, numbers = lengths.to_numpy(), numbers.to_numpy()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for x in np.unique(lengths):
            own = np.flatnonzero(lengths == x)
            first, start, per, begins, offsets = table[int(x)]
            i = np.searchsorted(first, numbers[own], side="right") - 1
            k = numbers[own] - first[i]
            sequence[own], offset[own] = start[i] + k // per[i], offsets[begins[i] + k % per[i]]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = of_numbers(place, "sequence_id bigint, offset bigint")
    return numbered.select(*columns, placed(F.col("length"), F.col("_k") + F.col("_first")).alias("_place")).select(*columns, "_place.*")


def op5(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """All pieces of all documents with their place. An empty table gives no rows; null and empty texts are one piece of the
    end id; a text longer than `size` is cut and each full piece has a sequence of its own; repeated rows are packed each;
    of pieces of equal length it is open which one takes which place. Other columns of docs play no part."""
    with small_batches(docs.sparkSession):
        return pack(pieces(docs, path, size), size)
