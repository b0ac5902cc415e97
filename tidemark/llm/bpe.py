"""BPE encoding and decoding, from the merge ranks and vocabulary of a tokenizer file.

A word's symbols stand in a doubly linked list; a priority queue holds its adjacent pairs by (merge rank, place). The
best pair is merged and the pairs with its new neighbours go in; queue entries whose symbols have changed since are
skipped. Words end with a mark, white space is dropped, letters are lower-cased; special tokens are cut out first.
Decoding joins the vocabulary strings of the ids, with the separator that the file's (missing) decoder calls for.

Ids of a chunk between spaces depend on that chunk alone, so each worker remembers a bounded number of chunks.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame

from tidemark.llm.columns import of_texts

TOKENIZER = "word_bpe_49k.json"
#: White space as the tokenizer's patterns know it, and the pattern of its words.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        model = raw["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {p: r for r, p in enumerate(pairs)}
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in raw["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        self.letters = byte_letters()
        self.words = regex.compile(WORDS)
        self.path, self._library = path, None
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def word(self, word: str) -> list[int]:
        """Ids of one word of byte letters."""
        symbols = list(word)
        symbols[-1] += self.end
        n = len(symbols)
        before, after, rank_of = list(range(-1, n - 1)), [*range(1, n), -1], self.ranks.get
        queue = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank_of((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i] if symbols[i] == a else -1
            if j < 0 or symbols[j] != b:
                continue  # stale: one of the two has been merged since
            symbols[i], symbols[j] = a + b, None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank_of((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(queue, (r, i, symbols[i], symbols[k]))
            if (h := before[i]) >= 0 and (r := rank_of((symbols[h], symbols[i]))) is not None:
                heapq.heappush(queue, (r, h, symbols[h], symbols[i]))
        return [self.vocab[s] for s in symbols if s is not None and s in self.vocab]

    def _newer(self, text: str) -> list[int]:
        """Ids of a text with code points that this Python's Unicode has no class for: the library's own tables compose,
        lower and part it."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        words = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [i for word, _ in words for i in self.word(word)]

    def _plain(self, text: str) -> list[int]:
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in text):
            return self._newer(text)
        text = unicodedata.normalize("NFC", text)
        text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
        letters, out = self.letters, []
        for m in self.words.finditer(text):
            out += self.word("".join([letters[b] for b in m.group().encode("utf-8", "replace")]))
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text; strings of special tokens become those tokens, as the library has it."""
        out, at = [], 0
        for m in self.cut.finditer(text) if self.cut else ():
            out += [*self._plain(text[at : m.start()]), self.special[m.group()]]
            at = m.end()
        return out + self._plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings joined by one blank: the file has no decoder of its own. Unknown ids are left out."""
        return " ".join([self.strings[i] for i in ids if i in self.strings])


class Remembered(dict):
    """chunk -> f(chunk), at most `most` of them and none of more than 64 characters."""

    def __init__(self, f: Callable, most: int = 700_000):
        self.f, self.most = f, most

    def __missing__(self, chunk: str):
        out = self.f(chunk)
        if len(chunk) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = out
        return out


def chunks(text: str) -> list[str]:
    """The text between blanks and line feeds: no token reaches across either."""
    return text.replace("\n", " ").split(" ")


@lru_cache(maxsize=1)
def _both(path: str) -> Remembered:
    """chunk -> (number of ids, ids as text, decoded); one for all tasks of a worker process."""
    codec = Codec(path)

    def both(chunk: str) -> tuple[int, str, str]:
        ids = codec.encode(chunk)
        return len(ids), " ".join(map(str, ids)), codec.decode(ids)

    return Remembered(both)


def op8(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text. Null text is empty: no ids, nothing decoded. A text
    is encoded chunk by chunk, whole however long; one row for each row, repeated ones and null ids too; an empty table
    gives no rows. Nothing depends on other rows or columns, so there are no ties."""
    path = path or default_path()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        remembered = _both(path)
        for batch in batches:
            out = []
            for text in batch:
                found = [x for x in map(remembered.__getitem__, chunks(text if isinstance(text, str) else "")) if x[0]]
                counts, ids, strings = zip(*found, strict=True) if found else ((), (), ())
                out.append((sum(counts), hashlib.sha256(" ".join(ids).encode()).hexdigest(), hashlib.sha256(" ".join(strings).encode()).hexdigest()))
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    coded = of_texts(run, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return docs.select("doc_id", coded("text").alias("coded")).select("doc_id", "coded.*")
