"""Byte-level BPE of a whole corpus in batched numpy merge rounds.

A text is split by the tokenizer's pattern; the words that a worker has not seen yet are merged together: the symbols
of all of them lie in one flat array, the ranks of all neighbouring pairs are found by binary search over the sorted
pair keys, every word merges its pairs of lowest rank, and the array is closed up, until no word has a pair left. Ids of
seen words are kept, so a text costs the split and one gather.

In words longer than the longest token, pairs of lowest rank within a token's length on both sides are merged, many of them
in a round. The ids are those of merging one rank after the other: what could take a symbol from such a pair is a token
that reaches from it to a pair of lower rank, and no token is that long.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary lies unless a path is given.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: The split of the byte-level tokenizer before merges (a fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept per worker.
KEPT_WORDS = 400_000
_NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file: printable Latin-1 bytes stand for
    themselves, the others follow from code point 256 on in their order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(own)]
    letter = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [letter[b] for b in range(256)]


class BytePairEncoder:
    """Ids of texts by the vocabulary file at `path` (JSON of a byte-level BPE: vocab and merges). No special tokens:
    their strings are ordinary text."""

    def __init__(self, path: str = DEFAULT_VOCABULARY) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        key = (left << 32) | right
        order = np.argsort(key, kind="stable")
        self.keys, self.rank, self.made = key[order], order.astype(np.int32), made[order]
        self.first = np.array([vocab[c] for c in byte_letters()], dtype=np.int32)
        self.longest = max(len(a) + len(b) for a, b in pairs) if pairs else 1  # bytes of the longest token; a letter is a byte
        self.split = regex.compile(PATTERN).findall
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.start = np.zeros(1 << 14, dtype=np.int64)
        self.count = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0

    def _pairs(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the pair that starts at each symbol (none: the largest int) and its place among the keys."""
        key = (sym[:-1].astype(np.int64) << 32) | sym[1:]
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        good = (self.keys[at] == key) & (word[:-1] == word[1:])
        return np.append(np.where(good, self.rank[at], _NONE), _NONE).astype(np.int32), np.append(at, 0)

    def _lowest(self, rank: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pair the lowest rank in its word, and the same or, in words longer than two tokens, the lowest rank within a
        token's length around it (more of it does no harm: a lower minimum only lets pairs wait)."""
        reps = np.diff(np.r_[head, len(rank)])
        least = np.repeat(np.minimum.reduceat(rank, head), reps)
        long = np.flatnonzero(np.repeat(reps > 2 * self.longest, reps))
        if not len(long):
            return least, least
        ahead, width = rank[long], 1
        while width <= self.longest:  # minima over 1, 2, 4, ... places from each on
            ahead[:-width] = np.minimum(ahead[:-width], ahead[width:])
            width *= 2
        first = min(width - 1, len(long))
        behind = np.r_[np.minimum.accumulate(rank[long[:first]]), ahead[: len(long) - first]]
        low = least.copy()
        low[long] = np.minimum(ahead, behind)
        return least, low

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words and how many each has."""
        out: list[np.ndarray | None] = [None] * len(words)
        size = np.array([len(w) for w in words], dtype=np.int64)
        todo = np.flatnonzero(size > 0)
        sym = self.first[np.frombuffer(b"".join(words[i] for i in todo), dtype=np.uint8)]
        word = np.repeat(todo, size[todo])
        while len(sym):
            rank, at = self._pairs(sym, word)
            least, low = self._lowest(rank, np.flatnonzero(np.r_[True, word[1:] != word[:-1]]))
            done = least == _NONE
            if done.any():
                w, s = word[done], sym[done]
                h = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                for i, part in zip(w[h], np.split(s, h[1:]), strict=True):
                    out[i] = part
                keep = ~done
                sym, word, rank, at, low = sym[keep], word[keep], rank[keep], at[keep], low[keep]
                if not len(sym):
                    break
            # Equal ranks in a row are overlapping pairs of one symbol: of a row all of which is lowest, the first, third,
            # ... pair is merged; a row of which a part is not waits.
            head = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
            reps = np.diff(np.r_[head, len(rank)])
            hit = np.repeat(np.logical_and.reduceat(rank == low, head) & (rank[head] != _NONE), reps)
            p = np.flatnonzero(hit & ((np.arange(len(rank)) - np.repeat(head, reps)) % 2 == 0))
            sym = sym.copy()
            sym[p] = self.made[at[p]]
            keep = np.ones(len(sym), dtype=bool)
            keep[p + 1] = False
            sym, word = sym[keep], word[keep]
        empty = np.zeros(0, dtype=np.int32)
        parts = [empty if x is None else x for x in out]
        counts = np.array([len(x) for x in parts], dtype=np.int64)
        return (np.concatenate(parts) if parts else empty), counts

    def _learn(self, words: list[str]) -> None:
        """Adds the ids of new words (distinct) to what is kept."""
        flat, counts = self.merge_words([w.encode("utf-8", "replace") for w in words])
        n, m = len(self.index), len(flat)
        if self.used + m > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), m), dtype=np.int32)])
        if n + len(words) > len(self.start):
            more = np.zeros(max(len(self.start), len(words)), dtype=np.int64)
            self.start, self.count = np.concatenate([self.start, more]), np.concatenate([self.count, more])
        self.flat[self.used : self.used + m] = flat
        self.start[n : n + len(words)] = self.used + np.cumsum(counts) - counts
        self.count[n : n + len(words)] = counts
        self.used += m
        self.index.update(zip(words, range(n, n + len(words)), strict=True))

    def _places(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The kept word of every word of the texts, and how many words each text has."""
        if len(self.index) > KEPT_WORDS:
            self._clear()
        split = [self.split(t) if t else [] for t in texts]
        flat = [w for s in split for w in s]
        index = self.index
        if new := [w for w in dict.fromkeys(flat) if w not in index]:
            self._learn(new)
        return np.array([index[w] for w in flat], dtype=np.int64), np.array([len(s) for s in split], dtype=np.int64)

    def count_tokens(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text; 0 for an empty and for a null text."""
        place, words = self._places(texts)
        total = np.r_[0, np.cumsum(self.count[place])]
        end = np.cumsum(words)
        return total[end] - total[end - words]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts and where each text ends in them (one more entry than texts, from 0)."""
        place, words = self._places(texts)
        count = self.count[place]
        total = int(count.sum())
        begin = np.cumsum(count) - count
        ids = self.flat[np.arange(total) + np.repeat(self.start[place] - begin, count)] if total else np.zeros(0, np.int32)
        ends = np.r_[0, np.cumsum(count)]
        return ids, np.r_[0, ends[np.cumsum(words)]]


@lru_cache(maxsize=2)
def encoder(path: str) -> BytePairEncoder:
    return BytePairEncoder(path)


def slices(texts: list[str | None], characters: int = 1_000_000) -> Iterator[slice]:
    """Consecutive slices of about so many characters, one text at least."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= characters:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def token_ids(documents: DataFrame, id_col: str, text_col: str, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, ids): the token ids of every text; an empty list for an empty and for a null text. One row per row, no
    shuffle. `path` must be readable on every executor."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for s in slices(texts):
                ids, ends = enc.encode(texts[s])
                column = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(ids, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.start, s.stop - s.start), column], [id_col, "ids"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, text_col: str, path: str = DEFAULT_VOCABULARY, name: str = "tokens") -> DataFrame:
    """The table with the text column replaced by its number of tokens (0 for an empty and for a null text)."""
    keep = [c for c in documents.columns if c not in (text_col, name)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            n = np.concatenate([enc.count_tokens(texts[s]) for s in slices(texts)] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, type=pa.int64())], [*keep, name])

    kinds = {f.name: f.dataType.simpleString() for f in documents.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{name}` bigint"])
    return documents.select(*keep, text_col).mapInArrow(work, schema)
