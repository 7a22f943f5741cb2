"""Token counts by rank-synchronous merging of numpy arrays (operator 8).

Texts fall into chunks at single spaces, where pre-tokens never continue; chunks that this worker hasn't counted yet are split into
pre-tokens. New pre-tokens are held together as one ragged array of symbols. In each step, every sequence applies its own
lowest-rank pair, all of that pair's places at once, until none has a pair left; what survives is counted. Only pairs beside a merge
are looked up again. A text's count is the sum over its chunks and special strings. Texts with characters that aren't assigned go
through the library.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import row_pieces

#: The byte-level pre-tokenizer's pattern (fixed value of the format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int32(1 << 30)


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, the rest go from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Merges:
    """A byte-level BPE vocabulary as arrays: pair keys in a hash table, with the rank and the merged id of each."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        end = spec["model"].get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.byte_ids = np.array([ids[c] for c in letters], np.int32)
        #: The symbol of a sequence's last byte.
        self.last_ids = np.array([ids[c + end] for c in letters], np.int32)
        keys, merged = [], []
        for pair in spec["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            keys.append(ids[a] << 20 | ids[b])
            merged.append(ids[a + b])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.fill(np.array(keys, np.int64), np.array(merged, np.int32))

    def fill(self, keys: np.ndarray, merged: np.ndarray, bits: int = 19) -> None:
        """Open addressing, a step at a time: those that find their place taken go on to the next one."""
        self.bits, self.reach = bits, 0
        self.slots = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, NONE, np.int32)
        self.merged = np.zeros(1 << bits, np.int32)
        left, place = np.arange(len(keys)), self.place(keys)
        while len(left):
            free = self.slots[place] < 0
            first = np.zeros(len(left), bool)
            first[np.unique(place, return_index=True)[1]] = True
            put = free & first
            self.slots[place[put]], self.rank[place[put]], self.merged[place[put]] = keys[left[put]], left[put], merged[left[put]]
            left, place = left[~put], (place[~put] + 1) & ((1 << bits) - 1)
            self.reach += 1

    def place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE without a rule) and merged id of each pair."""
        key = left.astype(np.int64) << 20 | right
        at = self.place(key)
        found = self.slots[at]
        go = np.flatnonzero((found != key) & (found >= 0))
        for _ in range(self.reach):
            if not len(go):
                break
            at[go] = (at[go] + 1) & ((1 << self.bits) - 1)
            found = self.slots[at[go]]
            go = go[(found != key[go]) & (found >= 0)]
        same = self.slots[at] == key
        return np.where(same, self.rank[at], NONE), self.merged[at]

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that all byte strings end as, one after the other, and how many each has."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        symbols, owner = self.byte_ids[raw], np.repeat(np.arange(len(pieces), dtype=np.int32), size)
        tail = np.zeros(len(raw), bool)
        tail[np.cumsum(size)[size > 0] - 1] = True
        symbols[tail] = self.last_ids[raw[tail]]
        count = size.copy()
        alive = np.ones(len(symbols), bool)  # survivors, in the whole array
        where = np.arange(len(symbols))  # places of the sequences that still merge
        rank, merged = np.full(len(symbols), NONE, np.int32), np.zeros(len(symbols), np.int32)
        inner = np.flatnonzero(~tail)
        rank[inner], merged[inner] = self.lookup(symbols[inner], symbols[inner + 1])
        now_symbols, now_owner = symbols.copy(), owner
        while len(where):
            new = np.flatnonzero(np.r_[True, now_owner[1:] != now_owner[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, new), np.diff(np.append(new, len(where))))
            at = np.flatnonzero((rank == least) & (rank < NONE))
            if len(at) > 1:
                # of overlapping places (the same symbol three times or more), the first, third, ... of a run
                opens = np.r_[True, np.diff(at) > 1]
                if not opens.all():
                    nth = np.arange(len(at)) - np.flatnonzero(opens)[np.cumsum(opens) - 1]
                    at = at[nth % 2 == 0]
            if len(at):
                now_symbols[at] = merged[at]
                symbols[where[at]] = merged[at]
                alive[where[at + 1]] = False
                np.subtract.at(count, now_owner[at], 1)
            keep = least < NONE
            gone = np.zeros(len(where), bool)
            gone[at + 1] = True
            moved = np.zeros(len(where), bool)
            moved[at] = True
            keep &= ~gone
            where, now_symbols, now_owner, rank, merged, moved = where[keep], now_symbols[keep], now_owner[keep], rank[keep], merged[keep], moved[keep]
            if not len(where):
                break
            again = moved.copy()
            again[:-1] |= moved[1:]
            at = np.flatnonzero(again)
            last = (at + 1 == len(where)) | (now_owner[np.minimum(at + 1, len(where) - 1)] != now_owner[at])
            rank[at[last]] = NONE
            at = at[~last]
            rank[at], merged[at] = self.lookup(now_symbols[at], now_symbols[at + 1])
        return symbols[alive], count

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """How many symbols each byte string ends as."""
        return self.merge(pieces)[1]


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


class ChunkCounts:
    """Counts of chunks, kept up to bounds of number and size; a chunk begins with its space, but for a text's first one."""

    def __init__(self, rules: Merges, most: int = 500_000, most_bytes: int = 32 << 20):
        import regex

        self.rules, self.most, self.most_bytes, self.held = rules, most, most_bytes, 0
        self.assigned: dict[str, bool] = {}
        self.tokenizer = None
        self.known: dict[str, int] = {}
        self.tokens: dict[str, int] = {}
        self.find = regex.compile(PATTERN).findall
        # a space before more white space or at the end: pre-tokens may span it, so such texts are one chunk
        self.spanned = regex.compile(r" (?:\s|\Z)").search
        self.special = regex.compile("|".join(map(regex.escape, rules.special))) if rules.special else None

    def chunks(self, text: str) -> list[str]:
        if self.spanned(text):
            return self.find(text)
        first, *rest = text.split(" ")
        return [first, *map(" ".__add__, rest)] if first else list(map(" ".__add__, rest))

    def learn(self, chunks: list[str]) -> None:
        split = list(map(self.find, chunks))
        fresh = {t for found in split for t in found}.difference(self.tokens)
        if fresh:
            if len(self.tokens) > self.most or self.held > self.most_bytes:
                self.tokens.clear()
                fresh = {t for found in split for t in found}
            fresh = list(fresh)
            self.tokens.update(zip(fresh, self.rules.count([t.encode() for t in fresh]).tolist(), strict=True))
        get = self.tokens.__getitem__
        self.known.update(zip(chunks, (get(f[0]) if len(f) == 1 else sum(map(get, f)) for f in split), strict=True))

    def whole(self, text: str) -> bool:
        """Whether a text has a character that isn't assigned: the library's tables and ours may class it differently."""
        found = set(text)
        for c in found.difference(self.assigned):
            self.assigned[c] = unicodedata.category(c) != "Cn"
        return not all(map(self.assigned.__getitem__, found))

    def library(self, text: str) -> int:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.rules.path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def count(self, texts: list[str]) -> list[int]:
        extra, chunks = [], []
        for text in texts:
            if not text.isascii() and self.whole(text):
                extra.append(self.library(text))
                chunks.append([])
                continue
            parts = self.special.split(text) if self.special is not None and any(x in text for x in self.rules.special) else [text]
            extra.append(len(parts) - 1)
            chunks.append(self.chunks(text) if len(parts) == 1 else [c for part in parts for c in self.chunks(part)])
        missing = {c for found in chunks for c in found}.difference(self.known)
        if missing:
            if len(self.known) > self.most or self.held > self.most_bytes:
                self.known.clear()
                self.tokens.clear()
                self.held = 0
                missing = {c for found in chunks for c in found}
            self.held += 2 * sum(map(len, missing))
            self.learn(list(missing))
        get = self.known.__getitem__
        return [n + sum(map(get, found)) for n, found in zip(extra, chunks, strict=True)]


@lru_cache(maxsize=2)
def chunk_counts(path: str) -> ChunkCounts:
    """One for the life of a worker: its cache serves all its tasks."""
    return ChunkCounts(merges(path))


def count_texts(batches, path: str):
    counts = chunk_counts(path)
    for batch in row_pieces(batches):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        n_bytes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(n_bytes, pa.int64()), "n_tokens": pa.array(counts.count(texts), pa.int64())})


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 512) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit), for a byte-level BPE vocabulary file.

    Null and empty texts have no bytes and no tokens. Special strings inside texts count as one token each. Other columns of docs
    don't matter; an empty table gives an empty result. vocabulary: by default byte_bpe_50k.json of the public tokenizers.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(lambda batches: count_texts(batches, vocabulary), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
