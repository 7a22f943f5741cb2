"""Best-fit decreasing packing (operator 6).

Documents of equal length are alike to best-fit decreasing, so it runs on the counts of lengths (as many as a sequence has tokens, at
most): a segment tree over remaining capacities finds the tightest class of open bins in logarithmic time, and whole ranges of
equal bins are filled at once. The plan maps ranges of ranks among equal lengths to ranges of bins; ranks are dealt on the
executors, and a join places each document. No document or bin passes through the driver on its own.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections import deque
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulmark.llm.common import ragged, row_pieces, written
from haulmark.llm.token_counts import merges


class Capacities:
    """Segment tree over remaining capacities 0..size: which have open bins."""

    def __init__(self, size: int):
        self.base = 1 << (size + 1).bit_length()
        self.some = [False] * (2 * self.base)

    def mark(self, capacity: int, some: bool) -> None:
        i = self.base + capacity
        self.some[i] = some
        while i > 1:
            i >>= 1
            self.some[i] = self.some[2 * i] or self.some[2 * i + 1]

    def tightest(self, length: int) -> int | None:
        """The least marked capacity >= length."""
        i = self.base + length
        if self.some[i]:
            return length
        while i > 1:
            if not i & 1 and self.some[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.base
            i >>= 1
        return None


PLAN = "length int, lo long, hi long, bin long, each int, at int"


def best_fit_decreasing(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, bin, each, at): items lo..hi-1 of a length go to bins bin, bin+1, ..., each of them in one, from offset at on."""
    tree, bins, made, plan = Capacities(size), [deque() for _ in range(size + 1)], 0, []

    def put(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            bins[capacity].append((first, n))
            tree.mark(capacity, True)

    for length in sorted((x for x in counts if x > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, n = size, made, -(-left // (size // length))
                made += n
            else:
                first, n = bins[capacity].popleft()
            each = capacity // length
            full = min(n, left // each)
            if full:
                plan.append((length, rank, rank + full * each, first, each, size - capacity))
                put(capacity - each * length, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if n and left:  # fewer than fill a bin
                plan.append((length, rank, rank + left, first, each, size - capacity))
                put(capacity - left * length, first, 1)
                left, first, n = 0, first + 1, n - 1
            if n:
                bins[capacity].appendleft((first, n))
            if capacity < size or n:
                tree.mark(capacity, bool(bins[capacity]))
    return plan


def pack(items: DataFrame, size: int, order: list[str]) -> DataFrame:
    """Adds sequence_id and offset to items, whose length lies in 1..size. order: columns that tell items apart, for ranks among equals."""
    names = items.columns
    counts = {r[0]: r[1] for r in items.groupBy("length").count().collect()}  # size rows at most
    plan = items.sparkSession.createDataFrame(best_fit_decreasing(counts, size), PLAN)
    groups = max(1, sum(counts.values()) // 50_000)
    ranked = items.withColumn("_g", F.pmod(F.xxhash64(*order), F.lit(groups)))
    before = ranked.groupBy("_g", "length").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.withColumn("_k", F.row_number().over(Window.partitionBy("_g", "length").orderBy(*order)) - 1)
    ranked = ranked.join(before.drop("count"), ["_g", "length"]).withColumn("_r", F.col("_k") + F.col("_before")).alias("x")
    p = plan.alias("p")
    if len(counts) <= size and plan.count() <= 100_000:  # 36 bytes a row
        p = F.broadcast(p)
    placed = ranked.join(p, (F.col("x.length") == F.col("p.length")) & (F.col("x._r") >= F.col("p.lo")) & (F.col("x._r") < F.col("p.hi")))
    i = F.col("x._r") - F.col("p.lo")
    return placed.select(*[F.col(f"x.{c}") for c in names], (F.col("p.bin") + F.floor(i / F.col("p.each"))).cast("long").alias("sequence_id"), (F.col("p.at") + i % F.col("p.each") * F.col("x.length")).cast("long").alias("offset"))


class WordIds:
    """Token ids of texts. White space never lies inside a token, so ids are worked out once for each distinct run of non-space bytes.

    A run is normalised and split as the vocabulary file says; its words merge by rank in numpy. Runs that hold a special string or a
    character that isn't assigned go through the library itself, which is loaded when the first of them comes. The cache starts anew beyond
    most runs or most_bytes of them.
    """

    def __init__(self, path: str, most: int = 250_000, most_bytes: int = 16 << 20):
        import regex

        self.path = path
        self.rules = merges(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if steps != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split":
            raise ValueError(f"{path} isn't a word vocabulary of the known kind")
        self.find = regex.compile("\n|" + split["pattern"]["Regex"]).findall
        self.assigned: dict[str, bool] = {}
        #: What every special string begins with, so runs without it hold none.
        self.marker = os.path.commonprefix(self.rules.special).encode() if self.rules.special else b"\n"
        self.most, self.most_bytes = most, most_bytes
        self.clear()

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.no_truncation()
        found.no_padding()
        return found

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.held = 0
        self.ids, self.starts, self.sizes, self.used, self.n = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0, 0

    def words(self, runs: list[str]) -> tuple[list[str], np.ndarray]:
        """All words of all runs, as the library's normaliser and pre-tokenizer give them, and how many each run has.

        Runs are joined by line ends, which are white space to both, and go through one pass. Capital sigma is lowered first, as the
        library lowers letters one by one and Python looks at a sigma's neighbours.
        """
        joined = "\n".join(runs)
        if not joined.isascii():
            joined = unicodedata.normalize("NFC", joined).replace("\u03a3", "\u03c3")
        found = self.find(joined.lower())
        breaks = np.flatnonzero(np.fromiter((w == "\n" for w in found), bool, len(found)))
        return [w for w in found if w != "\n"], np.diff(np.r_[-1, breaks, len(found)]) - 1

    def known(self, run: str) -> bool:
        """Whether all characters are assigned, and marks that combine have long been: of others, the library's tables and Python's may
        say different things."""
        for c in set(run).difference(self.assigned):
            self.assigned[c] = (unicodedata.ucd_3_2_0 if unicodedata.combining(c) else unicodedata).category(c) != "Cn"
        return all(map(self.assigned.__getitem__, run))

    def learn(self, runs: list[bytes]) -> None:
        odd = {w for w in runs if self.marker in w or (not w.isascii() and not self.known(w.decode()))}
        if odd:
            runs = [w for w in runs if w not in odd]
            odd = list(odd)
            found = [e.ids for e in self.library.encode_batch([w.decode() for w in odd], add_special_tokens=False)]
            self.add(odd, np.array([x for y in found for x in y], np.uint32), np.array([len(y) for y in found], np.int64))
        if not runs:
            return
        words, n_words = self.words(b"\n".join(runs).decode().split("\n"))
        fresh = list(set(words))
        flat, size = self.rules.merge([w.encode() for w in fresh])
        start = np.cumsum(size) - size
        number = dict(zip(fresh, range(len(fresh)), strict=True))
        at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        ids = flat[ragged(start[at], size[at])].astype(np.uint32)
        total = np.r_[0, np.cumsum(size[at])]
        last = np.cumsum(n_words)
        self.add(runs, ids, total[last] - total[last - n_words])

    def add(self, runs: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids = self.room(self.ids, self.used + len(ids))
        self.starts, self.sizes = self.room(self.starts, self.n + len(sizes)), self.room(self.sizes, self.n + len(sizes))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.n : self.n + len(sizes)] = sizes
        self.held += sum(map(len, runs))
        self.index.update(zip(runs, range(self.n, self.n + len(sizes)), strict=True))
        self.used, self.n = self.used + len(ids), self.n + len(sizes)

    @staticmethod
    def room(array: np.ndarray, n: int) -> np.ndarray:
        return array if n <= len(array) else np.concatenate([array, np.zeros(max(n - len(array), len(array)), array.dtype)])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        split = [t.split() for t in texts]
        seen = set().union(*split)
        missing = list(seen.difference(self.index))
        if missing:
            if self.n > self.most or self.held > self.most_bytes:
                self.clear()
                missing = list(seen)
            self.learn(missing)
        out = []
        for words in split:
            at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
            out.append(self.ids[ragged(self.starts[at], self.sizes[at])])
        return out


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One for the life of a worker: its cache serves all its tasks."""
    return WordIds(path)


def cut(batches, vocabulary: str, size: int, end: int, with_ids: bool):
    words = word_ids(vocabulary)
    for batch in row_pieces(batches, most=1 << 20):
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        rows = []
        for doc, ids in zip(batch.column("doc_id").to_pylist(), words.encode(texts), strict=True):
            ids = np.append(ids, np.uint32(end)).astype("<u4")
            for k in range(0, len(ids), size):
                piece = ids[k : k + size]
                rows.append((doc, k // size, k, len(piece), zlib.crc32(piece.tobytes())) + ((piece.astype(np.int32),) if with_ids else ()))
        cols = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()))
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names=names[: len(cols)])


def best_fit_packing(docs: DataFrame, vocabulary: str | None = None, size: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """Packs all documents into as few sequences of at most size tokens as best-fit decreasing finds.

    A document is its token ids and then end; only longer ones are cut, into pieces of size tokens and a rest. Returns per piece:
    doc_id, piece, start, length, ids_crc32, (ids where asked for), sequence_id, offset. Null and empty texts are end alone.
    Repeated rows are packed each on its own. Other columns of docs don't matter; an empty table gives an empty result.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = rows.mapInArrow(lambda batches: cut(batches, vocabulary, size, end, with_ids), PIECES + (", ids array<int>" if with_ids else ""))
    # numbered once and for all in a written table: doc_id may be missing or repeated
    pieces = written(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    return pack(pieces, size, ["_row"]).drop("_row").withColumn("length", F.col("length").cast("long"))
