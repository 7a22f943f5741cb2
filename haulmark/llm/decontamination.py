"""Benchmark decontamination by greedy string tiling (operator 1).

Texts are compared as lower-case runs of letters and digits. Runs of `least` tokens that a document shares with a benchmark item are
the seeds that join the two. Around a pair's seeds, running Karp-Rabin matching finds the longest common passages again and again,
marks them so that they don't overlap, and stops below `least` tokens. Tiles may lie in any order, so a reordered passage counts
in full. A document is contaminated if its tiles cover enough of one item.

The benchmark is the query set: it goes to the executors in blocks of at most block_bytes of text, a pass over the documents each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import BYTE_SYMBOLS, U64, gram_hashes, hash_words, ragged, row_pieces, text_buffer, text_bytes, word_spans, written

_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
ROW = "_row_number"
#: Tokens that an item must have at least to be looked for.
SHORTEST = 2
SCHEMA = "doc_id long, n_tokens long, item_id long, covered long, item_tokens long, n_tiles int"


@dataclass(frozen=True)
class Tiling:
    """least: tokens in the shortest tile. coverage: the share of an item's tokens, in hundredths, that makes a document contaminated."""

    least: int = 5
    coverage: int = 60
    block_bytes: int = 32 << 20


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash per token of all texts, and each text's bounds among them."""
    low = buf.copy()
    upper = (low >= 65) & (low <= 90)
    low[upper] += 32
    if len(low) > 1:  # the letters that Latin-1 has beyond ASCII
        second = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
        low[second] += 32
    first, last = word_spans(low, offsets, _GAP)
    return hash_words(low, first, last, BYTE_SYMBOLS), np.searchsorted(first, offsets)


def free_grams(symbols: np.ndarray, free: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-grams without a marked token, and where they start."""
    if len(symbols) < k:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    taken = np.r_[0, np.cumsum(~free)]
    at = np.flatnonzero(taken[k:] == taken[:-k])
    return gram_hashes(symbols, k)[at], at


def common_grams(p: np.ndarray, p_free: np.ndarray, t: np.ndarray, t_free: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Places in p, in order, of unmarked k-grams that t has unmarked too, the range of each in t's sorted hashes, and t's places by hash."""
    hashes, at = free_grams(t, t_free, k)
    order = np.argsort(hashes, kind="stable")
    hashes, at = hashes[order], at[order]
    mine, where = free_grams(p, p_free, k)
    lo, hi = np.searchsorted(hashes, mine, side="left"), np.searchsorted(hashes, mine, side="right")
    got = hi > lo
    return where[got], lo[got], hi[got], at


def tiles(p: np.ndarray, t: np.ndarray, t_free: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in p, start in t, length) of greedy tiles, longest first; t_free is consumed.

    Karp-Rabin runs with the longest length for which an unmarked gram is shared (found by halving: a shared gram holds shared shorter
    ones). All matches of that length that don't overlap are marked, in order of place; then the next longest length. A gram's places in t
    are passed once a length, as marked ones stay marked, so a length takes time linear in both texts, however often they repeat.
    """
    p_free = np.ones(len(p), bool)
    found = []
    most = min(len(p), len(t))
    while True:
        low, high = least - 1, most
        while low < high:
            k = (low + high + 1) // 2
            if len(common_grams(p, p_free, t, t_free, k)[0]):
                low = k
            else:
                high = k - 1
        if low < least:
            return found
        n = low
        where, lo, hi, at = common_grams(p, p_free, t, t_free, n)
        at, mine, theirs = at.tolist(), p_free, t_free
        begin: dict[int, int] = {}
        for i, a, b in zip(where.tolist(), lo.tolist(), hi.tolist(), strict=True):
            if not (mine[i] and mine[i + n - 1]):  # marks of this round have this length, so one that overlaps covers an end
                continue
            k = begin.get(a, a)
            while k < b and not (theirs[at[k]] and theirs[at[k] + n - 1]):
                k += 1
            begin[a] = k
            if k < b and np.array_equal(p[i : i + n], t[at[k] : at[k] + n]):
                mine[i : i + n] = False
                theirs[at[k] : at[k] + n] = False
                found.append((i, at[k], n))
        most = n - 1


def near_seeds(at: np.ndarray, reach: int, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices within reach of a seed, and which of them start after a gap."""
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, np.maximum(at - reach, 0), 1)
    np.add.at(marks, np.minimum(at + k + reach, n), -1)
    index = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
    return index, np.r_[False, np.diff(index) > 1]


@dataclass
class Items:
    """A block of the benchmark. grams: the hashes of all items' grams, sorted; owner and place: the item of each, and where it starts.

    short: for each length below a tile, the items of so many tokens: hashes in order, ids, and tokens. Those match as a whole.
    """

    ids: list[int]
    tokens: list[np.ndarray]
    grams: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def prepare(rows: list[tuple[int, str]], least: int) -> Items:
    ids, found, whole = [], [], {}
    for i, text in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        got = tokens(raw, np.array([0, len(raw)]))[0]
        if len(got) >= least and i is not None:
            ids.append(i)
            found.append(got)
        elif len(got) >= SHORTEST and i is not None:
            same = whole.setdefault(len(got), {})
            key = tuple(got.tolist())
            same[key] = min(i, same.get(key, i))
    short = {}
    for n, items in whole.items():
        words = np.array(list(items), U64).reshape(-1, n)
        hashes = np.concatenate([gram_hashes(w, n) for w in words])
        by = np.argsort(hashes, kind="stable")
        short[n] = (hashes[by], np.array(list(items.values()), np.int64)[by], words[by])
    grams = [gram_hashes(x, least) for x in found]
    flat = np.concatenate([*grams, np.zeros(0, U64)])
    owner = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])
    place = np.concatenate([*[np.arange(len(g), dtype=np.int32) for g in grams], np.zeros(0, np.int32)])
    order = np.argsort(flat, kind="stable")
    return Items(ids, found, flat[order], owner[order], place[order], short)


def whole_items(symbols: np.ndarray, bounds: np.ndarray, items: Items) -> dict[int, tuple[int, int]]:
    """For each document that holds a short item as a whole: the least id of those, and how many tokens it has."""
    out: dict[int, tuple[int, int]] = {}
    for n, (hashes, ids, words) in items.short.items():
        grams = gram_hashes(symbols, n)
        at = np.flatnonzero(np.isin(grams, hashes))
        doc = np.searchsorted(bounds, at, side="right") - 1
        inside = at + n <= bounds[doc + 1]
        at, doc = at[inside], doc[inside]
        lo, hi = np.searchsorted(hashes, grams[at], side="left"), np.searchsorted(hashes, grams[at], side="right")
        row, item = np.repeat(np.arange(len(at)), hi - lo), ragged(lo, hi - lo)
        same = (symbols[at[row][:, None] + np.arange(n)] == words[item]).all(axis=1)
        for d, i in zip(doc[row[same]].tolist(), ids[item[same]].tolist(), strict=True):
            out[d] = min(out.get(d, (i, n)), (i, n))
    return out


def bounds_of(items: Items, grams: np.ndarray, least: int) -> dict[int, int]:
    """For each item with one of these distinct grams, how many of its tokens lie in shared grams: tiles can't cover more."""
    lo, hi = np.searchsorted(items.grams, grams, side="left"), np.searchsorted(items.grams, grams, side="right")
    at = ragged(lo, hi - lo)
    owner, place = items.owner[at], items.place[at]
    by = np.lexsort((place, owner))
    owner, place = owner[by], place[by]
    new = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    step = np.minimum(np.diff(place, append=0), least)
    step[np.append(new[1:] - 1, len(place) - 1)] = least
    return dict(zip(owner[new].tolist(), np.add.reduceat(step, new).tolist(), strict=True))


def best_tiling(text: np.ndarray, places: np.ndarray, grams: np.ndarray, items: Items, s: Tiling) -> tuple | None:
    """(item_id, covered, item_tokens, n_tiles) of the item that the text covers best; ties go to the least id.

    Items go by what they could be covered at most, and none is tiled that can't be better than the best one so far.
    """
    best, key = None, (0.0, 0)
    most = bounds_of(items, np.unique(grams), s.least)
    rank = sorted(most, key=lambda x: (-most[x] / len(items.tokens[x]), items.ids[x]))
    for x in rank:
        p = items.tokens[x]
        if (most[x] / len(p), -items.ids[x]) <= key:
            if most[x] / len(p) < key[0]:
                break
            continue
        own = places[np.isin(grams, gram_hashes(p, s.least))]
        index, gap = near_seeds(own, len(p), s.least, len(text))
        # a marked token between passages keeps matches from running across the gap
        spot = np.arange(len(index)) + np.cumsum(gap)
        t, free = np.zeros(len(index) + int(gap.sum()), U64), np.zeros(len(index) + int(gap.sum()), bool)
        t[spot], free[spot] = text[index], True
        got = tiles(p, t, free, s.least)
        covered = sum(n for _, _, n in got)
        if covered and (best is None or (covered / len(p), -items.ids[x]) > key):
            best, key = (items.ids[x], covered, len(p), len(got)), (covered / len(p), -items.ids[x])
    return best


def search(batches, items: Items, s: Tiling):
    bitmap = np.zeros(1 << 22, bool)
    bitmap[(items.grams >> U64(42)).astype(np.int64)] = True
    for batch in row_pieces(batches):
        buf, offsets = text_buffer(batch.column("text"))
        symbols, bounds = tokens(buf, offsets)
        grams = gram_hashes(symbols, s.least)
        at = np.flatnonzero(bitmap[(grams >> U64(42)).astype(np.int64)])
        at = at[np.isin(grams[at], items.grams)]
        doc = np.searchsorted(bounds, at, side="right") - 1
        inside = at + s.least <= bounds[doc + 1]
        at, doc = at[inside], doc[inside]
        cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        rows, short = [], whole_items(symbols, bounds, items)
        for d, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            found = best_tiling(symbols[bounds[d] : bounds[d + 1]], at[a:b] - bounds[d], grams[at[a:b]], items, s) if b > a else None
            if d in short and (not found or (1.0, -short[d][0]) > (found[1] / found[2], -found[0])):
                found = (short[d][0], short[d][1], short[d][1], 1)
            rows.append(found or (None, 0, 0, 0))
        cols = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "n_tokens", "item_id", "covered", "item_tokens", "n_tiles"])


def numbered(docs: DataFrame) -> DataFrame:
    """A written table of docs, so that the number of a row stays the same each time it is read."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def benchmark_overlap(docs: DataFrame, benchmark: DataFrame, setting: Tiling | None = None, row: str | None = None) -> DataFrame:
    """Per row of docs, its best covered item of the benchmark: doc_id, n_tokens, item_id, covered, item_tokens, n_tiles, contaminated.

    item_id is null and counts are 0 where nothing is shared; ties of coverage go to the least item_id. Null and empty texts share
    nothing; items without an id match nothing. An item shorter than a tile matches where all its tokens stand together; one of fewer than SHORTEST tokens
    says nothing of a document and matches nothing. Other columns don't matter; an empty benchmark leaves all
    documents clean, an empty table gives an empty result. row: a column that tells rows apart; it comes back as doc_id. Without one,
    a benchmark of several blocks has the rows numbered in a written table first, as doc_id may be null or repeated.
    """
    s = setting or Tiling()
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-text_bytes(bench) // s.block_bytes))
    if blocks > 1 and row is None:
        rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
        found = benchmark_overlap(rows, bench, s, ROW)
        return rows.select(ROW, "doc_id").join(found.withColumnRenamed("doc_id", ROW), ROW).select("doc_id", *found.columns[1:])
    rows = docs.select(F.col(row or "doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = []
    for k in range(blocks):
        part = bench if blocks == 1 else bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        items = docs.sparkSession.sparkContext.broadcast(prepare([(r[0], r[1]) for r in part.collect()], s.least))  # of block_bytes of text
        found.append(rows.mapInArrow(lambda batches, items=items: search(batches, items.value, s), SCHEMA))
    out = found[0]
    if blocks > 1:
        for x in found[1:]:
            out = out.unionByName(x)
        rank = F.struct((F.col("covered") / F.greatest("item_tokens", F.lit(1))).alias("c"), (-F.col("item_id")).alias("i"))
        out = out.groupBy("doc_id").agg(F.first("n_tokens").alias("n_tokens"), *[F.max_by(c, rank).alias(c) for c in ("item_id", "covered", "item_tokens", "n_tiles")])
    return out.withColumn("contaminated", F.coalesce(100 * F.col("covered") >= s.coverage * F.col("item_tokens"), F.lit(False)) & (F.col("covered") > 0))


def clean_documents(docs: DataFrame, benchmark: DataFrame, setting: Tiling | None = None) -> DataFrame:
    """The documents that no benchmark item covers, with the columns they had.

    Each row is judged by itself; rows without text or id stay, as do all of them where the benchmark is empty. An empty table gives
    an empty result; columns may have any names. A benchmark of one block filters rows where they are read; larger ones need a join by row number.
    """
    s = setting or Tiling()
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    names = docs.columns
    if text_bytes(bench) <= s.block_bytes:
        items = docs.sparkSession.sparkContext.broadcast(prepare([(r[0], r[1]) for r in bench.collect()], s.least))
        plain = docs.select(*[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(names)], F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        own = docs.select(*[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(names)]).schema

        def keep(batches):
            for batch in batches:
                for piece, found in zip(row_pieces([batch]), search([batch], items.value, s), strict=True):
                    covered, size = found.column("covered").to_numpy(), found.column("item_tokens").to_numpy()
                    clean = (100 * covered < s.coverage * size) | (covered == 0)
                    yield piece.select(own.names).filter(pa.array(clean))

        return plain.mapInArrow(keep, own).withColumnsRenamed({f"x{i}": c for i, c in enumerate(names)})
    rows = numbered(docs)
    bad = benchmark_overlap(rows, benchmark, s, ROW).filter("contaminated").select(F.col("doc_id").alias(ROW))
    return rows.join(bad, ROW, "left_anti").select(*[F.col(f"`{c}`") for c in names])
