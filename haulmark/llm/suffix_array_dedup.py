"""Suffix-array dedup by induced sorting (operator 4).

A shard is a bucket of anchors. It holds the text around each candidate run of windows once per part, joined with separators, so that
windows that can be equal meet in one shard. Its suffix array comes from induced sorting, recursive at every size; permuted common
prefixes of neighbours, carried along the text, then tell which windows are equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from haulmark.llm.common import U64, ragged
from haulmark.llm.repeats import Part, Setting, joined, repeats

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary"


def stable_order(keys: np.ndarray, limit: int) -> np.ndarray:
    """Indices that sort small keys stably; 16-bit keys take numpy's radix sort."""
    return np.argsort(keys.astype(np.uint16) if limit <= 1 << 16 else keys, kind="stable")


def classify(text: np.ndarray) -> np.ndarray:
    """S-type suffixes (smaller than the next one); the last symbol, a unique least one, is S-type."""
    n = len(text)
    up = np.zeros(n, np.int8)
    up[:-1] = np.sign(np.diff(text.astype(np.int64)))
    up[-1] = 1
    known = np.where(up != 0, np.arange(n), n - 1)
    return up[np.minimum.accumulate(known[::-1])[::-1]] > 0


def continued(block: np.ndarray, before: np.ndarray) -> np.ndarray:
    """What a bucket induces in itself: each member's suffix one place to the left while the symbol there is the same (before: how often it
    is), all members' first ones first, then all second ones, and so on."""
    n = before[block]
    who = np.repeat(block, n)
    step = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + 1
    return (who - step)[np.argsort(step, kind="stable")]


def induce(text: np.ndarray, small: np.ndarray, order: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in order: larger types from the left, then smaller ones from the right.

    A bucket first continues its own runs of one symbol, then gives to other buckets, each in one step: few numpy calls for each symbol,
    however long its runs.
    """
    n = len(text)
    counts = np.bincount(text, minlength=symbols)
    ends = np.cumsum(counts)
    starts = ends - counts
    place = np.arange(n)
    before = place - np.maximum.accumulate(np.where(np.r_[True, text[1:] != text[:-1]], place, 0))
    out = np.full(n, -1, np.int64)
    of = text[order]
    lms = np.bincount(of, minlength=symbols)
    out[ragged(ends - lms, lms)] = order[stable_order(of, symbols)]
    head = starts.copy()

    def give(block: np.ndarray, larger: bool) -> None:
        """To other buckets: the suffix before each member, where it has the type looked for."""
        block = block[(block > 0) & (before[block] == 0)] - 1
        block = block[small[block] != larger]
        if not len(block):
            return
        keys = text[block]
        by = stable_order(keys, symbols)
        block, keys = block[by], keys[by]
        got = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.append(got, len(keys)))
        rank = np.arange(len(keys)) - np.repeat(got, size)
        if larger:
            out[head[keys] + rank] = block
            head[keys[got]] += size
        else:
            out[tail[keys] - 1 - rank] = block
            tail[keys[got]] -= size

    used = np.flatnonzero(counts)
    for c in used:
        if head[c] > starts[c]:
            own = continued(out[starts[c] : head[c]], before)
            out[head[c] : head[c] + len(own)] = own
            head[c] += len(own)
            give(out[starts[c] : head[c]], True)
        if lms[c]:
            give(out[ends[c] - lms[c] : ends[c]], True)
    large_end = head.copy()
    tail = ends.copy()
    for c in used[::-1]:
        if tail[c] < ends[c]:
            own = continued(out[tail[c] : ends[c]][::-1], before)
            out[tail[c] - len(own) : tail[c]] = own[::-1]
            tail[c] -= len(own)
            give(out[tail[c] : ends[c]][::-1], False)
        give(out[starts[c] : large_end[c]][::-1], False)
    if small[n - 1]:
        out[starts[text[n - 1]]] = n - 1
    return out


def induce_each(text: np.ndarray, small: np.ndarray, order: np.ndarray, symbols: int) -> np.ndarray:
    """induce() for strings of names, whose buckets hold few suffixes: one suffix at a time."""
    n = len(text)
    counts = np.bincount(text, minlength=symbols)
    ends = np.cumsum(counts)
    out = [0] * n  # 0 has nothing before it, so empty places do nothing
    # the symbol before each suffix, if that is of the larger type; and the same for the smaller type; else none
    before = np.r_[-1, text[:-1]]
    kind = np.r_[False, small[:-1]]
    larger, smaller = np.where(kind, -1, before).tolist(), np.where(kind, before, -1).tolist()
    by = order[stable_order(text[order], symbols)]
    of = text[by]
    rank = np.arange(len(by)) - np.searchsorted(of, of)
    for place, x in zip((ends[of] - np.bincount(of, minlength=symbols)[of] + rank).tolist(), by.tolist(), strict=True):
        out[place] = x
    head, tail = (ends - counts).tolist(), ends.tolist()
    for x in out:  # places that are filled on the way come up later
        c = larger[x]
        if c >= 0:
            at = head[c]
            out[at] = x - 1
            head[c] = at + 1
    for x in reversed(out):
        c = smaller[x]
        if c >= 0:
            at = tail[c] - 1
            out[at] = x - 1
            tail[c] = at
    return np.array(out, np.int64)


def name_substrings(text: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """In text order, the rank of each leftmost-smaller substring (from one such position through the next) among the distinct ones.

    Substrings are compared by symbols with their types, as many at a time as a long holds; only ties go on to the next ones. With
    types, none is the beginning of another, so tied ones have one length or go on together.
    """
    n = len(text)
    coded = text.astype(np.int64) * 2 + small + 1
    bits = int(coded.max()).bit_length()
    step = 62 // bits
    length = np.append(np.diff(lms) + 1, 1)
    order = np.arange(len(lms))
    new = np.zeros(len(lms), bool)
    new[0] = True
    group = np.zeros(len(lms), np.int64)
    active, reach = np.arange(len(lms)), 0
    while len(active):
        which = order[active]
        key = np.zeros(len(active), np.int64)
        for k in range(reach, reach + step):
            key = (key << bits) | np.where(k < length[which], coded[np.minimum(lms[which] + k, n - 1)], 0)
        by = np.argsort(key, kind="stable") if reach == 0 else np.lexsort((key, group[active]))
        order[active] = which[by]
        key = key[by]
        new[active[1:]] |= (key[1:] != key[:-1]) | new[active[1:]]
        reach += step
        begins = np.flatnonzero(new)
        group = np.repeat(begins, np.diff(np.append(begins, len(new))))
        size = np.repeat(np.diff(np.append(begins, len(new))), np.diff(np.append(begins, len(new))))[active]
        active = active[(size > 1) & (length[order[active]] > reach)]
    names = np.empty(len(lms), np.int64)
    names[order] = np.cumsum(new) - 1
    return names


def order_names(names: np.ndarray) -> np.ndarray:
    """The suffixes of a string of names in order; the last name is 0 and the only one that small.

    Two suffixes differ at the latest where one has a name that occurs once, so what follows the first such name isn't needed: the
    string that the recursion sorts has the repeated names and the first single one after each stretch of them.
    """
    count = np.bincount(names)
    single = count[names] == 1
    start = np.cumsum(count) - count
    out = np.empty(len(names), np.int64)
    out[start[names[single]]] = np.flatnonzero(single)
    if single.all():
        return out
    keep = ~single
    keep[1:] |= ~single[:-1]
    keep[-1] = True
    at = np.flatnonzero(keep)
    used = np.zeros(len(count), np.int64)
    used[names[at]] = 1
    dense = (np.cumsum(used) - 1)[names[at]]
    inner = at[suffix_array(dense, int(used.sum()))]
    out[np.flatnonzero(np.repeat(count > 1, count))] = inner[~single[inner]]
    return out


def suffix_array(text: np.ndarray, symbols: int, depth: int | None = None) -> np.ndarray:
    """All suffixes in order, by induced sorting. The last symbol is 0 and the only one that small. depth: how much of the order the caller
    needs; the whole order always fulfils it.

    Leftmost-smaller substrings are sorted and named; where names repeat, the string of names is sorted by this same function. It has
    at most half as many symbols, so all levels together are linear. From the order of those suffixes all others are induced.
    """
    put = induce if symbols <= 1024 else induce_each
    small = classify(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    return put(text, small, lms[order_names(name_substrings(text, small, lms))] if len(lms) > 1 else lms, symbols)


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place in the text, the common prefix of its suffix with the one before it in order.

    Where the symbols before the two suffixes are equal, it is the previous place's less one. So only the others are compared,
    four symbols at a time; all the rest is carried on in text order.
    """
    n = len(text)
    phi = np.zeros(n, np.int64)
    phi[order[1:]] = order[:-1]
    before = text[np.maximum(phi - 1, 0)]
    fresh = np.ones(n, bool)
    fresh[1:] = (text[:-1] != before[1:]) | (phi[1:] == 0)
    fresh[order[0]] = True
    wide = np.zeros(n + 4, np.uint16)
    wide[:n] = text
    word = np.ndarray(n + 1, "<u8", wide.tobytes(), strides=(2,))
    common = np.zeros(n, np.int64)
    at = np.flatnonzero(fresh)
    at = at[at != order[0]]
    k = 0
    while len(at):
        other = phi[at]
        x = word[np.minimum(at + k, n)] ^ word[np.minimum(other + k, n)]
        low = x & (~x + U64(1))  # the least set bit tells the first symbol that differs
        same = np.where(x == 0, 4, np.searchsorted(_SYMBOL_BITS, low, side="right") - 1)
        common[at] = k + same
        at = at[x == 0]
        k += 4
    last = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return np.maximum(common[last] - (np.arange(n) - last), 0)


_SYMBOL_BITS = U64(1) << (np.arange(4, dtype=U64) * U64(16))


def shard_repeats(texts: np.ndarray, sizes: np.ndarray, counts: np.ndarray, docs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (entry, start and stop in entry) that also start in an entry of a smaller document."""
    n_text = len(texts) + len(sizes)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.ones(n_text + 1, np.int32)  # separators are 1, bytes from 2
    text[ragged(starts, sizes)] = texts.astype(np.int32) + 2
    text[-1] = 0
    order = suffix_array(text, 258)
    apart = np.cumsum(permuted_common_prefixes(text, order)[order] < window)
    opens = np.zeros(n_text + 1, bool)
    opens[ragged(starts, counts)] = True
    of = opens[order]
    order, apart = order[of], apart[of]
    entry = np.searchsorted(starts, order, side="right") - 1
    new = np.r_[True, apart[1:] != apart[:-1]]
    least = np.minimum.reduceat(docs[entry], np.flatnonzero(new))
    go = docs[entry] > least[np.cumsum(new) - 1]
    return joined(entry[go], order[go] - starts[entry[go]])


def kept(part: Part, covered: np.ndarray) -> dict:
    removed, spans, digests, bodies = [], [], [], []
    for a, b in zip(part.starts, part.ends, strict=True):
        gone = covered[a:b]
        n = int(np.count_nonzero(gone))
        removed.append(n)
        spans.append(int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0]) if n else 0)
        body = (part.buf[a:b][~gone] if n else part.buf[a:b]).tobytes()
        digests.append(hashlib.sha256(body).hexdigest())
        bodies.append(body if n else None)
    return {"n_bytes": pa.array(part.ends - part.starts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "kept_bytes": pa.array(bodies, pa.binary())}


def suffix_array_dedup(docs: DataFrame, setting: Setting | None = None) -> DataFrame:
    """Remove each byte covered by a 50-byte string that also starts in a document with a smaller doc_id.

    Returns per row of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and kept_bytes (the bytes
    left; null where nothing was removed). Null and empty texts have no bytes. Rows with equal doc_id don't remove each other's
    bytes; a null doc_id counts as larger than all others. Other columns of docs don't matter; an empty table gives an empty result.
    """
    s = setting or Setting("bytes")
    return repeats(docs, s, lambda *a: shard_repeats(*a, s.window), kept, SCHEMA)
