"""Substring dedup by prefix-partitioned suffix trees (operator 7).

A candidate window of 50 words holds an anchor: the 25 words in it whose hash is least. Suffixes are dealt by a prefix from the anchor
on: its 25 words, or all 50 of the window where the 25 are so common that a group would outgrow memory. What goes to a group is the
text of each run of windows, once per part. In a group, suffixes are split again by prefixes, one word and as many more as it takes,
into subtrees of bounded size. A subtree is its suffixes in the order of their words with the common prefixes of neighbours; its
internal nodes are the intervals of common prefixes. Nodes of 50 words and more are repeats; one that no node a word to the left
continues is maximal, and the leaves under it that belong to other than the least document lose the words that it spells.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from haulmark.llm.common import hash_words, ragged, word_spans
from haulmark.llm.repeats import Part, Setting, repeats

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def word_ids(buf: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A number from 1 for each distinct word. Words that hash alike are compared by their bytes."""
    hashed = hash_words(buf, first, last)
    _, at, ids = np.unique(hashed, return_index=True, return_inverse=True)
    size = last - first
    head = at[ids]
    same = size[head] == size
    block = 1 << 18
    for a in range(0, len(ids), block):
        pick = a + np.flatnonzero(same[a : a + block])
        unlike = buf[ragged(first[pick], size[pick])] != buf[ragged(first[head[pick]], size[pick])]
        same[pick] = np.add.reduceat(unlike, np.cumsum(size[pick]) - size[pick], dtype=np.int64) == 0 if len(pick) else True
    if same.all():
        return ids + 1
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(buf[x:y].tobytes(), len(known) + 1) for x, y in zip(first, last, strict=True)), np.int64, len(first))


def prefix_groups(ids: np.ndarray, at: np.ndarray, limit: int, window: int) -> list[np.ndarray]:
    """Suffixes split by the words that they begin with: by one word, then by one more where over limit of them begin alike, up to
    window words. Small neighbours share a group."""
    out, todo = [], [(at, 0)]
    while todo:
        at, depth = todo.pop()
        if len(at) <= limit or depth == window:
            out.append(at)
            continue
        by = np.argsort(ids[at + depth], kind="stable")
        at = at[by]
        begins = np.flatnonzero(np.r_[True, np.diff(ids[at + depth]) != 0])
        size = np.diff(np.append(begins, len(at)))
        large = size > limit
        todo += [(at[x : x + n], depth + 1) for x, n in zip(begins[large].tolist(), size[large].tolist(), strict=True)]
        filled = np.cumsum(size[~large])
        cuts = np.searchsorted(filled, np.arange(limit, int(filled[-1]) + limit, limit), side="right") if len(filled) else []
        rest = at[np.repeat(~large, size)]
        out += [x for x in np.split(rest, filled[np.unique(cuts[:-1]) - 1] if len(cuts) > 1 and cuts[0] else []) if len(x)]
    return out


def subtree(ids: np.ndarray, at: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first width words, and the words that each shares with the one before it."""
    length = np.minimum(ends - at, width)
    words = np.zeros((len(at), width), ">u2" if int(ids.max()) < 1 << 16 else ">u4")
    for k in range(width):
        reach = np.flatnonzero(length > k)
        words[reach, k] = ids[at[reach] + k]
    order = np.argsort(words.view(f"S{words.dtype.itemsize * width}").ravel(), kind="stable")
    length = length[order]
    common = np.zeros(len(at), np.int64)
    block = 1 << 14
    for a in range(1, len(order), block):
        x, y = words[order[a : a + block]], words[order[a - 1 : a - 1 + block]][: len(order[a : a + block])]
        differs = x != y
        k = differs.argmax(axis=1)
        k[~differs[np.arange(len(k)), k]] = width
        common[a : a + block] = np.minimum(k, np.minimum(length[a : a + block], length[a - 1 : a - 1 + block][: len(k)]))
    return order, common


def covered_leaves(common: np.ndarray, docs: np.ndarray, window: int) -> np.ndarray:
    """For each leaf, the depth of its deepest internal node that a smaller document shares; 0 if none of window words or more is.

    The internal nodes of a depth are the stretches of leaves whose common prefixes don't fall below it.
    """
    reach = np.zeros(len(docs), np.int64)
    for depth in np.unique(common[common >= window]).tolist():
        opens = common < depth
        least = np.minimum.reduceat(docs, np.flatnonzero(opens))
        reach[docs > least[np.cumsum(opens) - 1]] = depth
    return reach


def tree_repeats(texts: np.ndarray, sizes: np.ndarray, counts: np.ndarray, docs: np.ndarray, window: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (entry, start and stop in entry) that also start in an entry of a smaller document, as maximal repeats."""
    offsets = np.r_[0, np.cumsum(sizes)]
    ids = word_ids(texts, *word_spans(texts, offsets))
    ends = np.cumsum(counts + window - 1)
    starts = ends - (counts + window - 1)
    leaves = ragged(starts, counts)
    reach = np.zeros(len(ids) + 1, np.int64)
    for at in prefix_groups(ids, leaves, limit, window):
        entry = np.searchsorted(ends, at, side="right")
        order, common = subtree(ids, at, ends[entry], window + window // 2)
        reach[at[order]] = covered_leaves(common, docs[entry[order]], window)
    at = np.flatnonzero(reach[:-1])
    at = at[(at == 0) | (reach[at - 1] <= reach[at])]  # others continue the repeat that begins a word before
    entry = np.searchsorted(ends, at, side="right")
    return entry, at - starts[entry], at - starts[entry] + reach[at] - window + 1


def kept(part: Part, covered: np.ndarray, texts_too: bool) -> dict:
    given = part.table["text"].to_pylist() if texts_too else None
    first, last = part.words
    n_removed, digests, texts = [], [], []
    sums = np.concatenate([[0], np.cumsum(covered)])
    whole = part.buf.tobytes()
    for i, (a, b) in enumerate(zip(part.starts, part.ends, strict=True)):
        gone = int(sums[b] - sums[a])
        n_removed.append(gone)
        if gone:
            at = a + np.flatnonzero(~covered[a:b])
            body = b" ".join([whole[x:y] for x, y in zip(first[at], last[at], strict=True)])
            texts.append(body.decode())
        else:
            body = b" ".join(whole[first[a] : last[b - 1]].split()) if b > a else b""
            texts.append(given[i] if given else None)
        digests.append(hashlib.sha256(body).hexdigest())
    return {"n_words": pa.array(part.ends - part.starts, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "kept_text": pa.array(texts, pa.string())}


def substring_dedup(docs: DataFrame, setting: Setting | None = None, group_suffixes: int = 1 << 16, texts: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove each word covered by a 50-word window that also starts in a document with a smaller doc_id.

    Returns per row of docs: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) and kept_text (null
    where nothing was removed). Null and empty texts have no words. Rows with equal doc_id don't remove each other's words; a null
    doc_id counts as larger than all others. Other columns of docs don't matter. An empty table gives an empty result.
    group_suffixes: suffixes that a subtree may hold before its prefix gets longer.
    texts: give kept_text of every row, the text itself where nothing was removed. carry: columns of docs to give back too.
    """
    s = setting or Setting("words")
    return repeats(docs, s, lambda *a: tree_repeats(*a, s.window, group_suffixes), lambda part, covered: kept(part, covered, texts), SCHEMA, carry)
