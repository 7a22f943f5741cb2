"""What the two exact-repeat operators share: finding the windows that can occur in more than one document.

A window is 50 symbols (bytes or words) of one document. Its anchor is the least hashed 25-gram in it, so equal
windows have equal anchors. Documents lie in parts of bounded size (hash of doc_id); a part sends each of its distinct
anchors once, in 4 bytes, to the anchor's bucket, and gets back those that occur in several documents. Only windows
with such an anchor go on; the operators then decide on the symbols themselves. Nothing is dropped that can repeat.

Plan of both operators (D is one exchange of the texts by part, which Spark reuses):
D -> anchors -> bucket -> D with repeated anchors -> candidate windows -> group (suffix work) -> D with removed spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import BYTE_SYMBOLS, U64, gram_hashes, hash_words, mix64, prefix_sums, ragged, span_hashes, text_buffer, text_bytes, word_spans

#: A missing doc_id counts as larger than any other.
NO_ID = np.iinfo(np.int64).max
_BLOCK = 1 << 16


@dataclass(frozen=True)
class Setting:
    """window: length of a repeat. gram: length of an anchor. part_bytes: text in a part. hot_parts: an anchor in so many parts
    is dealt by more symbols."""

    unit: str = "words"
    window: int = 50
    gram: int = 25
    part_bytes: int = 4 << 20
    hot_parts: int = 4096


@dataclass
class Part:
    """The documents of a part, in an order that depends on their rows alone. ends[i]: the end of document i's symbols."""

    ids: np.ndarray
    given: pa.ChunkedArray
    buf: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    words: tuple[np.ndarray, np.ndarray] | None
    symbols: Callable[[int, int], np.ndarray]
    n: int
    table: pa.Table


def load(table: pa.Table, s: Setting) -> Part:
    if table.num_rows > 1:
        table = table.sort_by([("doc_id", "ascending")])
        ids = table["doc_id"].to_numpy(zero_copy_only=False)
        if len(np.unique(ids)) < len(ids):
            table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    ids = table["doc_id"].combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
    buf, offsets = text_buffer(table["text"])
    if s.unit == "bytes":
        return Part(ids, table["doc_id"], buf, offsets, offsets[:-1], offsets[1:], None, lambda a, b: BYTE_SYMBOLS[buf[a:b]], len(buf), table)
    first, last = word_spans(buf, offsets)
    hashed = hash_words(buf, first, last)
    bounds = np.searchsorted(first, offsets)
    return Part(ids, table["doc_id"], buf, offsets, bounds[:-1], bounds[1:], (first, last), lambda a, b: hashed[a:b], len(first), table)


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[: len(h) - (width - step)], h[width - step :]) if step < width else h


def runs(part: Part, s: Setting) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows in runs of one document and one anchor: first window, number of windows, anchor."""
    marks = np.zeros(part.n + 1, np.int32)
    full = part.ends - part.starts >= s.window
    np.add.at(marks, part.starts[full], 1)
    np.add.at(marks, part.ends[full] - s.window + 1, -1)
    valid = np.cumsum(marks[:-1], dtype=np.int32) > 0
    opens = np.zeros(part.n + 1, bool)
    opens[part.starts[full]] = True
    firsts, values, stops = [], [], []
    for a in range(0, part.n - s.window + 1, _BLOCK):
        b = min(a + _BLOCK, part.n - s.window + 1)
        ok = valid[a:b]
        if not ok.any():
            continue
        least = sliding_least(gram_hashes(part.symbols(a, b + s.window - 1), s.gram), s.window - s.gram + 1)
        change = np.ones(b - a + 1, bool)
        change[1:-1] = (least[1:] != least[:-1]) | (ok[1:] != ok[:-1]) | opens[a + 1 : b]
        at = np.flatnonzero(change)
        keep = ok[at[:-1]]
        firsts.append(at[:-1][keep] + a)
        stops.append(at[1:][keep] + a)
        values.append(least[at[:-1][keep]])
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    first = np.concatenate(firsts)
    return first, np.concatenate(stops) - first, mix64(np.concatenate(values) ^ U64(0xA5A5A5A5A5A5A5A5))


def bucket_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor >> U64(32)) * U64(buckets)) >> U64(32)


ANCHORS = "bucket int, part int, single binary, several binary"


def send_anchors(part_no: int, part: Part, s: Setting, buckets: int) -> pa.Table:
    """Each distinct anchor of the part once: single if one document has it, several if more have it."""
    first, _, anchor = runs(part, s)
    doc = np.searchsorted(part.ends, first, side="right")
    order = np.lexsort((doc, anchor))
    anchor, doc = anchor[order], doc[order]
    new = np.ones(len(anchor), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(anchor)) - 1
    several = part.ids[doc[last]] != part.ids[doc[at]] if len(at) else np.zeros(0, bool)
    value = anchor[at]
    bucket = bucket_of(value, buckets)
    low = value.astype(np.uint32)
    cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=U64))
    full = np.flatnonzero(cut[1:] > cut[:-1])
    parts = [(low[cut[b] : cut[b + 1]], several[cut[b] : cut[b + 1]]) for b in full]
    return pa.table({
        "bucket": pa.array(full, pa.int32()), "part": pa.array(np.full(len(full), part_no), pa.int32()),
        "single": pa.array([x[~m].tobytes() for x, m in parts], pa.binary()), "several": pa.array([x[m].tobytes() for x, m in parts], pa.binary()),
    })


REPEATED = "part int, bucket int, repeated binary, hot binary"


def repeated_anchors(table: pa.Table, s: Setting) -> pa.Table:
    """For one bucket: to each part those of its anchors that occur in another document too. One sort of all that the bucket got."""
    bucket = table["bucket"][0].as_py()
    sent = [np.frombuffer(x, np.uint32) for pair in zip(table["single"].to_pylist(), table["several"].to_pylist(), strict=True) for x in pair]
    values = np.concatenate(sent)
    row = np.repeat(np.arange(len(sent), dtype=np.int32), [len(x) for x in sent])
    order = np.argsort(values, kind="stable")
    at = np.flatnonzero(np.r_[True, values[order[1:]] != values[order[:-1]]]) if len(order) else np.zeros(0, np.int64)
    size = np.diff(np.append(at, len(order)))
    count = np.empty(len(order), np.int64)
    count[order] = np.repeat(size, size)
    keep, hot = (count > 1) | (row % 2 == 1), count >= s.hot_parts
    out = []
    for kind in (keep & ~hot, keep & hot):
        at = np.flatnonzero(kind)
        cuts = np.searchsorted(row[at] // 2, np.arange(table.num_rows + 1))
        out.append([values[at[a:b]].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])
    full = np.array([bool(x or y) for x, y in zip(*out, strict=True)], bool)
    found = pa.table({"part": table["part"].cast(pa.int32()), "bucket": pa.array(np.full(table.num_rows, bucket), pa.int32()), "repeated": pa.array(out[0], pa.binary()), "hot": pa.array(out[1], pa.binary())})
    return found.filter(pa.array(full))


def candidates(part: Part, found: pa.Table, s: Setting, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows whose anchor is repeated: first window, number of windows, anchor, document, whether it's hot."""
    first, count, anchor = runs(part, s)
    key = (bucket_of(anchor, buckets) << U64(32)) | (anchor & U64(0xFFFFFFFF))

    def known(column: str) -> np.ndarray:
        sets = [np.frombuffer(x, np.uint32).astype(U64) | U64(b << 32) for b, x in zip(found["bucket"].to_pylist(), found[column].to_pylist(), strict=True)]
        return np.isin(key, np.concatenate(sets)) if sets else np.zeros(len(key), bool)

    hot = known("hot")
    at = np.flatnonzero(known("repeated") | hot)
    return first[at], count[at], anchor[at], np.searchsorted(part.ends, first[at], side="right"), hot[at]


def flags(part: Part, found: pa.Table, width: int) -> np.ndarray:
    """Which symbols of the part are covered by removed windows; found: row, first and stop of window starts, in binary columns."""
    marks = np.zeros(part.n + 1, np.int32)
    for rows, starts, stops in zip(found["rows"].to_pylist(), found["starts"].to_pylist(), found["stops"].to_pylist(), strict=True):
        base = part.starts[np.frombuffer(rows, np.int32)]
        np.add.at(marks, base + np.frombuffer(starts, np.int64), 1)
        np.add.at(marks, base + np.frombuffer(stops, np.int64) + width - 1, -1)
    return np.cumsum(marks[:-1], dtype=np.int32) > 0


def joined(rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Single window starts, as (row, first, stop) of consecutive ones."""
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (starts[1:] > starts[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(rows)) - 1 if len(rows) else at
    return rows[at].astype(np.int32), starts[at].astype(np.int64), starts[last].astype(np.int64) + 1


#: From candidate work to groups, and from groups to parts: kind 0 is work for the group, kind 1 what is known to go.
WORK = "grp long, part int, kind int, n long, rows binary, docs binary, starts binary, stops binary, body binary"
GONE = "part int, rows binary, starts binary, stops binary"


def work_table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5)
    names = ("grp", "part", "kind", "n", "rows", "docs", "starts", "stops", "body")
    cols = list(zip(*rows, strict=True)) or [[]] * 9
    return pa.table({name: pa.array(col, kind) for name, col, kind in zip(names, cols, kinds, strict=True)})


def gone_table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.table({"part": pa.array(cols[0], pa.int32()), **{name: pa.array(col, pa.binary()) for name, col in zip(("rows", "starts", "stops"), cols[1:], strict=True)}})


def in_parts(docs: DataFrame, s: Setting, carry: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    parts = max(12, -(-text_bytes(docs) // s.part_bytes))
    more = [F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(carry)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more, F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("part")), parts


def repeats(docs: DataFrame, s: Setting, find: Callable, result: Callable[[Part, np.ndarray], dict], schema: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """find: as in settle(). result: a part and its covered symbols -> columns.

    carry: columns of docs that come back beside the result.
    """
    d, parts = in_parts(docs, s, carry)
    buckets = parts

    def first_pass(table: pa.Table) -> pa.Table:
        return send_anchors(table["part"][0].as_py(), load(table, s), s, buckets)

    def second_pass(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return work_table([])
        part = load(left, s)
        return work_table(snippets(left["part"][0].as_py(), part, *candidates(part, right, s, buckets), buckets=buckets, s=s))

    def last_pass(left: pa.Table, right: pa.Table) -> pa.Table:
        part = load(left, s)
        covered = flags(part, right, s.window) if right.num_rows else np.zeros(part.n, bool)
        return pa.table({"doc_id": part.given, **result(part, covered), **{f"x{i}": part.table[f"x{i}"] for i in range(len(carry))}})

    found = d.groupBy("part").applyInArrow(first_pass, ANCHORS).groupBy("bucket").applyInArrow(lambda t: repeated_anchors(t, s), REPEATED)
    work = d.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(second_pass, WORK)
    gone = work.groupBy("grp").applyInArrow(lambda t: settle(t, find), GONE)
    types = dict(docs.dtypes)
    out = d.groupBy("part").cogroup(gone.groupBy("part")).applyInArrow(last_pass, schema + "".join(f", x{i} {types[c]}" for i, c in enumerate(carry)))
    return out.withColumnsRenamed({f"x{i}": c for i, c in enumerate(carry)})


def spans_of(part: Part, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of runs of symbols, one after the other as they stand in the texts, and the number of each run's bytes."""
    if part.words is None:
        return part.buf[ragged(starts, lengths)], lengths
    first, last = part.words[0][starts], part.words[1][starts + lengths - 1]
    return part.buf[ragged(first, last - first)], last - first


def same_symbols(part: Part, a: np.ndarray, b: np.ndarray, lengths: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Whether the runs of symbols at a and b are the same, by their bytes."""
    out = np.ones(len(a), bool)
    cuts = np.searchsorted(np.cumsum(lengths), np.arange(0, int(lengths.sum()) + block, block))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if i == j:
            continue
        x, y = ragged(a[i:j], lengths[i:j]), ragged(b[i:j], lengths[i:j])
        at = np.cumsum(lengths[i:j]) - lengths[i:j]
        if part.words is None:
            differ = part.buf[x] != part.buf[y]
        else:
            size = part.words[1][x] - part.words[0][x]
            differ = size != part.words[1][y] - part.words[0][y]
            alike = np.flatnonzero(~differ)
            unlike = part.buf[ragged(part.words[0][x[alike]], size[alike])] != part.buf[ragged(part.words[0][y[alike]], size[alike])]
            differ[alike] = np.add.reduceat(unlike, np.cumsum(size[alike]) - size[alike], dtype=np.int64) > 0 if len(alike) else False
        out[i:j] = np.add.reduceat(differ, at, dtype=np.int64) == 0
    return out


def local_repeats(part: Part, first: np.ndarray, lengths: np.ndarray, hashed: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal runs of a part: (those of the least document, which go on; those of larger ones, which are known to go)."""
    order = np.lexsort((ids, hashed, lengths))
    new = np.ones(len(order), bool)
    new[1:] = (hashed[order][1:] != hashed[order][:-1]) | (lengths[order][1:] != lengths[order][:-1])
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
    goes = ids[order] != ids[head]
    at = np.flatnonzero(goes)
    goes[at] = same_symbols(part, first[order[at]], first[head[at]], lengths[order[at]])
    return order[~goes], order[goes]


def wider_runs(part: Part, first: np.ndarray, count: np.ndarray, anchor: np.ndarray, doc: np.ndarray, s: Setting) -> tuple[np.ndarray, ...]:
    """Runs of hot anchors split in two and dealt by half as many symbols more: first window, number of windows, key, document.

    A window has its anchor (the leftmost, where it repeats) and as many symbols again around it, so half of these lie on one side: on the
    right where they fit there, else on the left. The key is the anchor with them, which depends on the window alone.
    """
    extra = (s.window - s.gram + 1) // 2
    out: list[tuple] = []
    block = 1 << 16
    for i, j in zip(*bounded(count, block), strict=True):
        at = ragged(first[i:j], count[i:j])
        of = np.repeat(np.arange(i, j), count[i:j])
        lo, hi = int(at.min()), int(at.max()) + s.window
        symbols = part.symbols(lo, hi)
        grams = mix64(gram_hashes(symbols, s.gram) ^ U64(0xA5A5A5A5A5A5A5A5))
        wide = gram_hashes(symbols, s.gram + extra)
        offset = np.zeros(len(at), np.int64)
        for k in range(s.window - s.gram, -1, -1):
            offset[grams[at - lo + k] == anchor[of]] = k
        right = offset <= s.window - s.gram - extra
        key = mix64(wide[at - lo + offset - np.where(right, 0, extra)] + right.astype(U64))
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])])
        out.append((at[new], np.diff(np.append(new, len(at))), key[new], doc[of[new]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def bounded(sizes: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Stretches of entries with about most in total, or one entry: where each begins and ends."""
    total = np.cumsum(sizes)
    cuts = [0]
    while cuts[-1] < len(sizes):
        done = int(total[cuts[-1] - 1]) if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(total, done + most, side="right"))))
    return cuts[:-1], cuts[1:]


def snippets(part_no: int, part: Part, first, count, anchor, doc, hot, *, buckets: int, s: Setting) -> list[tuple]:
    """The text of each run of windows, once for the part, dealt by its anchor: the gram that all windows of the run hold.

    Equal windows have equal anchors, so they meet in one group. Anchors in very many parts are dealt by more symbols (wider_runs).
    """
    key = anchor
    if hot.any():
        more = wider_runs(part, first[hot], count[hot], anchor[hot], doc[hot], s)
        first, count, key, doc = (np.concatenate([x[~hot], y]) for x, y in zip((first, count, anchor, doc), more, strict=True))
    if not len(first):
        return []
    length = count + s.window - 1
    stop = first + length
    hashed = np.empty(len(first), U64)
    by_first = np.argsort(first, kind="stable")
    cuts = np.searchsorted(first[by_first], np.arange(0, part.n + (1 << 18), 1 << 18))
    for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):  # in blocks, as sums of a whole part would take eight times its text
        at, a = by_first[i:j], k << 18
        if len(at):
            hashed[at] = span_hashes(prefix_sums(part.symbols(a, int(stop[at].max()))), first[at] - a, stop[at] - a)
    stay, go = local_repeats(part, first, length, hashed, part.ids[doc])
    where = bucket_of(key, buckets).astype(np.int64)
    stay = stay[np.argsort(where[stay], kind="stable")]
    rel = first - part.starts[doc]
    squeeze = zstandard.ZstdCompressor(level=3).compress
    out = []
    for sel in np.split(stay, np.flatnonzero(np.diff(where[stay])) + 1):
        body, size = spans_of(part, first[sel], length[sel])
        out.append((int(where[sel[0]]), part_no, 0, len(sel), doc[sel].astype(np.int32).tobytes(), part.ids[doc[sel]].tobytes(), rel[sel].tobytes(), (rel[sel] + count[sel]).tobytes(), squeeze(size.astype(np.int32).tobytes() + body.tobytes())))
    if len(go):
        out.append((part_no % buckets, part_no, 1, 0, doc[go].astype(np.int32).tobytes(), b"", rel[go].tobytes(), (rel[go] + count[go]).tobytes(), b""))
    return out


def settle(table: pa.Table, find: Callable) -> pa.Table:
    """A group's windows that go. find: (bytes, bytes of each entry, windows of each entry, documents) -> entry, first window and stop of those
    that a smaller document has too."""
    out = [(p, r, a, b) for p, k, r, a, b in zip(*(table[c].to_pylist() for c in ("part", "kind", "rows", "starts", "stops")), strict=True) if k]
    work = table.filter(pc.equal(table["kind"], 0))
    if not work.num_rows:
        return gone_table(out)
    rows, docs, starts, stops = (np.concatenate(list(each(work, c, k))) for c, k in (("rows", np.int32), ("docs", np.int64), ("starts", np.int64), ("stops", np.int64)))
    part = np.repeat(work["part"].to_numpy(), work["n"].to_numpy())
    plain = zstandard.ZstdDecompressor().decompress
    bodies = [plain(x) for x in work["body"].to_pylist()]
    sizes = work["n"].to_pylist()
    size = np.concatenate([np.frombuffer(x, np.int32, n) for x, n in zip(bodies, sizes, strict=True)]).astype(np.int64)
    whole = b"".join(memoryview(x)[4 * n :] for x, n in zip(bodies, sizes, strict=True))
    del bodies
    body = np.frombuffer(whole, np.uint8)
    at = np.cumsum(size) - size
    # equal entries of several parts: only the least document's go on
    keys = [whole[a : a + n] for a, n in zip(at.tolist(), size.tolist(), strict=True)]
    least: dict[bytes, int] = {}
    head = np.fromiter((least.setdefault(key, i) for i, key in enumerate(keys)), np.int64, len(keys))
    del keys, least
    by = np.lexsort((docs, head))
    best = by[np.flatnonzero(np.r_[True, head[by][1:] != head[by][:-1]])]
    to_best = np.empty(len(head), np.int64)
    to_best[head[best]] = best
    head = to_best[head]
    chosen = np.sort(best)
    smaller = docs > docs[head]
    entry, start, stop = find(body[ragged(at[chosen], size[chosen])], size[chosen], (stops - starts)[chosen], docs[chosen])
    # what goes of a chosen entry goes of all its copies in the same document too
    gone_rows, gone_starts, gone_stops, gone_part = [rows[smaller]], [starts[smaller]], [stops[smaller]], [part[smaller]]
    if len(entry):
        by = np.argsort(entry, kind="stable")
        r, a, b = entry[by], start[by], stop[by]
        same = np.flatnonzero(~smaller)
        slot = np.searchsorted(chosen, head[same])
        lo, hi = np.searchsorted(r, slot, side="left"), np.searchsorted(r, slot, side="right")
        pick, src = ragged(lo, hi - lo), np.repeat(same, hi - lo)
        gone_rows.append(rows[src])
        gone_starts.append(starts[src] + a[pick])
        gone_stops.append(starts[src] + b[pick])
        gone_part.append(part[src])
    rows, starts, stops, part = (np.concatenate(x) for x in (gone_rows, gone_starts, gone_stops, gone_part))
    order = np.argsort(part, kind="stable")
    for sel in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []:
        out.append((int(part[sel[0]]), rows[sel].tobytes(), starts[sel].tobytes(), stops[sel].tobytes()))
    return gone_table(out)


def each(table: pa.Table, column: str, kind: type) -> Iterator[np.ndarray]:
    for x in table[column].to_pylist():
        yield np.frombuffer(x, kind)
