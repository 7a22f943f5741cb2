"""MinHash near-dedup with b-bit signatures (operator 5).

One pass over the texts takes each document's distinct 5-word shingles, its 128 minima, a band key for each four of them, the low
four bits of all minima packed into eight longs, and the text in zstd. Documents with the same shingle set form a class, and only its
least doc_id goes on. Classes that share a band key are candidates. A pair whose bit counts, corrected for chance collisions, leave
room for the similarity is confirmed on the full shingle sets. Pairs come first from pivots: a bucket's members against one of them, in
rounds with other pivots while these still connect something, and only between what isn't connected yet, so a large group of near copies
makes rows by its members, not by its pairs. Buckets that still hold several components are then compared in full, in pairs of blocks. Where a bucket has several blocks, rows without texts come together first, and
only documents in a pair that signatures leave open take their text to that pair of blocks. Texts give the links that connect components,
a forest. No link is lost on the way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import BYTE_SYMBOLS, U64, checkpoint, gram_hashes, hash_words, mix64, ragged, row_pieces, text_buffer, word_spans, written
from haulmark.llm.components import connected_components

_LOWER = BYTE_SYMBOLS.copy()
_LOWER[65:91] = BYTE_SYMBOLS[97:123]
SIGNED = "id long, n_shingles long, set_a long, set_b long, bands array<long>, " + ", ".join(f"s{i} long" for i in range(8)) + ", body binary"


@dataclass(frozen=True)
class MinHash:
    """rounds: of pivots, at most. block: documents in a block.
    similarity: in hundredths. slack: how far an estimate may lie under it; six standard errors of 128 four-bit minima."""

    words: int = 5
    similarity: int = 75
    hashes: int = 128
    band: int = 4
    bits: int = 4
    slack: float = 0.24
    rounds: int = 4
    block: int = 2048


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer than k words, the whole sequence is one shingle."""
    first, last = word_spans(buf, offsets)
    hashed = hash_words(buf, first, last, _LOWER)
    grams = gram_hashes(hashed, k)
    bounds = np.searchsorted(first, offsets).tolist()
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(mix64(gram_hashes(hashed[a:b], b - a) + U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def minima(found: np.ndarray, m: MinHash, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    x = (found >> U64(32)).astype(np.uint32) ^ found.astype(np.uint32)
    least = np.full(m.hashes, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 1024):
        y = x[a : a + 1024, None] * factors
        y += shifts
        np.minimum(least, y.min(axis=0), out=least)
    return least


def sign(batches, m: MinHash):
    import zstandard

    r = np.random.RandomState(7)
    factors = (r.randint(0, 1 << 31, m.hashes).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
    shifts = r.randint(0, 1 << 31, m.hashes).astype(np.uint32)
    per_long = 64 // m.bits
    places = np.arange(per_long, dtype=U64) * U64(m.bits)
    squeeze = zstandard.ZstdCompressor(level=1)
    n_bands = m.hashes // m.band
    band_no = mix64(np.arange(1, n_bands + 1, dtype=U64))
    for batch in row_pieces(batches):
        buf, offsets = text_buffer(batch.column("text"))
        sets = shingle_sets(buf, offsets, m.words)
        n = len(sets)
        least = np.zeros((n, m.hashes), np.uint32)
        ids = np.zeros((n, 2), U64)
        for i, found in enumerate(sets):
            if len(found):
                least[i] = minima(found, m, factors, shifts)
                ids[i] = mix64(found).sum(), mix64(found ^ U64(0x5555555555555555)).sum()
        wide = least.astype(U64).reshape(n, n_bands, m.band)
        keys = np.zeros((n, n_bands), U64)
        for k in range(m.band):
            keys = mix64(keys * U64(31) + wide[:, :, k] + U64(1))
        keys = mix64(keys ^ band_no)
        low = (mix64(least.astype(U64)) & U64((1 << m.bits) - 1)).reshape(n, 8, per_long)
        packed = (low << places).sum(axis=2, dtype=U64)
        size = np.array([len(x) for x in sets], np.int64)
        keep = np.repeat(size > 0, n_bands)
        bands = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(size > 0, n_bands, 0))].astype(np.int32)), pa.array(keys.ravel()[keep].view(np.int64)))
        whole = buf.tobytes()
        body = [squeeze.compress(whole[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(size), pa.array(ids[:, 0].copy().view(np.int64)), pa.array(ids[:, 1].copy().view(np.int64)), bands, *[pa.array(packed[:, i].copy().view(np.int64)) for i in range(8)], pa.array(body, pa.binary())],
            names=["id", "n_shingles", "set_a", "set_b", "bands", *[f"s{i}" for i in range(8)], "body"],
        )


def estimate(bits: int, hashes: int) -> Column:
    """Similarity from the bit counts of two packed signatures (a.s0.., b.s0..), corrected for chance collisions of low bits."""
    lows = sum(1 << i for i in range(0, 64, bits))
    lows = lows - (1 << 64) if lows >= 1 << 63 else lows
    differ = F.lit(0)
    for i in range(8):
        x = F.col(f"a.s{i}").bitwiseXOR(F.col(f"b.s{i}"))
        any_bit = x
        for k in range(1, bits):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, k))
        differ = differ + F.bit_count(any_bit.bitwiseAND(F.lit(lows)))
    chance = 1 / (1 << bits)
    return ((1 - differ / hashes) - chance) / (1 - chance)


def confirm(batches, m: MinHash):
    """Pairs whose full shingle sets are similar enough."""
    import zstandard

    plain = zstandard.ZstdDecompressor()

    def found(body: bytes, known: dict) -> np.ndarray:
        if body not in known:
            if len(known) > 64:
                known.clear()
            text = np.frombuffer(plain.decompress(body), np.uint8)
            known[body] = shingle_sets(text, np.array([0, len(text)]), m.words)[0]
        return known[body]

    pivots: dict[bytes, np.ndarray] = {}
    members: dict[bytes, np.ndarray] = {}
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            p, q = found(x.as_py(), members), found(y.as_py(), pivots)
            small = min(len(p), len(q))
            if 100 * small < m.similarity * max(len(p), len(q)):
                keep.append(False)
                continue
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * both >= m.similarity * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def confirmed(pairs: DataFrame, signed: DataFrame, m: MinHash) -> DataFrame:
    sigs = signed.select("id", "n_shingles", *[f"s{i}" for i in range(8)])
    near = (
        pairs.alias("p").join(sigs.alias("a"), F.col("p.a") == F.col("a.id")).join(sigs.alias("b"), F.col("p.b") == F.col("b.id"))
        .filter(estimate(m.bits, m.hashes) >= m.similarity / 100 - m.slack)
        .filter(F.expr(f"100 * least(a.n_shingles, b.n_shingles) >= {m.similarity} * greatest(a.n_shingles, b.n_shingles)"))
        .select("p.a", "p.b")
    )
    body = signed.select("id", "body")
    full = near.join(body.select(F.col("id").alias("a"), F.col("body").alias("x")), "a").join(body.select(F.col("id").alias("b"), F.col("body").alias("y")), "b")
    return full.select("a", "b", "x", "y").mapInArrow(lambda batches: confirm(batches, m), "a long, b long")


def may_link(sig: np.ndarray, size: np.ndarray, i: int, right: np.ndarray, m: MinHash) -> np.ndarray:
    """Which of right may be similar enough to i, by their bit counts corrected for chance, and by the sizes of their sets."""
    chance = 1 / (1 << m.bits)
    most = int((1 - chance) * (1 - (m.similarity / 100 - m.slack)) * m.hashes)
    lows = U64(sum(1 << k for k in range(0, 64, m.bits)))
    x = sig[right] ^ sig[i]
    y = x.copy()
    for k in range(1, m.bits):
        y |= x >> U64(k)
    near = np.bitwise_count(y & lows).sum(axis=1) <= most
    return near & (100 * np.minimum(size[right], size[i]) >= m.similarity * np.maximum(size[right], size[i]))


def block_open(table: pa.Table, m: MinHash) -> pa.Table:
    """Documents of one block of a bucket with another (or itself) that are in a pair which signatures leave open."""
    ids, label, side, size = (table[c].to_numpy() for c in ("id", "label", "block", "n_shingles"))
    sig = np.stack([table[f"s{i}"].to_numpy().view(U64) for i in range(8)], axis=1)
    key, lo, hi = (table[c][0].as_py() for c in ("key", "lo", "hi"))
    left, right = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
    is_open = np.zeros(len(ids), bool)
    for i in left.tolist():
        other = right[(label[right] != label[i]) & ((ids[right] > ids[i]) | (lo != hi))]
        hit = other[may_link(sig, size, i, other, m)] if len(other) else other
        if len(hit):
            is_open[i] = is_open[hit] = True
    found = ids[is_open]
    return pa.table({"id": pa.array(found), "key": pa.array(np.full(len(found), key, np.int64)), "lo": pa.array(np.full(len(found), lo, np.int32)), "hi": pa.array(np.full(len(found), hi, np.int32))})


def block_links(table: pa.Table, m: MinHash) -> pa.Table:
    """Confirmed links of one block of a bucket with another (or itself) that connect its components: a forest, not all pairs.

    For each document of the first block, those of the second whose component differs and whose signature may be similar enough are
    compared on full shingle sets, numbered within the block: one pass over these sets counts all intersections.
    """
    import zstandard

    plain = zstandard.ZstdDecompressor()
    ids, label, side = (table[c].to_numpy() for c in ("id", "label", "block"))
    sig = np.stack([table[f"s{i}"].to_numpy().view(U64) for i in range(8)], axis=1)
    lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
    left, right = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
    out_a, out_b = [], []
    if len(left) and len(right) and len(np.unique(label)) > 1:
        sets = []
        for body in table["body"].to_pylist():
            text = np.frombuffer(plain.decompress(body), np.uint8)
            sets.append(shingle_sets(text, np.array([0, len(text)]), m.words)[0])
        size = np.array([len(x) for x in sets])
        number = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        starts = np.cumsum(size) - size
        flat = np.concatenate([number[starts[j] : starts[j] + size[j]] for j in right])
        at = np.cumsum(size[right]) - size[right]
        mark = np.zeros(int(number.max()) + 1, bool)
        now = label.copy()
        for i in left.tolist():
            other = now[right] != now[i]
            if lo == hi:
                other &= ids[right] > ids[i]
            if not other.any():
                continue
            other &= may_link(sig, size, i, right, m)
            if not other.any():
                continue
            own = number[starts[i] : starts[i] + size[i]]
            mark[own] = True
            hit = np.flatnonzero(other)
            theirs = size[right[hit]]
            both = np.add.reduceat(mark[flat[ragged(at[hit], theirs)]], np.cumsum(theirs) - theirs, dtype=np.int64)
            mark[own] = False
            for j in right[hit[100 * both >= m.similarity * (theirs + size[i] - both)]].tolist():
                if now[j] != now[i]:
                    out_a.append(ids[i])
                    out_b.append(ids[j])
                    now[now == now[j]] = now[i]
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def minhash_dedup(docs: DataFrame, setting: MinHash | None = None) -> DataFrame:
    """Near-duplicate components: documents are linked if 100 * intersection >= similarity * union of their shingle sets.

    Returns per row of docs: doc_id, n_shingles, component_id (least doc_id reachable, itself included), kept (doc_id = component_id).
    Null and empty texts have no shingles and are linked with nothing. Rows with equal doc_id are one node; rows with a null doc_id
    are linked with nothing, get a null component_id and are kept. Other columns of docs don't matter; an empty table gives an empty result.
    """
    m = setting or MinHash()
    signed = written(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: sign(batches, m), SIGNED), "signed")
    whole = signed.select("id", "n_shingles", "set_a", "set_b")
    real = whole.filter("n_shingles > 0 and id is not null")
    classes = real.groupBy("set_a", "set_b", "n_shingles").agg(F.min("id").alias("rep"))
    classes = checkpoint(classes)
    heads = signed.filter("n_shingles > 0 and id is not null").join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    keys = heads.select("id", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("id").alias("p"), F.max("id").alias("q"), F.count("*").alias("size")).filter("p <> q")
    members = written(keys.join(shared.select("key", "size"), "key").select("key", "id", "size").distinct(), "members")
    cands = written(signed.join(members.select("id").distinct(), "id", "left_semi").drop("bands", "set_a", "set_b"), "bodies")
    labels = checkpoint(members.select("id").distinct().withColumn("label", F.col("id")))

    def active(chosen: Column) -> DataFrame:
        """Members of buckets with several components, with their bucket's pivot: the member for which chosen is least."""
        now = members.join(labels, "id")
        mixed = now.groupBy("key").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.min_by(F.struct("id", "label"), chosen).alias("pivot")).filter("l1 <> l2")
        return now.join(mixed.select("key", "pivot"), "key")

    def merge(links: DataFrame) -> DataFrame:
        old = labels
        edges = links.join(old.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(old.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        new = connected_components(edges).select(F.col("id").alias("label"), F.col("label").alias("least"))
        return checkpoint(old.join(new, "label", "left").select("id", F.coalesce("least", "label").alias("label")))

    most = 0
    for k in range(m.rounds):
        chosen = F.col("id") if k == 0 else F.xxhash64("id", "key", F.lit(k))
        pairs = active(chosen).filter("label <> pivot.label").select(F.col("id").alias("a"), F.col("pivot.id").alias("b")).distinct()
        links = checkpoint(confirmed(pairs, cands, m))
        n = links.count()
        if n:
            labels = merge(links)
        if 100 * n <= most:  # the rest is for the blocks
            break
        most = max(most, n)

    rest = active(F.col("id")).select("key", "id", "label", "size")
    blocks = F.ceil(F.col("size") / m.block).cast("int")
    rest = rest.withColumn("several", blocks > 1).withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rest = written(rest.select("key", "id", "label", "several", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")), "blocks")
    sigs = [f"s{i}" for i in range(8)]
    # a bucket of one block has each text once; in larger ones only documents that signatures leave open take theirs to each pair of blocks
    many = rest.filter("several").join(cands.select("id", "n_shingles", *sigs), "id")
    some = written(many.groupBy("key", "lo", "hi").applyInArrow(lambda t: block_open(t, m), "id long, key long, lo int, hi int"), "open")
    rest = rest.filter("not several").unionByName(rest.filter("several").join(some, ["key", "lo", "hi", "id"], "left_semi")).join(cands.select("id", "body", *sigs), "id")
    labels = merge(rest.groupBy("key", "lo", "hi").applyInArrow(lambda t: block_links(t, m), "a long, b long"))

    found = classes.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").select("set_a", "set_b", "n_shingles", F.coalesce("label", "rep").alias("component"))
    out = whole.join(found, ["set_a", "set_b", "n_shingles"], "left").groupBy("id").agg(F.min("component").alias("component"))
    one = whole.select("id", "n_shingles").alias("w").join(out.alias("o"), F.col("w.id") == F.col("o.id"), "left")
    component = F.when(F.col("w.id").isNotNull(), F.coalesce("o.component", "w.id"))
    return one.select(F.col("w.id").alias("doc_id"), F.col("w.n_shingles").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("w.id"), F.lit(True)).alias("kept"))
