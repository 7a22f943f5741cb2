"""Suffix-array and substring dedup against brute force."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from haulmark.llm.repeats import Setting
from haulmark.llm.substring_dedup import prefix_groups, substring_dedup, subtree, tree_repeats
from haulmark.llm.suffix_array_dedup import permuted_common_prefixes, shard_repeats, suffix_array, suffix_array_dedup

SCHEMA = "doc_id long, text string, lang string, grp int, part int"


def brute(rows, unit):
    least, docs = {}, []
    for i, text in rows:
        raw = (text or "").encode()
        seq = re.findall(rb"[^\x20\x09-\x0D]+", raw) if unit == "words" else raw
        docs.append((i, seq))
        for a in range(len(seq) - 49):
            key = tuple(seq[a : a + 50]) if unit == "words" else seq[a : a + 50]
            least[key] = min(least.get(key, (float("inf"))), float("inf") if i is None else i)
    out = []
    for i, seq in docs:
        gone = np.zeros(len(seq), bool)
        for a in range(len(seq) - 49):
            key = tuple(seq[a : a + 50]) if unit == "words" else seq[a : a + 50]
            if least[key] < (float("inf") if i is None else i):
                gone[a : a + 50] = True
        left = [x for x, g in zip(seq, gone) if not g]
        body = b" ".join(left) if unit == "words" else bytes(left)
        spans = int(np.count_nonzero(np.diff(np.r_[False, gone].astype(int)) == 1))
        out.append((i, len(seq), int(gone.sum())) + ((spans,) if unit == "bytes" else ()) + (hashlib.sha256(body).hexdigest(),))
    return sorted(out, key=str)


def corpus(seed, n=60):
    r = random.Random(seed)
    words = [r.choice("abcdeé") * r.randint(1, 3) + r.choice("xyz") for _ in range(40)]
    passages = [" ".join(r.choices(words, k=r.randint(40, 90))) for _ in range(4)] + ["na " * 80, "ab" * 60]
    rows = []
    for i in range(n):
        text = " ".join(r.choices(words, k=r.randint(0, 120)))
        for _ in range(r.randint(0, 2)):
            text += r.choice([" ", "\n", "\t "]) + r.choice(passages)
        rows.append((i, text + r.choice(["", " ", " tail"])))
    rows += [(n + k, rows[3][1]) for k in range(5)] + [(n + 9, None), (n + 10, ""), (n + 11, " \n "), (5, rows[7][1]), (5, rows[7][1]), (None, rows[3][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("unit", ["words", "bytes"])
@pytest.mark.parametrize("hot", [4096, 2])
def test_like_brute_force(spark, unit, hot):
    rows = corpus(hot)
    df = spark.createDataFrame([(i, t, "en", 1, 2) for i, t in rows], SCHEMA)
    s = Setting(unit, hot_parts=hot)
    if unit == "words":
        got = substring_dedup(df, s, group_suffixes=1 << 21 if hot > 2 else 50)
        got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()]
    else:
        got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array_dedup(df, s).collect()]
    assert sorted(got, key=str) == brute(rows, unit)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert substring_dedup(df).collect() == [] and suffix_array_dedup(df).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array(seed):
    r = np.random.default_rng(seed)
    text = np.append(r.integers(1, [2, 3, 4, 6, 250, 250][seed] + 1, 300), 0)
    if seed == 5:
        text[:200] = np.tile(text[:10], 20)
    want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert suffix_array(text, 258, 400).tolist() == want


def random_text(seed, n):
    """Texts whose names are many (over 512 on the first level and the second), and repetitive ones."""
    r = np.random.default_rng(seed)
    base = [r.integers(1, 250, n), r.integers(1, 5, n), np.tile(r.integers(1, 90, n // 3), 3), np.repeat(r.integers(1, 4, n // 50), 50)][seed % 4]
    return np.append(base, 0)


def common(x, y):
    k = 0
    while k < min(len(x), len(y)) and x[k] == y[k]:
        k += 1
    return k


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("n", [60, 9000])
def test_suffix_array_and_common_prefixes_at_any_size(seed, n):
    text = random_text(seed, n)
    whole = text.tolist()
    order = suffix_array(text, 258)
    assert order.tolist() == sorted(range(len(whole)), key=lambda i: whole[i : i + 7000])
    got = permuted_common_prefixes(text.astype(np.int32), order)
    rank = {p: k for k, p in enumerate(order.tolist())}
    for i in range(0, len(whole), max(1, n // 300)):
        want = common(whole[i:], whole[order[rank[i] - 1] :]) if rank[i] else 0
        assert got[i] == want


def entries(seed, words):
    r = random.Random(seed)
    passages = [[r.choice(words) for _ in range(r.randint(55, 90))] for _ in range(5)] + [["na"] * 120, ["a", "b"] * 70]
    out = []
    for _ in range(25):
        p = r.choice(passages)
        a = r.randint(0, len(p) - 50)
        out.append((r.randint(1, 6), p[a : r.randint(a + 50, len(p))]))
    return out


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("limit", [1 << 16, 7])
def test_group_like_brute_force(seed, limit):
    found = entries(seed, [f"w{i}" for i in range(300)] + ["é", "x" * 40])
    starts = [tuple(w[a : a + 50]) for _, w in found for a in range(len(w) - 49)]
    least = {}
    for (d, _), key in ((e, k) for e in found for k in (tuple(e[1][a : a + 50]) for a in range(len(e[1]) - 49))):
        least[key] = min(least.get(key, d), d)
    want = {(i, k) for i, (d, w) in enumerate(found) for a in range(len(w) - 49) if least[tuple(w[a : a + 50])] < d for k in range(a, a + 50)}
    texts = [" ".join(w).encode() for _, w in found]
    args = [np.frombuffer(b"".join(texts), np.uint8), np.array(list(map(len, texts))), np.array([len(w) - 49 for _, w in found]), np.array([d for d, _ in found])]
    assert {(i, k) for i, a, b in zip(*(x.tolist() for x in tree_repeats(*args, 50, limit))) for k in range(a, b + 49)} == want and starts
    args[2] = args[1] - 49
    by_bytes = {}
    for d, t in zip(args[3].tolist(), texts):
        for a in range(len(t) - 49):
            by_bytes[t[a : a + 50]] = min(by_bytes.get(t[a : a + 50], d), d)
    want = {(i, a) for i, (d, t) in enumerate(zip(args[3].tolist(), texts)) for a in range(len(t) - 49) if by_bytes[t[a : a + 50]] < d}
    assert {(i, k) for i, a, b in zip(*(x.tolist() for x in shard_repeats(*args, 50))) for k in range(a, b)} == want


@pytest.mark.parametrize("seed", range(5))
def test_subtrees(seed):
    r = np.random.default_rng(seed)
    ids = np.r_[np.tile(r.integers(1, 5, 40), 8), r.integers(1, 3, 300)]
    at = np.arange(len(ids) - 60)
    groups = prefix_groups(ids, at, 40, 50)
    assert sorted(np.concatenate(groups).tolist()) == at.tolist()
    where = {p: k for k, g in enumerate(groups) for p in g.tolist()}
    whole = ids.tolist()
    for g in groups:
        order, shared = subtree(ids, g, np.full(len(g), len(ids)), 55)
        seqs = [whole[p : p + 55] for p in g[order].tolist()]
        assert seqs == sorted(seqs) and shared.tolist()[1:] == [common(x, y) for x, y in zip(seqs, seqs[1:])]
    same = {}
    for p in at.tolist():
        assert same.setdefault(tuple(whole[p : p + 50]), where[p]) == where[p]


def test_very_long_and_repetitive_texts(spark):
    r = random.Random(5)
    long = " ".join(str(r.randrange(50_000)) for _ in range(60_000))
    rows = [(1, "x " + long), (2, long[:200_000]), (3, "na " * 30_000), (4, "na " * 20_000), (5, "ab" * 30_000)]
    df = spark.createDataFrame([(i, t, "en", 1, 2) for i, t in rows], SCHEMA)
    got = {r.doc_id: r.n_removed for r in substring_dedup(df).collect()}
    assert got == {1: 0, 2: len(long[:200_000].split()) - (long[200_000] != " "), 3: 0, 4: 20_000, 5: 0}
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_array_dedup(df).collect()}
    assert got == {1: (0, 0), 2: (200_000, 1), 3: (0, 0), 4: (60_000, 1), 5: (0, 0)}


def test_long_runs_of_one_symbol():
    """Linear in runs of any length, also where several are beside each other."""
    text = np.r_[np.full(400_000, 98), 1, np.full(300_000, 98), 97, np.full(200_000, 98), 99, np.full(5, 97), 0]
    began = time.process_time()
    order = suffix_array(text, 258)
    assert time.process_time() - began < 20
    assert sorted(order.tolist()) == list(range(len(text)))
    rank = np.empty(len(text), np.int64)
    rank[order] = np.arange(len(text))
    # suffixes are in order if the first symbols are, and among equal ones the suffixes after them
    first = text[order]
    assert (np.diff(first) >= 0).all()
    same = np.flatnonzero(np.diff(first) == 0)
    assert (rank[order[same] + 1] < rank[order[same + 1] + 1]).all()
