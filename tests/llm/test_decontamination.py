"""Greedy string tiling against a plain version that looks at all places."""

import random
import re
import time

import numpy as np
import pytest

from haulmark.llm.decontamination import Tiling, benchmark_overlap, clean_documents, tiles

DOCS, BENCH = "doc_id long, text string, item_id int, covered int", "item_id long, text string, doc_id int"


def plain(p, t, least):
    """Tiles by looking at every place each time, the longest first."""
    pf, tf, total, n_tiles = [True] * len(p), [True] * len(t), 0, 0
    while True:
        best, at = 0, []
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and pf[i + n] and tf[j + n]:
                    n += 1
                if n > best:
                    best, at = n, []
                if n == best and n:
                    at.append((i, j))
        if best < least:
            return total, n_tiles
        for i, j in at:
            if all(pf[i : i + best]) and all(tf[j : j + best]):
                pf[i : i + best] = [False] * best
                tf[j : j + best] = [False] * best
                total, n_tiles = total + best, n_tiles + 1


@pytest.mark.parametrize("seed", range(40))
def test_tiles(seed):
    r = random.Random(seed)
    p = np.array([r.randrange(4 + seed) for _ in range(r.randint(1, 40))], np.uint64)
    t = np.concatenate([np.array([r.randrange(4 + seed) for _ in range(9)], np.uint64), p[len(p) // 2 :], p[: len(p) // 2], p[::2]])
    got = tiles(p, t, np.ones(len(t), bool), 3)
    seen_p, seen_t = [], []
    for i, j, n in got:
        assert n >= 3 and (p[i : i + n] == t[j : j + n]).all()
        seen_p += range(i, i + n)
        seen_t += range(j, j + n)
    assert len(set(seen_p)) == len(seen_p) and len(set(seen_t)) == len(seen_t)
    # equal up to the choice among matches of one length, which may leave short tiles out
    assert abs(len(seen_p) - plain(p.tolist(), t.tolist(), 3)[0]) <= 4


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), text or ""))


def corpus():
    r = random.Random(3)
    vocab = ["".join(r.choices("abcdeéfg", k=5)) for _ in range(400)]
    items = [(i, " ".join(r.choices(vocab, k=r.randint(12, 40))).capitalize() + ".") for i in range(20)] + [(50, None), (51, ""), (52, "too short"), (None, "no id " * 9)]
    docs = []
    for i in range(80):
        text = r.choices(vocab, k=r.randint(0, 200))
        if i % 3 == 0:
            p = items[r.randrange(20)][1].split()
            half = len(p) // 2
            p = [p, p[half:] + p[:half], p[: len(p) // 3], [w.upper() for w in p]][i % 4]
            at = r.randint(0, len(text))
            text[at:at] = p if i % 2 else p[:half] + r.choices(vocab, k=30) + p[half:]
        docs.append((i, r.choice([" ", ", ", "\n"]).join(text)))
    return docs + [(90, None), (91, ""), (5, docs[6][1]), (None, items[0][1])], items


@pytest.mark.parametrize("block", [32 << 20, 700])
def test_overlap(spark, block):
    docs, items = corpus()
    d, b = spark.createDataFrame([(*x, 1, 2) for x in docs if x[0] != 5], DOCS), spark.createDataFrame([(*x, 9) for x in items], BENCH)
    got = {r.doc_id: r for r in benchmark_overlap(d, b, Tiling(block_bytes=block)).collect()}
    for i, text in docs:
        if i == 5:
            continue
        t = words(text)
        best = max(((plain(p, t, 5)[0] / len(p), -k) for k, x in items if k is not None and len(p := words(x)) >= 5), default=(0, 0))
        assert got[i].n_tokens == len(t)
        assert got[i].contaminated == (best[0] >= 0.6), (i, best, got[i])
        if best[0]:
            assert got[i].item_id == -best[1] and got[i].covered / got[i].item_tokens == best[0]
        else:
            assert got[i].item_id is None and not got[i].covered
    whole = [x for x in docs if x[0] != 5]
    left = clean_documents(spark.createDataFrame([(*x, 1, 2) for x in whole], DOCS), b, Tiling(block_bytes=block))
    assert left.columns == ["doc_id", "text", "item_id", "covered"]
    assert {r.doc_id for r in left.collect() if r.doc_id is not None} == {i for i, r in got.items() if i is not None and not r.contaminated}


def test_empty(spark):
    docs, items = corpus()
    d, b = spark.createDataFrame([(*x, 1, 2) for x in docs], DOCS), spark.createDataFrame([(*x, 9) for x in items], BENCH)
    assert benchmark_overlap(d.limit(0), b).collect() == []
    assert not any(r.contaminated for r in benchmark_overlap(d, b.limit(0)).collect())


@pytest.mark.parametrize("block", [32 << 20, 700])
def test_repeated_and_null_ids(spark, block):
    docs, items = corpus()
    docs += [(None, "clean text without an id"), (None, items[1][1]), (None, items[0][1]), (3, "clean under a used id"), (4, items[2][1])]
    d, b = spark.createDataFrame([(*x, 1, 2) for x in docs], DOCS), spark.createDataFrame([(*x, 9) for x in items], BENCH)
    want = []
    for i, text in docs:
        t = words(text)
        want.append((i, text, len(t), any(plain(p, t, 5)[0] >= 0.6 * len(p) for k, x in items if k is not None and len(p := words(x)) >= 5)))
    key = lambda r: tuple(map(str, r))
    got = benchmark_overlap(d, b, Tiling(block_bytes=block))
    assert got.columns == ["doc_id", "n_tokens", "item_id", "covered", "item_tokens", "n_tiles", "contaminated"]
    assert sorted([(r.doc_id, r.n_tokens, r.contaminated) for r in got.collect()], key=key) == sorted([(i, n, bad) for i, _, n, bad in want], key=key)
    left = clean_documents(d, b, Tiling(block_bytes=block)).collect()
    assert sorted([(r.doc_id, r.text) for r in left], key=key) == sorted([(i, text) for i, text, _, bad in want if not bad], key=key)


@pytest.mark.parametrize("seed", range(60))
def test_tiles_are_greedy(seed):
    r = random.Random(seed)
    p = np.array([r.randrange(2 + seed // 6) for _ in range(r.randint(1, 40))], np.uint64)
    t = np.concatenate([np.array([r.randrange(2 + seed // 6) for _ in range(25)], np.uint64), p[len(p) // 2 :], p[: len(p) // 2], p[::2]])
    got = tiles(p, t, np.ones(len(t), bool), 3)
    assert (sum(n for _, _, n in got), len(got)) == plain(p.tolist(), t.tolist(), 3)


@pytest.mark.parametrize("make", [lambda n: [7] * n, lambda n: [k % 2 for k in range(n)], lambda n: [k % 7 + (k % 50 == 0) * 9 for k in range(n)]])
def test_repetitive_texts_in_little_time(make):
    p, t = np.array(make(1000), np.uint64), np.array([99, *make(20_000)], np.uint64)
    began = time.process_time()
    got = tiles(p, t, np.ones(len(t), bool), 5)
    assert sum(n for _, _, n in got) == 1000 and time.process_time() - began < 1
    t = np.array(make(400) + [99] + make(20) + [98] + make(90), np.uint64)
    assert sum(n for _, _, n in tiles(p[:200], t, np.ones(len(t), bool), 5)) == plain(p[:200].tolist(), t.tolist(), 5)[0]


def test_gram_shared_by_many_items(spark):
    shared = "one two three four five"
    items = [(k, f"{shared} " + " ".join(f"w{k}x{j}" for j in range(20))) for k in range(3000)]
    docs = [(1, f"a b {shared} c d " * 300, 1, 2), (2, items[77][1] + " tail " + shared, 1, 2), (3, "word " * 200_000, 1, 2)]
    got = {r.doc_id: r for r in benchmark_overlap(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(*x, 9) for x in items], BENCH)).collect()}
    assert (got[1].item_id, got[1].covered, got[1].contaminated) == (0, 5, False)
    assert (got[2].item_id, got[2].covered, got[2].contaminated) == (77, 25, True)
    assert (got[3].item_id, got[3].n_tokens, got[3].contaminated) == (None, 200_000, False)


def test_short_items_match_as_a_whole(spark):
    """Items below a tile's length are found where their tokens stand together, and only there."""
    benchmark = spark.createDataFrame([(1, "What is 2+2?"), (2, "Capital of France? Paris"), (3, "Paris"), (4, "what IS 2 2"), (5, "two words"), (6, "the quick brown fox jumps over the lazy dog tonight")], "item_id long, text string")
    cases = {
        1: ("Asked: what is 2 + 2, said nobody", 1), 2: ("capital of france, Paris it is", 2), 3: ("Paris is large", None), 4: ("what is 2", None), 5: ("two", None), 6: ("words two", None), 7: ("here are two words", 5),
        8: ("two words and the quick brown fox jumps over the lazy dog tonight", 5), 9: ("capital of france paris", 2), 10: ("", None), 11: (None, None), 12: ("what is 2", None),
    }
    docs = spark.createDataFrame([(i, t) for i, (t, _) in cases.items()], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.item_id if r.contaminated else None) for r in benchmark_overlap(docs, benchmark).collect()}
    assert got == {i: want for i, (_, want) in cases.items()}
    assert {r.doc_id for r in clean_documents(docs, benchmark).collect()} == {i for i, (_, want) in cases.items() if want is None}
    small = Tiling(block_bytes=40)
    assert {r.doc_id: (r.item_id if r.contaminated else None) for r in benchmark_overlap(docs, benchmark, small).collect()} == got
