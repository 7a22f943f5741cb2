"""Near-dedup against brute force over all pairs."""

import random
import re

import pytest

from haulmark.llm.minhash_dedup import MinHash, minhash_dedup

SCHEMA = "doc_id long, text string, key int, label int"


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in w]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in sets if i is not None}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for n, (i, p) in enumerate(sets):
        for j, q in sets[:n]:
            if i is not None and j is not None and p and q and 100 * len(p & q) >= 75 * len(p | q):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return sorted(((i, len(p), None if i is None else root(i), i is None or root(i) == i) for i, p in sets), key=str)


def corpus(seed):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefghij", k=4)) for _ in range(300)]
    rows = []
    for base in range(12):
        words = r.choices(vocab, k=r.randint(30, 120))
        for _ in range(r.randint(1, 8)):
            w = list(words)
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append(" ".join(w) if r.random() < 0.8 else " \n".join(w).upper())
    rows += ["one two", "one  two", "ONE two", None, "", "  ", "five words are in here", "x"]
    rows = [(i * 3, t) for i, t in enumerate(r.sample(rows, len(rows)))]
    return rows + [(None, rows[0][1]), rows[1], (rows[2][0], rows[2][1])]


@pytest.mark.parametrize("rounds", [2, 0])
def test_like_brute_force(spark, rounds):
    rows = corpus(rounds)
    got = minhash_dedup(spark.createDataFrame([(i, t, 1, 2) for i, t in rows], SCHEMA), MinHash(rounds=rounds, block=4096 if rounds else 3)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_empty_table(spark):
    assert minhash_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("block", [2, 5])
def test_small_blocks(spark, block):
    rows = corpus(7)
    got = minhash_dedup(spark.createDataFrame([(i, t, 1, 2) for i, t in rows], SCHEMA), MinHash(rounds=0, block=block)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_very_long_texts(spark):
    r = random.Random(1)
    words = [str(r.randrange(100_000)) for _ in range(120_000)]
    near = words[:]
    near[500:500] = ["new"] * 40
    rows = [(3, " ".join(words), 1, 2), (1, " ".join(near), 1, 2), (2, " ".join(words[:60_000]), 1, 2)]
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in minhash_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[3][1:] == (1, False) and got[1][1:] == (1, True) and got[2][1:] == (2, True) and got[3][0] > 119_000
