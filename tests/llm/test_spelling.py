"""Spelling variants against a plain version, over whole tables and over words made to be near."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from haulmark.llm.registry import op11_spelling_variants
from haulmark.llm.spelling_variants import near_words, spelling_variants

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            seen[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def plain_near(words):
    """Words with one code point left out meet; so do those with one replaced by a mark."""
    marked = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            marked[w[:i] + "\0" + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in marked.values():
        for w in group:
            near[w] |= group - {w}
    for w in words:
        for i in range(len(w)):
            short = w[:i] + w[i + 1 :]
            if short in words:
                near[w].add(short)
                near[short].add(w)
    return near


def plain(rows):
    words = plain_counts(rows)
    near, form = plain_near(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words.get(form[w], -1)) for w, n in words.items())


def got(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = op11_spelling_variants(spark, "/root/testdata/sf0.001")
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert got(df) == plain(rows)


@pytest.mark.parametrize("block_rows", [2, 5, 128])
def test_divided_blocks(spark, block_rows):
    made = {f"{a}{b}oucher{c}" for a in "abcdefgh" for b in "xyzuvw" for c in ["", "s", "t", "st", "ss"]}
    made |= {"aaaaa", "aaaaaa", "aaaaaaa", "aaaab", "abaaa", "baaaa", "aaaba", "lette", "lettre", "letter", "aletter", "lettera", "letteér", "x" * 300, "x" * 301, "x" * 150 + "y" + "x" * 149}
    words = spark.createDataFrame([(w, 3 + len(w) % 7) for w in sorted(made)], "word string, n long")
    near = plain_near(made)
    n = {w: 3 + len(w) % 7 for w in made}
    want = sorted((w, len(x), *min((-n[y], y) for y in x)) for w, x in near.items() if x)
    assert sorted((r.word, r.n_near, -r.best_n, r.best) for r in near_words(words, block_rows=block_rows, rows_a_task=100).collect()) == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.text("ab", min_size=1, max_size=8), min_size=1, max_size=40))
def test_few_letters(spark, made):
    words = spark.createDataFrame([(w, 1) for w in sorted(made)], "word string, n long")
    assert sorted((r.word, r.n_near) for r in near_words(words, block_rows=3).collect()) == sorted((w, len(x)) for w, x in plain_near(made).items() if x)


def test_edges(spark):
    text = "Maison maison MAISON maisons maisons maisons maison maison maison Étages Étages Étages étages étages étages étages étages étages "
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "a" * 70_000 + " " + "a" * 70_000), (None, "a" * 70_000 + " \U0001f600 word́s")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, word string, n string")
    assert got(spelling_variants(docs)) == plain(rows)
    empty = spelling_variants(docs.limit(0))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and empty.count() == 0
