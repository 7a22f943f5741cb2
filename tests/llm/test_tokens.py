"""Token counts and packing against the library and plain best-fit decreasing."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from haulmark.llm.packing import WordIds, best_fit_decreasing, best_fit_packing
from haulmark.llm.token_counts import token_counts

SCHEMA = "doc_id long, text string, length int, piece int"
ODD = ["", None, " ", "a", "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "aaaa" * 300, "\x1c\x1f\x85  z", "é́ é", "don't we'LL", "１２ ³ Ⅷ 42", "ΟΔΟΣ İI", "日本語 テキスト", "🙂🙂 👩‍👩‍👧", "​﻿᠎", "tab\tnew\n\n  line ", "<|startoftext|>hi", " nbsp", "a\x0bb\x0cc"]


def texts(seed):
    r = random.Random(seed)
    pool = [chr(c) for c in [*range(32, 127), *range(0xA1, 0x180), 0x0394, 0x4E2D, 0x1F600, 9, 10, 0x2003, 0x0301]]
    return ODD + ["".join(r.choices(pool, k=r.randint(1, 200))) for _ in range(60)] + [" ".join(r.choices(["the", "of", "naïve", "Straße", "x1y2", "!!!"], k=900)) for _ in range(6)]


def test_token_counts(spark):
    rows = list(enumerate(texts(1)))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = token_counts(spark.createDataFrame([(i, t, 1, 2) for i, t in rows], SCHEMA)).collect()
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.n_bytes == len((rows[r.doc_id][1] or "").encode()) and r.over_limit == (r.n_tokens > 512) for r in got)


def test_word_ids():
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    words = WordIds(public_tokenizers.path("word_bpe_49k.json"), most=50)
    for t in texts(2):
        assert words.encode([(t or "").encode()])[0].tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)


def plain(lengths, size):
    left = []
    for x in sorted(lengths, reverse=True):
        fit = [i for i, c in enumerate(left) if c >= x]
        if fit:
            left[min(fit, key=lambda i: left[i])] -= x
        else:
            left.append(size - x)
    return sorted(left)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_best_fit_decreasing(lengths):
    counts = {x: lengths.count(x) for x in lengths}
    used, seen = {}, {x: [] for x in counts}
    for length, lo, hi, first, each, at in best_fit_decreasing(counts, 40):
        for r in range(lo, hi):
            seen[length].append(r)
            used.setdefault(first + (r - lo) // each, []).append((at + (r - lo) % each * length, length))
    assert all(sorted(v) == list(range(counts[x])) for x, v in seen.items())
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    assert sorted(40 - sum(n for _, n in v) for v in used.values()) == plain(lengths, 40)


def test_packing(spark):
    rows = [(i, t) for i, t in enumerate(texts(3) + ["word " * 5000])] + [(7, "again"), (7, "again"), (None, "no id")]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = best_fit_packing(spark.createDataFrame([(i, t, 1, 2) for i, t in rows], SCHEMA), size=64).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())) for k in range(0, len(ids), 64)]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= 64
    assert len(bins) == len(plain([w[3] for w in want], 64))


@pytest.mark.parametrize("f", [token_counts, best_fit_packing])
def test_empty_table(spark, f):
    assert f(spark.createDataFrame([], SCHEMA)).collect() == []


def test_any_code_points():
    """Characters that no version of Unicode known here has assigned are the library's to class."""
    from haulmark.llm.token_counts import chunk_counts

    r = random.Random(9)
    path, other = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
    counts, library = chunk_counts(path), Tokenizer.from_file(path)
    words, beside = WordIds(other), Tokenizer.from_file(other)
    for _ in range(3000):
        pool = [chr(c) for c in (r.randrange(0x110000) if r.random() < 0.3 else r.randrange(0x3000) for _ in range(6)) if not 0xD800 <= c < 0xE000] + [" ", "a", "\n"]
        t = "".join(r.choices(pool, k=r.randint(1, 12)))
        assert counts.count([t])[0] == len(library.encode(t, add_special_tokens=False).ids), ascii(t)
        assert words.encode([t.encode()])[0].tolist() == beside.encode(t, add_special_tokens=False).ids, ascii(t)
