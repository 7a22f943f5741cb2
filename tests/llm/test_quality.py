"""Quality features and the cascade against a plain version."""

import itertools
import random
import re

from haulmark.llm.quality_rules import RULES, cascade, plan_cascade, quality_filter, quality_rules

SCHEMA = "doc_id long, text string, n_words string, kept int"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = SPLIT.findall(text)
    grams = list(zip(w, w[1:], w[2:]))
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if SPLIT.search(x)]
    chars, symbols, dup = sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
    base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    kept = not (base or 100 * symbols > 25 * len(w) or 2 * dup > len(lines) or chars < 2 * len(w) or chars > 14 * len(w))
    return len(w), chars, symbols, dup, len(covered), base, kept


def corpus():
    r = random.Random(4)
    rows = [None, "", " \n\t ", "a b c", "one two three one two three one two three", "x\x0by\x0cz\r\n  w", "é ß 🙂 " * 30, "​ zero width " * 20]
    for _ in range(60):
        vocab = ["".join(r.choices("abcdeé", k=r.randint(1, 9))) for _ in range(r.choice([3, 20, 400]))]
        w = [x + (r.choice(["%%%", "|", "#"]) if r.random() < 0.2 else "") for x in r.choices(vocab, k=r.randint(0, 200))]
        rows.append("".join(x + r.choice([" ", "  ", "\n", " \n", "\n\n"]) for x in w))
    line = " ".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=12))
    rows += ["\n".join([line] * 9 + [" ".join(map(str, range(100 + k, 160 + k)))]) for k in range(3)] + ["word " * 20_000, " ".join(map(str, range(30_000, 60_000)))]
    return [(i, t, "clash", 7) for i, t in enumerate(rows)]


def test_features_and_verdict(spark):
    rows = corpus()
    rows += [rows[9], (None, rows[9][1], None, None)]
    df = spark.createDataFrame(rows, SCHEMA).cache()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality_rules(df).collect()), key=str)
    assert [g for g in got if g[1] < 5000] == sorted(((i, *plain(t)) for i, t, *_ in rows if (t or "").count(" ") < 5000), key=str)
    big = sorted(g[1:] for g in got if g[1] >= 5000)
    assert big == sorted([(20_000, 80_000, 0, 0, 20_000, True, False), (30_000, 150_000, 0, 0, 0, False, True)])
    kept = {g[0] for g in got if g[-1]}
    left = quality_filter(df)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == kept and kept


def test_any_order_gives_the_same_verdict(spark):
    df = spark.createDataFrame(corpus()[:40], SCHEMA)
    planned = plan_cascade(df, sample_rows=30)
    assert sorted(r.name for r, _, _ in planned) == sorted(r.name for r in RULES) and all(0 <= s <= 1 and c > 0 for _, c, s in planned)
    found = {tuple(sorted(r.doc_id for r in cascade(df, list(o)).filter("rejected_by is null").collect())) for o in itertools.islice(itertools.permutations(RULES), 0, 120, 29)}
    assert len(found) == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert quality_rules(df).collect() == [] and quality_filter(df).collect() == []


def test_sample_has_a_bound(spark):
    long = [(i, "word " * 200_000, "clash", 7) for i in range(3)]
    planned = plan_cascade(spark.createDataFrame(long, SCHEMA))
    assert [r.name for r, _, _ in planned] == sorted(r.name for r in RULES) and all(s == 0 for _, _, s in planned)
    df = spark.createDataFrame([(1, "x", "y", 1)], SCHEMA).withColumnRenamed("n_words", "rejected_by")
    assert quality_filter(df).columns == df.columns


def test_order_is_the_same_each_time(spark):
    """Five plans over one table agree; rules that reject much for little come first."""
    df = spark.createDataFrame(corpus(), SCHEMA)
    plans = [[(r.name, c, s) for r, c, s in plan_cascade(df)] for _ in range(5)]
    assert all(p == plans[0] for p in plans)
    score = [s / c for _, c, s in plans[0]]
    assert score == sorted(score, reverse=True) and plans[0][0][0] == "too_few_words"


def test_very_long_texts_have_verdicts(spark):
    rows = [(1, " ".join(f"w{k}" for k in range(400_000)), "", 0), (2, "same old words " * 100_000, "", 0), (3, "x" * 3_000_000, "", 0)]
    got = {r.doc_id: (r.n_words, r.n_repeat_words, r.kept) for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (400_000, 0, True), 2: (300_000, 300_000, False), 3: (1, 0, False)}
