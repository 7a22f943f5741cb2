"""Quality rules as a short-circuit cascade (operator 2), in DataFrame functions alone.

Each rule is a condition on features of the text that rejects it. On a bounded sample every rule's cost (what it adds to a job's time)
and selectivity (share of rows that it rejects) are measured; the cascade is one CASE that asks the rules in order of rejections
per cost, so most rejected rows meet the rule that settles them first and skip the rest. The order changes the work, not the verdict.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def word_chars(word: Column) -> Column:
    return F.char_length(F.array_join(word, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, SYMBOLS, "")).cast("long")


def lines(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, SPACE, "") != "")


def n_dup_lines(found: Column) -> Column:
    return (F.size(found) - F.size(F.array_distinct(found))).cast("long")


def repeat_positions(word: Column) -> Column:
    """Positions of 3-word windows whose 32-bit hash occurs twice: a few more than the repeated ones. Sorted longs of hash and position."""
    coded = F.transform(F.slice(word, 1, F.greatest(F.size(word) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(word, i + 1), F.get(word, i + 2)).bitwiseAND(F.lit(-1 << 32)) + i)
    return F.sort_array(coded)


def twice(ordered: Column) -> Column:
    high = lambda x: F.shiftright(x, 32)
    return F.transform(F.filter(ordered, lambda x, k: (high(x) == high(F.get(ordered, k + 1))) | ((k > 0) & (high(x) == high(F.get(ordered, F.greatest(k - 1, F.lit(0))))))), lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))


def spelled(word: Column, at: Column) -> Column:
    """The suspected windows themselves, in order: equal ones are neighbours."""
    return F.sort_array(F.transform(at, lambda i: F.struct(F.concat_ws(" ", F.get(word, i), F.get(word, i + 1), F.get(word, i + 2)).alias("w"), i.alias("i"))))


def covered(windows: Column) -> Column:
    """Starts of windows that truly occur twice, in order of position."""
    same = lambda x, k: x["w"] == F.get(windows, k)["w"]
    return F.sort_array(F.transform(F.filter(windows, lambda x, k: F.coalesce(same(x, k + 1), F.lit(False)) | ((k > 0) & F.coalesce(same(x, F.greatest(k - 1, F.lit(0))), F.lit(False)))), lambda x: x["i"]))


def n_covered(starts: Column) -> Column:
    """Words in windows of three at these starts."""
    return F.coalesce(F.aggregate(F.transform(starts, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - i, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))


def bound(value: Column, then) -> Column:
    """then(value) with value worked out once. The optimiser may move an expression to where it is used, even into a lambda that runs for
    each word; a lambda's own variable stays a value."""
    return F.get(F.transform(F.array(value), then), 0)


def repeat_words(word: Column) -> Column:
    return bound(repeat_positions(word), lambda o: bound(twice(o), lambda at: bound(spelled(word, at), lambda s: bound(covered(s), n_covered))))


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words. Null text counts as empty. _f is used on the way."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

    def features(w: Column) -> Column:
        of_lines = lambda found: F.struct(F.size(found).cast("long").alias("n"), n_dup_lines(found).alias("dup"))
        return F.struct(F.size(w).cast("long").alias("n_words"), word_chars(w).alias("word_chars"), n_symbols(t).alias("n_symbols"), bound(lines(t), of_lines).alias("lines"), repeat_words(w).alias("n_repeat_words"))

    found = docs.withColumn("_f", bound(words(t), features))
    return found.withColumns({n: F.col({"n_lines": "_f.lines.n", "n_dup_lines": "_f.lines.dup"}.get(n, f"_f.{n}")) for n in names}).drop("_f")


@dataclass(frozen=True)
class Rule:
    """rejects: the condition on named features (columns or expressions) for which a text goes.

    nanoseconds: what a word or a character (unit) costs, measured once over a table of ten million characters; only their proportions count.
    """

    name: str
    rejects: Callable[[dict[str, Column]], Column]
    nanoseconds: float = 10.0
    unit: str = "characters"


#: The first two are the base rules. Bounds are ratios of counts, multiplied out so that they are exact.
RULES = (
    Rule("too_few_words", lambda f: f["n_words"] < 50, 1.0, "words"),
    Rule("repeated_words", lambda f: 100 * f["n_repeat_words"] > 50 * f["n_words"], 835.0, "words"),
    Rule("symbols", lambda f: 100 * f["n_symbols"] > 25 * f["n_words"], 14.0, "characters"),
    Rule("repeated_lines", lambda f: 2 * f["n_dup_lines"] > f["n_lines"], 46.0, "characters"),
    Rule("word_length", lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 14 * f["n_words"]), 65.0, "words"),
)
BASE = ("too_few_words", "repeated_words")


def on_demand(text: Column, word: Column) -> dict[str, Column]:
    """Each feature as one expression of the text or its words: evaluated only where the cascade reaches a rule that needs it."""
    return {
        "n_words": F.size(word).cast("long"),
        "word_chars": word_chars(word),
        "n_symbols": n_symbols(text),
        "n_lines": F.size(lines(text)).cast("long"),
        "n_dup_lines": bound(lines(text), n_dup_lines),
        "n_repeat_words": repeat_words(word),
    }


def first_rejection(rules: Sequence[Rule], features: dict[str, Column]) -> Column:
    """The cascade: one CASE that asks the rules in order; null where none rejects."""
    out = F
    for rule in rules:
        out = out.when(rule.rejects(features), F.lit(rule.name))
    return out if rules else F.lit(None).cast("string")


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 500, sample_bytes: int = 1 << 13) -> list[tuple[Rule, float, float]]:
    """Rules in order of rejection per cost, each with its cost in seconds and its selectivity, from at most sample_rows rows.

    The rows are the first ones that a take finds: it reads a partition, and more only if that has too few. Texts of over sample_bytes stay out
    of the sample, which therefore has a bounded size. One job over the sample counts its words, its characters and the rows that
    each rule rejects; a rule's cost is its cost of a word or a character times those. So the order depends on the sample alone and is the same
    each time. It only orders the rules: any order gives the same verdicts. An empty table or sample leaves them in order of name.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    taken = [r[0] for r in docs.select(F.when(F.octet_length(text) <= sample_bytes, text)).take(sample_rows) if r[0] is not None]
    mark = "\x1e"
    while any(mark in t for t in taken):
        mark += "\x1e"
    # the sample goes back as one literal: no Python worker starts for it
    texts = F.split(F.lit(mark.join(taken)), mark) if taken else F.array().cast("array<string>")
    sample = spark.range(0, 1, 1, 1).select(F.explode(texts).alias("t")).withColumn("w", words(F.col("t"))).filter(F.size("w") >= 0)
    features = on_demand(F.col("t"), F.col("w"))

    counts = [F.sum(rule.rejects(features).cast("int")).alias(f"r{k}") for k, rule in enumerate(rules)]
    got = sample.agg(F.sum(F.size("w")).alias("words"), F.sum(F.char_length("t")).alias("characters"), *counts).first()
    found = [(rule, max(rule.nanoseconds * (got[rule.unit] or 0) * 1e-9, 1e-12), (got[f"r{k}"] or 0) / max(1, len(taken))) for k, rule in enumerate(rules)]
    return sorted(found, key=lambda x: (-x[2] / x[1], x[0].name))


def unused(names: Sequence[str], wish: str) -> str:
    """A column name that none of names has."""
    taken = {x.lower() for x in names}
    while wish.lower() in taken:
        wish = f"{wish}_"
    return wish


def cascade(docs: DataFrame, rules: list[Rule] | None = None, column: str = "rejected_by") -> DataFrame:
    """Adds a column, rejected_by: the first rule of the cascade that rejects the text, null if none does.

    Null and empty texts have no words, so a base rule rejects them. A column of docs with that name is replaced: name another one to
    keep it. Repeated rows are judged each; an empty table gives an empty result.
    """
    rules = rules if rules is not None else [rule for rule, _, _ in plan_cascade(docs)]
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # all rules but one need the words, so they are split once
    return docs.withColumn(column, bound(words(t), lambda w: first_rejection(rules, on_demand(t, w))) if rules else F.lit(None).cast("string"))


def quality_filter(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The rows that no rule rejects, with the columns they had, whatever their names.

    Null and empty texts go; repeated rows stay or go together; an empty table gives an empty result.
    """
    names = docs.columns
    verdict = unused(names, "rejected_by")
    return cascade(docs, rules, verdict).filter(F.col(verdict).isNull()).select(*[F.col(f"`{c}`") for c in names])


def quality_rules(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by.

    Every row's features are asked for here, so the cascade runs over their columns; quality_filter() evaluates them on demand and
    skips what a settled row doesn't need. Null and empty texts have no words, so the base rules reject them. Repeated rows come back
    each; other columns don't matter; an empty table gives an empty result.
    """
    order = rules if rules is not None else [rule for rule, _, _ in plan_cascade(docs)]
    found = with_features(docs.select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    features = {n: F.col(n) for n in names}
    base = F.lit(False)
    for rule in RULES:
        if rule.name in BASE:
            base = base | rule.rejects(features)
    verdict = first_rejection(order, features)
    return found.select("doc_id", *names, base.alias("base_failed"), verdict.isNull().alias("kept"), verdict.alias("rejected_by"))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS lines FROM d),
g AS (SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS n FROM g),
c AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n > 1) GROUP BY rid),
f AS (SELECT d.doc_id, CAST(len(w.words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(w.lines) AS BIGINT) AS n_lines,
             CAST(len(w.lines) - len(list_distinct(w.lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c.n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM d JOIN w USING (rid) LEFT JOIN c USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 25 * n_words OR 2 * n_dup_lines > n_lines
            OR word_chars < 2 * n_words OR word_chars > 14 * n_words) AS kept
FROM f
"""
