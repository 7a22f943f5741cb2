"""Spelling variants: words one edit apart, each led to the frequent form that it is a variant of.

One edit leaves a half of a word intact. A pair of words, the shorter of s code points, is found through the place of its edit: the number
of code points that the two share from the front, 0 to s. Words that share their first half are a range of the forward dictionary and hold
the pairs with a place from s // 2 on; words that share their last half are a range of the reversed dictionary and hold the others. A block of
more than `block_rows` words is divided again by halves of what its words don't share yet, down to single places. So a place lies in one
block at every depth, each pair is met once, and no group holds more than the alphabet allows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import ragged, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]+"
#: Code points of pairs that a worker compares at once.
CELLS = 4 << 20


def word_counts(docs: DataFrame, one_in: int = 97, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """word and n of every run of letters; where one_in divides the crc32 of "<doc_id>:<run>", a code point of the run is missing.

    Only A-Z are lower-cased. Null texts have no runs; a missing doc_id counts as an empty one.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("r"))
    low = runs.select("d", F.when(F.octet_length("r") == F.char_length("r"), F.lower("r")).otherwise(F.translate("r", UPPER, LOWER)).alias("r")).filter(F.char_length("r") >= least_length)
    hashed = low.select("r", F.crc32(F.concat("d", F.lit(":"), "r").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("r")).cast("int")
    cut = F.concat(F.substring("r", F.lit(1), at), F.substring("r", at + 2, F.char_length("r")))
    words = hashed.select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("r")).alias("word")).filter(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def block_key(i: Column, j: Column) -> Column:
    """The code points that all words of a block share: i from the front, j from the back."""
    length = F.char_length("word")
    return F.concat(F.substring("word", F.lit(1), i), F.substring("word", length - j + 1, j))


def halves(rows: DataFrame) -> DataFrame:
    """Rows of blocks (s, i, j), dealt to the two blocks that share half as much again: more from the front, or more from the back."""
    half = F.floor((F.col("s") - F.col("i") - F.col("j")) / 2).cast("int")
    ways = F.array(
        F.struct((F.col("i") + half).alias("i"), F.col("j").alias("j")),
        F.struct(F.col("i").alias("i"), (F.col("s") - F.col("i") - half).alias("j")),
    )
    dealt = rows.select("word", "n", "s", F.explode(ways).alias("b")).select("word", "n", "s", "b.i", "b.j")
    return dealt.withColumn("key", block_key(F.col("i"), F.col("j")))


def blocks(words: DataFrame, block_rows: int) -> DataFrame:
    """word, n, and s, i, j, key of every block that a word is in; a word is the shorter of a pair (s its length) or the longer one."""
    length = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("s")).withColumns({"i": F.lit(0), "j": F.lit(0)})
    rows, done = halves(rows), []
    while True:
        rows = written(rows, "spelling-blocks")
        sizes = rows.filter("s - i - j > 1").groupBy("s", "i", "j", "key").agg(F.count("*").alias("m")).filter(F.col("m") > block_rows)
        large = written(sizes.drop("m"), "spelling-large")
        if large.isEmpty():
            return written(reduce(DataFrame.unionByName, [*done, rows]), "spelling-blocks") if done else rows
        on = ["s", "i", "j", "key"]
        done.append(rows.join(large, on, "left_anti"))
        rows = halves(rows.join(large, on, "left_semi"))


def near_pairs(codes: np.ndarray, left: np.ndarray, right: np.ndarray, s: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows left and right of codes are one edit apart at a place of the block: of s and s code points, or of s and s + 1.

    The place is the number of code points shared from the front; a block that shares j from the back holds places below s - j.
    """
    width = codes.shape[1]
    a, b = codes[left], codes[right]
    differ = a != b
    front = np.argmax(differ, axis=1)
    rows = np.arange(len(s))
    longer = b[rows, s] != 0
    out = differ.any(axis=1) & ((j == 0) | (front < s - j))
    out[~longer] &= differ[~longer].sum(axis=1) == 1
    # what follows the place, with a code point of the longer word left out
    a, b = a[longer, :-1], b[longer, 1:]
    out[longer] &= ~((a != b) & (np.arange(width - 1)[None, :] >= front[longer, None])).any(axis=1)
    return out


def block_links(words: list[str], n: np.ndarray, s: np.ndarray, j: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links, best n, index of the best) of each row: how many near words its block holds, and the one of largest n, first in order among equals.

    Pairs are compared a few at a time, however many there are.
    """
    m = len(words)
    count, best_n, best = np.zeros(m, np.int64), np.zeros(m, np.int64), np.full(m, -1, np.int64)
    length = np.fromiter(map(len, words), np.int64, m)
    ends = np.repeat(starts + sizes, sizes)
    partners = ends - np.arange(m) - 1  # rows after this one in its block
    names, width = np.array(words, dtype=object), int(s.max()) + 1
    step, a = max(1, CELLS // width), 0
    total = np.cumsum(partners)
    while a < m:
        done = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, done + step, side="right")))
        left = np.repeat(np.arange(a, b), partners[a:b])
        right = ragged(np.arange(a, b) + 1, partners[a:b])
        # one long row may still have more partners than fit
        for c in range(0, len(left), step):
            x, y = left[c : c + step], right[c : c + step]
            x, y = np.where(length[x] <= length[y], x, y), np.where(length[x] <= length[y], y, x)
            fits = length[x] == s[x]  # two of s + 1 are met in the block of s + 1
            x, y = x[fits], y[fits]
            if not len(x):
                continue
            used = np.zeros(int(max(x.max(), y.max())) - a + 1, bool)
            used[x - a] = used[y - a] = True
            at = np.cumsum(used) - 1
            codes = np.array(names[a : a + len(used)][used].tolist(), dtype=f"<U{width}").view(np.uint32).reshape(-1, width)
            codes = codes.astype(np.uint8) if codes.max() < 256 else codes
            ok = near_pairs(codes, at[x - a], at[y - a], s[x], j[x])
            x, y = x[ok], y[ok]
            for p, q in ((x, y), (y, x)):
                np.add.at(count, p, 1)
                for r, t in zip(p.tolist(), q.tolist(), strict=True):
                    if n[t] > best_n[r] or n[t] == best_n[r] and words[t] < words[best[r]]:
                        best_n[r], best[r] = n[t], t
        a = b
    return count, best_n, best


LINKS = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, in; the links of each row within its block, out. A block that goes on in the next batch waits for it."""
    held: pa.Table | None = None

    def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = {c: table.column(c).combine_chunks() for c in table.column_names}
        s, i, j = (cols[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("s", "i", "j"))
        key = cols["key"].to_numpy(zero_copy_only=False)
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (key[1:] != key[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(s)))
        keep = np.repeat(sizes > 1, sizes)
        if not keep.any():
            return
        words = cols["word"].filter(pa.array(keep)).to_pylist()
        n = cols["n"].to_numpy(zero_copy_only=False)[keep]
        sizes = sizes[sizes > 1]
        starts = np.cumsum(sizes) - sizes
        count, best_n, best = block_links(words, n, s[keep], j[keep], starts, sizes)
        found = np.flatnonzero(count)
        if len(found):
            yield pa.RecordBatch.from_arrays(
                [pa.array([words[k] for k in found]), pa.array(count[found]), pa.array(best_n[found]), pa.array([words[k] for k in best[found]])], schema=LINKS
            )

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        last = {c: table.column(c)[table.num_rows - 1].as_py() for c in ("s", "i", "j", "key")}
        a = table.num_rows
        while a and all(table.column(c)[a - 1].as_py() == v for c, v in last.items()):
            a -= 1
        if a:
            yield from whole(table.slice(0, a))
        held = table.slice(a)
    if held is not None and held.num_rows:
        yield from whole(held)


def near_words(words: DataFrame, block_rows: int = 128, rows_a_task: int = 50_000) -> DataFrame:
    """word, n_near, and of its near words the one of largest n (ties: the smallest), for every word that has near words. Words are distinct."""
    rows = blocks(words, block_rows)
    spark = words.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // rows_a_task))
    order = ["s", "i", "j", "key"]
    ranges = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    links = ranges.select(*order, "word", "n").mapInArrow(scan, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("a"), F.col("best").alias("w")))
    return links.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.w").alias("best"), (-F.col("b.a")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root: the end of the chain of forms. Each form has twice the count of its word at least, so chains end; each round of the join
    doubles the steps that a row has taken."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("word").alias("w"), F.col("root").alias("r"))
        now = written(now.join(further, F.col("root") == F.col("w"), "left").select("word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")), "spelling-roots")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(docs: DataFrame, block_rows: int = 128) -> DataFrame:
    """A row for each word of at least 5 code points that occurs 3 times: word, form, root, n, n_near, form_n.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. form is the near word of largest n (ties: smallest
    in code-point order) if that is at least twice the word's n, else null. Null and empty texts add nothing, a repeated row counts
    again, a missing doc_id counts as an empty one (see word_counts); an empty table gives an empty result. Other columns aren't read.
    """
    words = written(word_counts(docs.select("doc_id", "text")), "spelling-words")
    near = written(near_words(words, block_rows), "spelling-near")
    led = F.col("best_n") >= 2 * F.col("n")
    formed = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(led, F.col("best")).alias("form"), F.when(led, F.col("best_n")).alias("form_n"))
    formed = written(formed, "spelling-forms")
    ends = roots(formed.filter("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
