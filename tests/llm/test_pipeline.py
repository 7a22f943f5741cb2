"""The pipeline against a plain version of its stages, on a small table made for it."""

import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_minhash import brute as components
from tests.llm.test_repeats import brute as repeats


def features_ok(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    grams = list(zip(w, w[1:], w[2:]))
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars = sum(map(len, w))
    return n >= 50 and 100 * len(covered) <= 50 * n and 100 * sum(c in "#*$%&|<>" for c in text) <= 25 * n and 2 * (len(lines) - len(set(lines))) <= len(lines) and 2 * n <= chars <= 14 * n


def test_run(spark, tmp_path):
    r = random.Random(8)
    vocab = ["".join(r.choices("abcdefghij", k=5)) for _ in range(500)]
    prose = lambda n: r.choices(vocab, k=n)
    items = [" ".join(prose(30)) for _ in range(4)]
    passage, rows = prose(70), []
    for i in range(60):
        w = prose(r.randint(40, 200))
        if i % 5 == 0:
            w += passage
        if i % 7 == 0:
            w[9:9] = items[i % 4].split()
        if i % 11 == 0:
            w = ["na"] * 80
        if i % 13 == 0:
            w = [x + "%%%" for x in w]
        rows.append(" ".join(w))
    rows += [rows[1], rows[2] + " end", rows[3].upper(), None, ""]
    docs = list(enumerate(rows))
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in docs], pa.int64()), "text": rows, "lang": ["en"] * len(rows), "source": ["s"] * len(rows), "n_chars": pa.array([len(t or "") for t in rows], pa.int64())}), f"{tmp_path}/documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array(range(4), pa.int64()), "text": items}), f"{tmp_path}/benchmark.parquet")

    left = [(i, t) for i, t in docs if features_ok(t)]
    assert 20 < len(left) < len(docs) - 8
    keep = {i for i, _, _, kept in components(left) if kept}
    assert len(keep) < len(left)
    left = [(i, t) for i, t in left if i in keep]
    out, least = [], {}
    for i, text in left:
        w = text.split()
        for a in range(len(w) - 49):
            least.setdefault(tuple(w[a : a + 50]), i)
    for i, text in left:
        w = text.split()
        gone = {k for a in range(len(w) - 49) if least[tuple(w[a : a + 50])] < i for k in range(a, a + 50)}
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else text))
    assert sum(n > 0 for _, _, n, _ in repeats(left, "words")) > 3
    left = [(i, t) for i, t in out if not any(x in t.lower() for x in items)]
    assert len(left) < len(out)
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {(i, k // 2048): min(2048, n - k) for i, t in left for n in [len(library.encode(t).ids) + 1] for k in range(0, n, 2048)}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(x.doc_id, x.piece): x.length for x in got} == want
    import zlib

    assert all(x.ids_crc32 == zlib.crc32(b"".join(t.to_bytes(4, "little") for t in x.ids)) and len(x.ids) == x.length for x in got)


def stages(spark, tmp_path, docs, schema):
    """Each stage's rows, from documents of any columns."""
    pq.write_table(pa.table({"item_id": pa.array([1], pa.int64()), "text": ["an item of the benchmark that no document has at all"]}), f"{tmp_path}/benchmark.parquet")
    now, out = spark.createDataFrame(docs, schema), []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != "best_fit_packing":
            assert now.columns == spark.createDataFrame([], schema).columns and [f.dataType for f in now.schema][:2] == [f.dataType for f in spark.createDataFrame([], schema).schema][:2]
        rows = now.collect()
        out.append(rows)
        now = spark.createDataFrame(rows, now.schema)
    return out


def test_clashing_names_repeated_rows_and_missing_ids(spark, tmp_path):
    r = random.Random(2)
    prose = lambda n: " ".join("".join(r.choices("abcdefghijklm", k=6)) for _ in range(n))
    a, b, c, long = prose(90), prose(80), prose(70), prose(30_000)
    schema = "doc_id long, text string, rejected_by string, n_removed int, n_words int, kept_text string, kept_sha256 string, _gone long, g long, k string, c0 string, x0 int, item_id long, covered int, _f int, part int, label long"
    row = lambda i, t: (i, t, "mine", 1, 2, "kept", "sha", 3, 4, "k", "c", 5, 6, 7, 8, 9, 10)
    docs = [row(1, a), row(1, a), row(1, b), row(2, c), row(3, c + " end"), row(None, prose(60)), row(None, None), row(4, ""), row(5, long)]
    docs += [docs[5], docs[5]]
    quality, near, passages, clean, packed = stages(spark, tmp_path, docs, schema)
    assert len(quality) == 9 and {tuple(x)[2:] for x in quality} == {row(0, "")[2:]}
    ids = lambda rows: sorted(((x.doc_id, x.text) for x in rows), key=str)
    want = sorted([(1, a), (1, b), (2, c), (None, docs[5][1]), (5, long)], key=str)
    assert ids(near) == ids(passages) == ids(clean) == want
    assert {tuple(x)[2:] for x in clean} == {row(0, "")[2:]}
    assert {x.doc_id for x in packed} == {1, 2, None, 5} and sum(x.length for x in packed if x.doc_id == 5) > 2048


def test_empty_table(spark, tmp_path):
    assert stages(spark, tmp_path, [], "doc_id long, text string, lang string, source string, n_chars long") == [[]] * 5
