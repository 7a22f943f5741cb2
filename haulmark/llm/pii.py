"""Personal data by weak supervision: labelers vote on spans, expectation-maximisation weighs them, a classifier decides.

A pass over the documents finds the spans of the base rules and wider candidates with their votes (pii_scan). Votes of all candidates are counted
by pattern in Spark; there are at most 3 ** labelers patterns a kind, so the expectation-maximisation on the driver is bounded, whatever the input is.
The classifier is fitted on a bounded sample of candidates, labelled with the posteriors of their patterns, and judges every candidate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import row_pieces, written
from haulmark.llm.pii_scan import KINDS, LABELERS, N_FEATURES, candidates, joined

CANDIDATE = "struct<kind: int, start: int, end: int, base: boolean, votes: string, features: array<int>>"
COUNTS = [f"n_{k}" for k in KINDS]
SIGNS = {-1: "-", 0: "0", 1: "+"}


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256, and the candidates of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_sha256 string, found array<{CANDIDATE}>"
    fields = pa.list_(
        pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))])
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_pieces(batches):
            counts, hashes, found = [], [], []
            for text in part.column("text").to_pylist():
                base, all_of = candidates(text or "")
                counts.append([sum(s[0] == k for s in base) for k in range(len(KINDS))])
                hashes.append(hashlib.sha256(joined(base).encode()).hexdigest())
                found.append([{"kind": k, "start": a, "end": b, "base": is_base, "votes": "".join(SIGNS[v] for v in said), "features": ones} for k, a, b, is_base, said, ones in all_of])
            columns = [part.column("doc_id"), *[pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))], pa.array(hashes), pa.array(found, fields)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *COUNTS, "base_sha256", "found"])

    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def reliabilities(patterns: dict[str, int], rounds: int = 300) -> tuple[float, np.ndarray, dict[str, float]]:
    """Expectation-maximisation on vote patterns: (share of true ones, P(vote | class) by labeler, class and vote, posterior of each pattern).

    Labelers count as independent given the class. Pseudo-counts say that a labeler is rather right than wrong, so few candidates leave a weighted majority.
    """
    names = list(patterns)
    seen = np.array([patterns[p] for p in names], float)
    vote = np.array([["-0+".index(c) for c in p] for p in names])
    one_hot = np.eye(3)[vote]
    q = 1 / (1 + np.exp(-(vote - 1).sum(axis=1).astype(float)))
    pseudo = np.array([[8.0, 4.0, 2.0], [2.0, 4.0, 8.0]])
    share, table = 0.5, np.zeros((vote.shape[1], 2, 3))
    for _ in range(rounds):
        share = float((2 + seen @ q) / (4 + seen.sum()))
        for y, weight in enumerate((seen * (1 - q), seen * q)):
            mass = np.einsum("p,pmv->mv", weight, one_hot) + pseudo[y]
            table[:, y] = mass / mass.sum(axis=1, keepdims=True)
        log = np.log(table)
        gain = np.log(share / (1 - share)) + np.einsum("pmv,mv->p", one_hot, log[:, 1] - log[:, 0])
        now = 1 / (1 + np.exp(-np.clip(gain, -500, 500)))
        if np.abs(now - q).max() < 1e-10:
            break
        q = now
    return share, table, dict(zip(names, q.tolist(), strict=True))


def classifier(ones: list[list[int]], labels: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton's method with a ridge."""
    x = np.zeros((len(ones), N_FEATURES))
    for row, at in zip(x, ones, strict=True):
        row[at] = 1
    w = np.zeros(N_FEATURES)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (labels - p) - ridge * w
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(N_FEATURES), gradient)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    return w


def fitted(spans: DataFrame, sample: int) -> np.ndarray:
    """Weights for each kind. The labelled sample holds at most `sample` candidates of a kind inside the base and as many outside; hashes choose them."""
    counts = spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()
    weights = np.zeros((len(KINDS), N_FEATURES))
    for kind in range(len(KINDS)):
        patterns = {r.votes: r.n for r in counts if r.kind == kind}
        if not patterns:
            continue
        posterior = reliabilities(patterns)[2]
        rows = []
        for base in (True, False):
            chosen = spans.filter((F.col("kind") == kind) & (F.col("base") == base)).select("votes", "features", F.xxhash64("doc_id", "start", "end").alias("h"))
            rows += chosen.orderBy("h", "votes", "features").limit(sample).collect()
        weights[kind] = classifier([list(r.features) for r in rows], np.array([posterior[r.votes] for r in rows]))
    return weights


def decided(found: list[dict], weights: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
    """The base spans, and further candidates from the likeliest on that overlap nothing taken before."""
    taken = [(c["kind"], c["start"], c["end"]) for c in found if c["base"]]
    score = sorted((-float(weights[c["kind"]][c["features"]].sum()), c["kind"], c["start"], c["end"]) for c in found if not c["base"])
    for low, kind, start, end in score:
        if 1 / (1 + np.exp(np.clip(low, -500, 500))) >= threshold and all(end <= a or b <= start for _, a, b in taken):
            taken.append((kind, start, end))
    return taken


def personal_data(docs: DataFrame, sample: int = 4000, threshold: float = 0.5) -> DataFrame:
    """A row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base rules, and spans, of these and what the method adds.

    Added spans overlap no other; they are wider candidates that the classifier gives `threshold` or more. Null and empty texts have no spans.
    Repeated rows are judged each, a missing doc_id stays missing; an empty table gives an empty result. Other columns aren't read.
    `sample` bounds the labelled rows of the classifier (see fitted); votes are counted over all candidates.
    """
    rows = written(scanned(docs), "pii-candidates")
    spans = rows.select("doc_id", F.explode("found").alias("c")).select("doc_id", "c.*")
    weights = fitted(spans, sample)
    kind = docs.schema["doc_id"].dataType.simpleString()
    keep = ["doc_id", *COUNTS, "base_sha256"]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [joined(decided(found, weights, threshold)) for found in batch.column("found").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(spans, pa.string())], names=[*keep, "spans"])

    return rows.mapInArrow(decide, f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_sha256 string, spans string")


assert len(LABELERS) == 8  # votes are strings of this many signs
