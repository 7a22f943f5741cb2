"""Embedding whitening: leading components of the covariance by LOBPCG, whose products with blocks of vectors are Spark jobs over centred rows.

The driver holds matrices of the dimension by a few columns; rows stay where they are. Each step multiplies one block, and Rayleigh-Ritz runs on the
span of the iterate, its residuals and the previous directions. The steps end when residuals of a fresh product are within the tolerance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import written

#: Rows of a piece hold about so many numbers, so that numpy's arrays stay small whatever the dimension is.
NUMBERS = 1 << 19


def quantised(df: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """The rows, with x = floor(scale * entry) as longs. Rows whose vector is null or has null or non-finite entries go."""
    c = F.col(vector)
    finite = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    # conditions of one filter may run in any order; a null vector passes neither
    return df.filter(c.isNotNull() & finite).withColumn("x", F.transform(c, lambda e: F.floor(e.cast("double") * scale).cast("long")))


def pieces(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, NUMBERS // d)
    for batch in batches:
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d)


def exact(x: np.ndarray, most: int) -> np.ndarray:
    """x in a type in which results up to most are exact: longs, or Python's integers."""
    return x if most < 1 << 63 else x.astype(object)


def largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min()))


def summed(fit: DataFrame, d: int, partial, kind: str) -> np.ndarray:
    """The sums over tasks of the cells that partial(pieces) gives for each task; Spark adds them up, cell by cell."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.asarray(partial(pieces(batches, d))).ravel()
        values = pa.array([str(v) for v in got.tolist()]) if kind != "double" else pa.array(got.astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(got), dtype=np.int64)), values], names=["cell", "value"])

    out = fit.select("x").mapInArrow(cells, f"cell long, value {'double' if kind == 'double' else 'string'}")
    rows = out.groupBy("cell").agg(F.sum(F.col("value").cast(kind)).alias("value")).orderBy("cell").collect()
    return np.array([r.value if kind == "double" else int(r.value) for r in rows], dtype=np.float64 if kind == "double" else object)


@dataclass(frozen=True)
class Fit:
    """What the fit list has: n vectors, their sums and mean, and the trace of the covariance."""

    n: int
    sums: list[int]
    mean: np.ndarray
    trace: float


def totals(fit: DataFrame, d: int) -> Fit:
    def sums(parts):
        n, out = 0, np.zeros(d, object)
        for _, x in parts:
            n += len(x)
            out = out + exact(x, largest(x) * len(x)).sum(axis=0)
        return np.append(out, n)

    *s, n = summed(fit, d, sums, "decimal(38,0)").tolist()
    mean = np.array([v / n for v in s])

    def squares(parts):
        out = np.zeros(1)
        for _, x in parts:
            out += np.square(x - mean).sum()
        return out

    return Fit(n, s, mean, float(summed(fit, d, squares, "double")[0]) / n)


def covariance_times(fit: DataFrame, mean: np.ndarray, n: int, block: np.ndarray) -> np.ndarray:
    """The covariance times a block of columns, without the covariance: centred rows meet the block and go back transposed."""

    def partial(parts):
        out = np.zeros(block.shape)
        for _, x in parts:
            centred = x - mean
            out += centred.T @ (centred @ block)
        return out

    return summed(fit, len(mean), partial, "double").reshape(block.shape) / n


def orthonormal(block: np.ndarray, against: list[np.ndarray], least: float) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """An orthonormal basis of what block has outside of `against`: (basis, parts that were taken off, map from block to basis)."""
    block, taken = block.copy(), [np.zeros((b.shape[1], block.shape[1])) for b in against]
    for _ in range(2):
        for b, t in zip(against, taken, strict=True):
            part = b.T @ block
            block -= b @ part
            t += part
    u, s, vt = np.linalg.svd(block, full_matrices=False)
    keep = s > least * max(1e-300, s.max(initial=0))
    return u[:, keep], taken, vt[keep].T / s[keep]


def lobpcg(product, d: int, trace: float, wanted: int, guard: int = 8, tolerance: float = 1e-13, most: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues and their unit vectors of the symmetric operator `product`.

    `guard` further columns speed up convergence. Residuals are certified on a fresh product: at most tolerance times the largest eigenvalue,
    or, where rounding keeps them above it, as small as three fresh products in a row could make them, 1e-10 at most.
    """
    k = min(d, wanted + guard)
    x = np.linalg.qr(np.random.default_rng(13).standard_normal((d, k)))[0]
    ax, p, ap, fresh, certified = product(x), np.zeros((d, 0)), np.zeros((d, 0)), True, []
    for _ in range(most):
        theta, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        order = np.argsort(-theta)
        theta, turn = theta[order], turn[:, order]
        x, ax = x @ turn, ax @ turn
        residual = ax - x * theta
        norm = float(np.linalg.norm(residual[:, :wanted], axis=0).max()) / max(theta[0], 1e-300)
        if theta[0] <= 1e-14 * trace:
            return theta[:wanted], x[:, :wanted]
        if fresh:
            certified.append(norm)
            if norm <= tolerance or (norm <= 1e-10 and len(certified) > 3 and norm > min(certified[-4:-1]) / 2):
                return theta[:wanted], x[:, :wanted]
        elif norm <= tolerance:
            x = np.linalg.qr(x)[0]
            ax, fresh = product(x), True
            continue
        w, _, _ = orthonormal(residual, [x], 1e-12)
        if not w.shape[1]:
            x = np.linalg.qr(x)[0]
            ax, fresh = product(x), True
            continue
        aw, fresh = product(w), False
        q, taken, back = orthonormal(p, [x, w], 1e-7) if p.shape[1] else (p, [], None)
        aq = (ap - ax @ taken[0] - aw @ taken[1]) @ back if p.shape[1] else ap
        basis, image = np.hstack([x, w, q]), np.hstack([ax, aw, aq])
        gram = basis.T @ image
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        c = vectors[:, np.argsort(-values)[:k]]
        m = x.shape[1]
        x, ax, p, ap = basis @ c, image @ c, basis[:, m:] @ c[m:], image[:, m:] @ c[m:]
    raise ArithmeticError(f"residuals stay at {norm} times the largest eigenvalue after {most} steps")


def whiten(rows: DataFrame, fit: Fit, values: np.ndarray, vectors: np.ndarray, key: str = "vec_id", **constant: float) -> DataFrame:
    """A row for each row and component: n, deviation, whitened, explained, and the constants."""
    d, k = vectors.shape
    scaled, sums = vectors / np.sqrt(values), np.array(fit.sums, dtype=object)
    top = max((abs(s) for s in fit.sums), default=0)
    explained = values / fit.trace
    kind = rows.schema[key].dataType.simpleString()
    fields = [("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64())]

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in pieces(batches, d):
            m = len(x)
            most = d * (fit.n * largest(x) + top) ** 2
            deviation = ((fit.n * exact(x, most) - exact(sums if most >= 1 << 63 else sums.astype(np.int64), most)) ** 2).sum(axis=1)
            if most >= 1 << 63 and max(deviation) >= 1 << 63:
                raise OverflowError("a deviation doesn't fit a long")
            z = (x - fit.mean) @ scaled
            columns = {
                key: part.column(key).take(pa.array(np.repeat(np.arange(m), k))),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                "n": pa.array(np.full(m * k, fit.n)),
                "deviation": pa.array(np.repeat(deviation.astype(np.int64), k)),
                "whitened": pa.array(z.ravel()),
                "explained": pa.array(np.tile(explained, m)),
            }
            columns |= {name: pa.array(np.full(m * k, value)) for name, value in constant.items()}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = f"`{key}` {kind}, component int, " + ", ".join(f"{n} {'long' if t == pa.int64() else 'double'}" for n, t in fields) + "".join(f", {n} double" for n in constant)
    return rows.select(key, "x").mapInArrow(out, schema)


def identity_error(fit: DataFrame, found: Fit, values: np.ndarray, vectors: np.ndarray) -> float:
    """How far the covariance of the whitened fit list is from the identity, by its worst entry."""
    scaled, k = vectors / np.sqrt(values), vectors.shape[1]

    def partial(parts):
        out = np.zeros((k + 1, k))
        for _, x in parts:
            z = (x - found.mean) @ scaled
            out[:k] += z.T @ z
            out[k] += z.sum(axis=0)
        return out

    got = summed(fit, len(found.mean), partial, "double").reshape(k + 1, k) / found.n
    return float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())


def embedding_whitening(embeddings: DataFrame, components: int = 4) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries go, and so do those of another length than most have (ties: the longer).
    Repeated vectors count once in the fit and have rows each; a missing vec_id stays missing. Components without variance (at most 1e-12 of the
    trace) have no rows: there are fewer than `components` then, and none if all vectors are equal or the table is empty. Other columns aren't
    read. Entries beyond 2^63 / 256 are cut off there; a deviation that doesn't fit a long raises OverflowError.
    """
    rows = quantised(embeddings.select("vec_id", "embedding")).select("vec_id", "x")
    first = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if first is None or first.d == 0:
        return none(rows)
    rows = rows.filter(F.size("x") == first.d)
    fit = written(rows.select("x").distinct(), "whitening-fit")
    found = totals(fit, first.d)
    if not found.trace:
        return none(rows)
    values, vectors = lobpcg(lambda block: covariance_times(fit, found.mean, found.n, block), first.d, found.trace, min(components, first.d))
    held = values > 1e-12 * found.trace
    values, vectors = values[held], vectors[:, held]
    return whiten(rows, found, values, vectors, identity_error=identity_error(fit, found, values, vectors))


def none(rows: DataFrame) -> DataFrame:
    kinds = {"n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}
    return rows.filter("false").select("vec_id", F.lit(1).alias("component"), *[F.lit(0).cast(kind).alias(c) for c, kind in kinds.items()])
