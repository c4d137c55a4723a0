"""PCA whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

With P^T V P = L L^T, rotations from the right make the columns of L orthogonal: (P L J)(P L J)^T is still V, so the squared norms of the
rotated columns are V's eigenvalues and the columns, at length one, its eigenvectors. No eigenvector is had from V itself, so small eigenvalues
keep their relative precision. Sums over rows are whole numbers and exact, so the result does not depend on how rows are dealt.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows multiplied at once, and how large centred entries may be for these sums to be whole in doubles.
ROWS, MOST = 2048, 1 << 20


def cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L (d x rank, lower triangular) and the order of rows p with v[p][:, p] = L @ L.T; the largest rest of the diagonal goes first.

    It ends where that is within rounding of the first one, which tells the rank.
    """
    d = len(v)
    left, order, out = v.astype(np.float64).copy(), np.arange(d), np.zeros((d, d))
    for k in range(d):
        rest = np.diag(left)[k:]
        at = k + int(np.argmax(rest))
        if left[at, at] <= d * np.finfo(float).eps * np.diag(v).max():
            return out[:, :k], order
        for x in (left, left.T, out):
            x[[k, at]] = x[[at, k]]
        order[[k, at]] = order[[at, k]]
        out[k, k] = np.sqrt(left[k, k])
        out[k + 1 :, k] = left[k + 1 :, k] / out[k, k]
        left[k + 1 :, k + 1 :] -= np.outer(out[k + 1 :, k], out[k + 1 :, k])
    return out, order


def jacobi(columns: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns, rotated in pairs until all are orthogonal to working precision. Pairs of a round have no column in common and turn together."""
    g = columns.copy()
    n = g.shape[1]
    ring = np.append(np.arange(n), np.full(n % 2, -1))
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            i, j = ring[:half], ring[half:][::-1]
            both = (i >= 0) & (j >= 0)
            i, j = i[both], j[both]
            a, b = g[:, i], g[:, j]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            turn = np.abs(ab) > np.finfo(float).eps * np.sqrt(aa * bb) * 4
            if turn.any():
                turned = True
                zeta = (bb - aa)[turn] / (2 * ab[turn])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = 1 / np.hypot(1, t)
                s = c * t
                a, b = a[:, turn], b[:, turn]
                g[:, i[turn]], g[:, j[turn]] = c * a - s * b, s * a + c * b
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if not turned:
            break
    return g


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above zero, falling, and unit eigenvectors as columns."""
    factor, order = cholesky(v)
    g = jacobi(factor)
    out = np.empty_like(g)
    out[order] = g
    norms = np.sqrt((out * out).sum(axis=0))
    falling = np.argsort(-norms, kind="stable")
    return norms[falling] ** 2, out[:, falling] / norms[falling]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers; shorter ones are filled up with zeros."""
    first = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[first[0] : first[-1]]
    size = np.diff(first)
    if (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), dtype=np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(first[:-1] - first[0], size)] = flat
    return out


def whiten(vectors: DataFrame, *, embedding: str = "embedding", keep: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """vectors times their components: component (from 1), n, deviation, whitened, explained, identity_error beside a row's other columns.

    Entries c become x = floor(scale * c) + shift. Components are the unit eigenvectors of the covariance (divisor n) of x over all rows that take part, by falling
    eigenvalue e, at most `keep` and as many as that covariance has rank; so there are no rows where all vectors are equal, nor for an
    empty table. whitened is (x - mean) on the component over sqrt(e), explained is e over the trace, deviation is the sum of (n * x - sum)^2, null where it
    does not fit a long; identity_error is the largest entry of the covariance of all `whitened`, less the identity, as measured on the rows.

    Rows whose vector is null or has a null or non-finite entry go. Null and repeated ids and repeated rows stay, each counted. A vector
    shorter than the longest counts as filled up with entries 0. Scaled entries beyond a long's range count as its ends; sums of
    products must stay below 10**38. The embedding stays as it is; other columns named like the new ones are replaced.

    Three passes over the vectors: sums, products of what is centred first (by the mean at a whole number; the rest of the
    mean, a half at most, is taken off the sum of products as a fraction), and the covariance of the result. What the driver sees are sums of d * d numbers.
    """
    spark = vectors.sparkSession
    made = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    whole = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    others = [c for c in vectors.columns if c not in made]
    rows = vectors.where(F.col(embedding).isNotNull() & whole).select(*others, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("_x"))
    x = rows.select("_x")

    def sums(batches):
        n, total = 0, []
        for b in batches:
            column = b.column(0)
            width = int(np.diff(column.offsets.to_numpy()).max(initial=0))
            own = [int(s) for s in _matrix(column, width).astype(object).sum(axis=0)] if width else []
            total = [a + b for a, b in zip(total + [0] * (len(own) - len(total)), own + [0] * (len(total) - len(own)), strict=True)]
            n += b.num_rows
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(-1, len(total)), pa.int32()), "total": pa.array([str(s) for s in (n, *total)])})

    both = x.mapInArrow(sums, "i int, total string").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # a number for each dimension
    total = {r.i: int(r.total) for r in both}
    n, width = total.pop(-1, 0), len(total)
    if not n or not width:
        return _none(vectors, others)
    mean = [round(Fraction(total[i], n)) for i in range(width)]
    centre = np.array(mean, dtype=np.int64)

    def products(batches):
        held = np.zeros((width, width), dtype=object)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                y = _matrix(b.column(0).slice(at, ROWS), width) - centre
                if np.abs(y).max(initial=0) < MOST:
                    y = y.astype(np.float64)
                    held += (y.T @ y).astype(np.int64)
                else:
                    y = y.astype(object)
                    held += y.T @ y
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "total": pa.array([str(s) for s in held[i, j]])})

    scatter = x.mapInArrow(products, "i int, j int, total string").groupBy("i", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    rest = [total[i] - n * mean[i] for i in range(width)]  # of the mean, times n
    v = np.zeros((width, width))
    for r in scatter:
        v[r.i, r.j] = v[r.j, r.i] = float((Fraction(int(r.total)) - Fraction(rest[r.i] * rest[r.j], n)) / n)
    e, found = components(v)
    e, found = e[:keep], found[:, :keep]
    if not len(e):
        return _none(vectors, others)
    explained = e / np.trace(v)
    onto = found / np.sqrt(e)
    off = np.array([rest[i] / n for i in range(width)])  # from the whole mean to the mean itself
    fits = n * n * width * max(int(np.diag(v).max() * n) + 1, 1) < 1 << 62

    def projected(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        y = _matrix(b.column("_x"), width) - centre
        return y, (y - off) @ onto

    def moments(batches):
        total = np.zeros((len(e) + 1, len(e) + 1))
        for b in batches:
            w = np.column_stack([np.ones(b.num_rows), projected(b)[1]])
            total += w.T @ w
        i, j = np.triu_indices(len(total))
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "total": pa.array(total[i, j])})

    measured = np.zeros((len(e) + 1, len(e) + 1))
    for r in x.mapInArrow(moments, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        measured[r.i, r.j] = measured[r.j, r.i] = r.total / n
    error = float(np.abs(measured[1:, 1:] - np.outer(measured[0, 1:], measured[0, 1:]) - np.eye(len(e))).max())

    def out(batches):
        exact_rest = np.array(rest, dtype=object)
        for b in batches:
            y, w = projected(b)
            if fits:
                deviation = ((n * y - exact_rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
            else:
                deviation = [s if s < 1 << 63 else None for s in ((n * y.astype(object) - exact_rest) ** 2).sum(axis=1).tolist()]
            yield pa.RecordBatch.from_arrays([*(c for c, name in zip(b.columns, b.schema.names, strict=True) if name != "_x"), pa.array(deviation, pa.int64()), pa.array(w.tolist(), pa.list_(pa.float64()))], [*(c for c in b.schema.names if c != "_x"), "deviation", "_w"])

    kept = rows.select(*others)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    each = rows.mapInArrow(out, f"{types}, deviation long, _w array<double>").select("*", F.posexplode("_w").alias("_at", "whitened"))
    share = F.element_at(F.array(*map(F.lit, explained.tolist())), F.col("_at") + 1)
    return each.select(*others, (F.col("_at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def _none(vectors: DataFrame, others: list[str]) -> DataFrame:
    """No rows."""
    null: Column = F.lit(None)
    return vectors.where(F.lit(False)).select(*others, *(null.cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))))
