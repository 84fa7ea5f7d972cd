"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Entries become whole numbers x = floor(scale * c) + shift. Two passes over the vectors give
their count and sums, then the scatter about the mean: rows are centred at the whole numbers m
next to the mean before they are multiplied, and as the products are summed exactly as integers,
the rest of the centring (the mean lies within half of m) is exact too and no order of tasks
changes a bit. A pass sends one row for each pair of dimensions and partition, summed before the
driver sees them: it holds the square of the dimensions, whatever the rows. There the scatter gets
its pivoted Cholesky factor, whose columns one-sided Jacobi rotations make orthogonal: the
norms of the rotated columns are the roots of the eigenvalues, the columns over their norms
are the components. A third pass measures the covariance of the whitened rows.

Vectors that are null or hold a null, NaN or infinite entry are left out, and so are those with
an entry whose x is no exact long (over 2**50 in amount). Shorter vectors count as 0 beyond their
length; empty ones are all 0. Rows of one vec_id are judged each on its own, null ids stay.
Components without variance (to double precision) have no whitened value and are not
returned: none at all for one vector or for equal ones, and at most as many as dimensions.
Where deviation does not fit a long it is null. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import offsets_of

#: Rows that are multiplied at once and bits of a limb: products of limbs and their sums stay below 2**53, so that doubles are exact.
ROWS_AT_ONCE, LIMB = 4096, 20
LARGEST = 2.0**50
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(batch: pa.RecordBatch, scale: int, shift: int, width: int | None = None) -> tuple[pa.Array, np.ndarray]:
    """The ids and whole numbers of the rows that count, shorter rows filled with the x of 0."""
    ids, lists = batch.column("vec_id"), batch.column("embedding")
    known = np.asarray(lists.is_valid())
    lens = np.where(known, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    values = lists.flatten().cast(pa.float64())
    x = np.floor(values.fill_null(float("nan")).to_numpy(zero_copy_only=False) * scale)
    odd = ~(np.abs(x) <= LARGEST)
    ends = offsets_of(lens)
    known &= offsets_of(odd)[ends[1:]] == offsets_of(odd)[ends[:-1]]
    width = max(lens, default=0) if width is None else width
    out = np.full((int(known.sum()), width), shift, np.int64)
    rows = np.repeat(np.cumsum(known) - 1, lens)
    places = np.arange(len(x)) - np.repeat(ends[:-1], lens)
    mine = np.repeat(known, lens)
    out[rows[mine], places[mine]] = x[mine].astype(np.int64) + shift
    return ids.filter(pa.array(known)), out


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Doubles l0, l1, ... of half a limb at most with x = l0 + l1 * 2**LIMB + ..."""
    out = []
    while x.any() or not out:
        high = (x + (1 << LIMB - 1)) >> LIMB
        out.append((x - (high << LIMB)).astype(np.float64))
        x = high
    return out


def exact_product(x: np.ndarray) -> np.ndarray:
    """The transpose of x times x in Python integers."""
    total = np.zeros((x.shape[1],) * 2, object)
    for at in range(0, len(x), ROWS_AT_ONCE):
        parts = limbs(x[at : at + ROWS_AT_ONCE])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                total += (a.T @ b).astype(np.int64).astype(object) * (1 << LIMB * (i + j))
    return total


def exact_squares(x: np.ndarray, n: int, rest: list[int]) -> list[int | None]:
    """Sums over the columns of (n * x - rest) ** 2 of each row, None where no long holds it."""
    largest = n * (int(np.abs(x).max(initial=0)) + 1)
    if largest < 1 << 31 and largest**2 * max(1, x.shape[1]) < 1 << 62:
        return ((n * x - np.array(rest, np.int64)) ** 2).sum(1).tolist()
    sums = ((n * x.astype(object) - np.array(rest, object)) ** 2).sum(1)
    return [int(s) if s < 1 << 63 else None for s in sums]


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """A factor m with m @ m.T = a, triangular but for the order of its rows, with as many columns as a has rank to double precision."""
    n, left = len(a), a.astype(np.float64).copy()
    out, free = [], np.ones(n, bool)
    least = n * np.finfo(float).eps * max(0.0, float(np.diag(a).max(initial=0)))
    for _ in range(n):
        diagonal = np.where(free, np.diag(left), -1.0)
        at = int(diagonal.argmax())
        if diagonal[at] <= least:
            break
        column = np.where(free, left[:, at], 0.0) / np.sqrt(diagonal[at])
        left -= np.outer(column, column)
        free[at] = False
        out.append(column)
    return np.array(out).reshape(-1, n).T


def one_sided_jacobi(m: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """m times a rotation that makes its columns orthogonal; half of all columns are rotated against the other half at a time, in rounds of a tournament."""
    m, eps = m.copy(), np.finfo(float).eps
    k = m.shape[1] + m.shape[1] % 2
    seats = np.arange(k)
    for _ in range(sweeps):
        rotated = False
        for _ in range(k - 1):
            pairs = np.sort(np.stack([seats[: k // 2], seats[: k // 2 - 1 : -1]]), axis=0)
            i, j = pairs[:, pairs[1] < m.shape[1]]
            a, b = m[:, i], m[:, j]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            turn = np.abs(ab) > eps * np.sqrt(aa) * np.sqrt(bb)
            if turn.any():
                rotated = True
                i, j, a, b = i[turn], j[turn], a[:, turn], b[:, turn]
                zeta = (bb[turn] - aa[turn]) / (2 * ab[turn])
                tangent = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                cosine = 1 / np.hypot(1.0, tangent)
                sine = cosine * tangent
                m[:, i], m[:, j] = cosine * a - sine * b, sine * a + cosine * b
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not rotated:
            break
    return m


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a covariance."""
    rotated = one_sided_jacobi(pivoted_cholesky(covariance))
    norms = np.sqrt((rotated**2).sum(0))
    order = np.argsort(-norms, kind="stable")[:most]
    return norms[order] ** 2, rotated[:, order] / norms[order]


def summed(rows: DataFrame, keys: list[str]) -> list:
    return rows.groupBy(*keys).agg(F.sum("value").alias("value")).collect()


def decimals(values: list[int]) -> pa.Array:
    from decimal import Decimal

    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def whiten(vectors: DataFrame, most: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector that counts and component."""
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def sums(batches):
        n, total = 0, np.zeros(0, object)
        for batch in batches:
            _, x = whole_vectors(batch, scale, shift)
            if x.shape[1] > len(total):
                # rows before had the x of 0 there
                total = np.concatenate([total, np.full(x.shape[1] - len(total), n * shift, object)])
            for at in range(0, len(x), ROWS_AT_ONCE):
                total[: x.shape[1]] += x[at : at + ROWS_AT_ONCE].sum(0).astype(object)
            total[x.shape[1] :] += len(x) * shift
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([*range(-1, len(total))], pa.int32()), pa.array([n] * (len(total) + 1), pa.int64()), decimals([n, *total])], ["place", "n", "value"])

    # a row for each dimension
    found = vectors.mapInArrow(sums, "place int, n long, value decimal(38,0)").groupBy("place").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).collect()
    n = max((int(r.value) for r in found if r.place < 0), default=0)
    d = max((r.place + 1 for r in found), default=0)
    total = [0] * d
    for r in found:
        if r.place >= 0:
            total[r.place] = int(r.value) + (n - r.n) * shift  # rows of partitions whose vectors are all shorter have the x of 0
    if not n or not d:
        return spark.createDataFrame([], WHITENED)
    middle = [(2 * s + n) // (2 * n) for s in total]
    rest = [s - n * m for s, m in zip(total, middle, strict=True)]
    centre = np.array(middle, np.int64)

    def scatter(batches):
        out = np.zeros((d, d), object)
        for batch in batches:
            _, x = whole_vectors(batch, scale, shift, d)
            out += exact_product(x - centre)
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), decimals(out[i, j])], ["i", "j", "value"])

    exact = np.zeros((d, d), object)
    # a row for each pair of dimensions
    for r in summed(vectors.mapInArrow(scatter, "i int, j int, value decimal(38,0)"), ["i", "j"]):
        exact[r.i, r.j] = exact[r.j, r.i] = int(r.value)
    centred = n * exact - np.outer(np.array(rest, object), np.array(rest, object))
    covariance = np.array([[v / (n * n) for v in row] for row in centred], np.float64)
    values, axes = components(covariance, most)
    explained = (values / np.trace(covariance)).tolist() if len(values) else []
    weights, offset = axes / np.sqrt(values), np.array([r / n for r in rest])
    k = len(values)

    def projected(x: np.ndarray) -> np.ndarray:
        return ((x - centre) - offset) @ weights

    def moments(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = projected(whole_vectors(batch, scale, shift, d)[1])
            first += w.sum(0)
            second += w.T @ w
        i, j = np.indices((k + 1, k)).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.concatenate([second, [first]]).ravel())], ["i", "j", "value"])

    # whitened rows are centred already; what is left of their mean goes too
    sums_of = np.zeros((k + 1, k))
    for r in summed(vectors.mapInArrow(moments, "i int, j int, value double"), ["i", "j"]) if k else []:
        sums_of[r.i, r.j] = r.value
    mean = sums_of[k] / n
    error = float(np.abs(sums_of[:k] / n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))

    def rows(batches):
        for batch in batches:
            ids, x = whole_vectors(batch, scale, shift, d)
            w, far = projected(x), exact_squares(x - centre, n, rest)
            for at in range(0, len(x), ROWS_AT_ONCE):
                part = w[at : at + ROWS_AT_ONCE]
                m = len(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, m).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                        pa.array(far[at : at + m], pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(part.ravel()), pa.array(np.tile(explained, m), pa.float64()), pa.array(np.full(m * k, error)),
                    ],
                    [f.split()[0] for f in WHITENED.split(", ")],
                )

    return vectors.mapInArrow(rows, WHITENED) if k else spark.createDataFrame([], WHITENED)
