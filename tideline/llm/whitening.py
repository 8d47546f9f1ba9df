"""Embedding whitening by a bidiagonal qd solver.

Vectors become whole numbers, so means and deviations are exact. The distinct ones are
centred and reduced to one triangle by blockwise QR: every partition folds its rows into a
triangle of d rows, and triangles are folded 32 at a time until one is left. What follows
works on that d x d triangle alone: Householder reflections make it bidiagonal, dqds (the
differential qd algorithm with shifts) finds the squared singular values, each to high
relative accuracy, and a twisted factorisation for each of them gives its direction.
Squaring the triangle into a covariance, which would lose half the digits, is never done.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.tables import saved

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
FOLDED = 32  # triangles folded by one task
ROWS = 2048  # rows folded at a time
LARGEST = 2.0 ** 53 / SCALE  # entries beyond have no exact whole number
EPS = float(np.finfo(float).eps)
CLOSE = 1e-5  # squared singular values nearer than this, relatively, are made orthogonal to each other


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of a QR factorisation, square even of fewer rows."""
    r = np.linalg.qr(rows, mode="r")
    out = np.zeros((rows.shape[1], rows.shape[1]))
    out[:len(r)] = r
    return out


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and right basis W: matrix = U B W^T with orthogonal U, W."""
    a = matrix.astype(float).copy()
    d = a.shape[1]
    right = np.eye(d)

    def reflector(x):
        v, length = x.copy(), np.linalg.norm(x)
        if length == 0:
            return v
        v[0] += length if v[0] >= 0 else -length
        return v / np.linalg.norm(v)

    for k in range(d):
        v = reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k + 2 < d:
            v = reflector(a[k, k + 1:])
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
            right[:, k + 1:] -= 2 * np.outer(right[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One dqds transform by a shift; None if the shift is past the smallest value."""
    n = len(q)
    q2, e2, d = [0.0] * n, [0.0] * (n - 1), q[0] - shift
    least = d
    for i in range(n - 1):
        q2[i] = d + e[i]
        if d < 0 or q2[i] <= 0:
            return None
        t = q[i + 1] / q2[i]
        e2[i] = e[i] * t
        d = d * t - shift
        least = min(least, d)
    q2[n - 1] = d
    return None if d < 0 else (q2, e2, least)


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix, descending."""
    q, e = [float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in upper]
    if not q:
        return np.zeros(0)
    floor = EPS ** 2 * max(max(q), max(e, default=0.0), 1e-290)
    q = [max(x, floor * EPS) for x in q]  # a zero on the diagonal splits nothing, it is a value far below rounding
    found, shifted, guess = [], 0.0, 0.0
    # A large last entry converges last; start from the smaller end.
    if len(q) > 1 and q[0] < q[-1]:
        q, e = q[::-1], e[::-1]
    while q:
        n = len(q)
        if n == 1:
            found.append(q[0] + shifted)
            break
        if e[-1] <= EPS ** 2 * (shifted + q[-1]) or e[-1] <= floor * EPS:
            found.append(q.pop() + shifted)
            e.pop()
            guess = 0.0
            continue
        near = EPS ** 2
        cut = next((i for i in range(n - 2, -1, -1) if e[i] <= near * (shifted + min(q[i], q[i + 1]))), None)
        if cut is not None:  # two matrices; the values of the upper one are found on their own
            rest = dqds(np.sqrt(q[:cut + 1]), np.sqrt(e[:cut]))
            found += [x + shifted for x in rest]
            q, e, guess = q[cut + 1:], e[cut + 1:], 0.0
            continue
        # smaller value of the last two rows, as a first guess of the shift
        a, b, c = q[-2] + (e[-2] if n > 2 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
        corner = (a + b) / 2 - (((a - b) / 2) ** 2 + c) ** 0.5
        result = None
        for shift in (min(guess, max(corner, 0.0)), 0.5 * min(guess, q[-1]), 0.1 * min(guess, q[-1]), 0.0):
            result = _sweep(q, e, shift)
            if result is not None:
                break
        q, e, least = result
        shifted += shift
        guess = least * (1 - 1e-12) if least > 0 else 0.0
    return np.sort(np.array(found))[::-1]


def twisted(diagonal: np.ndarray, upper: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of B^T B for a squared singular value, from the twist with the least residual."""
    n = len(diagonal)
    d, tiny = diagonal ** 2, EPS ** 2 * max(float(np.max(np.abs(diagonal))) ** 2, 1e-290)
    low = upper / diagonal[:-1]
    down, up = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
    s, p = np.zeros(n), np.zeros(n)
    s[0], p[-1] = -value, d[-1] - value
    for i in range(n - 1):
        pivot = d[i] + s[i]
        pivot = pivot if abs(pivot) > tiny else tiny
        down[i] = d[i] * low[i] / pivot
        s[i + 1] = down[i] * low[i] * s[i] - value
    for i in range(n - 2, -1, -1):
        pivot = d[i] * low[i] ** 2 + p[i + 1]
        pivot = pivot if abs(pivot) > tiny else tiny
        t = d[i] / pivot
        up[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    r = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -up[i] * z[i]
    z /= np.abs(z).max()
    return z / np.linalg.norm(z)


def principal(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest squared singular values of a triangle and their right singular vectors, as columns.

    Where the bidiagonal matrix falls apart, each part is solved on its own; values of one
    part are different, so a twist finds each direction, and the few that are very close
    are made orthogonal. Directions of values below rounding are of no meaning.
    """
    size = matrix.shape[1]
    scale = float(np.abs(matrix).max(initial=0.0))
    if scale == 0 or not count:
        return np.zeros(min(count, size)), np.eye(size)[:, :count]
    diagonal, upper, right = bidiagonal(matrix / scale)
    norm = float(np.max(np.abs(diagonal)) + np.max(np.abs(upper), initial=0.0))
    diagonal = np.where(np.abs(diagonal) < EPS ** 2 * norm, EPS ** 2 * norm, diagonal)
    upper = np.where(np.abs(upper) <= EPS * np.minimum(np.abs(diagonal[:-1]), np.abs(diagonal[1:])) + 8 * EPS * norm, 0.0, upper)
    edges = [0, *(np.flatnonzero(upper == 0) + 1).tolist(), size]
    found = []
    for a, b in zip(edges[:-1], edges[1:]):
        found += [(value, a, b) for value in dqds(diagonal[a:b], upper[a:b - 1])]
    found.sort(key=lambda f: -f[0])
    vectors = np.zeros((size, min(count, size)))
    for k, (value, a, b) in enumerate(found[:count]):
        z = twisted(diagonal[a:b], upper[a:b - 1], value)
        near = vectors[a:b, [j for j in range(k) if found[j][1] == a and found[j][0] - value <= CLOSE * found[j][0]]]
        rest = z - near @ (near.T @ z)
        if np.linalg.norm(rest) < 0.5:
            # values equal to rounding share their directions: turn another vector towards them, away from those found
            block = np.diag(diagonal[a:b]) + np.diag(upper[a:b - 1], 1)
            moved = block.T @ block - np.eye(b - a) * (value + 4 * EPS * norm ** 2)
            rest = np.random.default_rng(k).normal(size=b - a)
            for _ in range(4):
                rest = np.linalg.solve(moved, rest - near @ (near.T @ rest))
                rest = rest / np.linalg.norm(rest)
                rest = rest - near @ (near.T @ rest)
        rest = rest - near @ (near.T @ rest)
        vectors[a:b, k] = rest / np.linalg.norm(rest)
    return np.array([f[0] for f in found[:count]]) * scale ** 2, right @ vectors


def whole(vector: str) -> Column:
    """floor(64 c) + 1,000,000 of every entry."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + OFFSET)


def _rows(column: pa.Array, size: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(-1, size) if size else np.zeros((len(column), 0), np.int64)


def _spread(partials: DataFrame, names: list[str], d: int) -> dict[str, list]:
    """Sums over all partitions of arrays of the same length, element by element; d rows reach the driver."""
    parts = partials.select(F.posexplode(F.arrays_zip(*names)).alias("i", "v"))
    summed = parts.groupBy("i").agg(*[F.sum(f"v.{n}").alias(n) for n in names])
    out = {n: [0] * d for n in names}
    for r in summed.collect():
        for n in names:
            out[n][r["i"]] = r[n]
    return out


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates: a row for each vector and component, with the columns of the contract.

    Rows whose vector is null or holds null or non-finite entries are dropped, and so are
    entries of 2**47 and more in absolute value, which have no exact whole number. The dimension is the
    most frequent length (the longest of equally frequent ones); other lengths are dropped.
    Repeated rows and null keys stay. A component without variance, as with fewer distinct
    vectors than components, has whitened null; explained is null if nothing varies, and
    ``identity_error`` is over the components that have variance, null without any. A deviation
    beyond the range of long is null. Vectors of no entries and empty tables give no rows.
    Only the two named columns are read.
    """
    rows = df.select(F.col(key).alias("vec_id"), F.col(vector).alias("v"))
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < LARGEST))
    rows = rows.where(F.col("v").isNotNull() & good)
    kind = df.schema[key].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None or lengths["d"] == 0:
        return df.sparkSession.createDataFrame([], schema)
    d = lengths["d"]
    rows = rows.where(F.size("v") == d).select("vec_id", whole("v").alias("x"))
    fit = saved(rows.select("x").distinct(), "whitening_fit")

    def sums(batches):
        high, low, n = np.zeros(d, np.int64), np.zeros(d, np.int64), 0
        for batch in batches:
            x = _rows(batch.column(0), d)
            high, low, n = high + (x >> 26).sum(axis=0), low + (x & ((1 << 26) - 1)).sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array([high.tolist()], pa.list_(pa.int64())), pa.array([low.tolist()], pa.list_(pa.int64())),
             pa.array([[n] * d], pa.list_(pa.int64()))], ["high", "low", "n"])

    found = _spread(fit.mapInArrow(sums, "high array<long>, low array<long>, n array<long>"), ["high", "low", "n"], d)
    n = found["n"][0]
    total = [(h << 26) + lo for h, lo in zip(found["high"], found["low"])]
    mean = np.array([s // n for s in total], np.int64)
    left = np.array([s % n for s in total], np.int64)

    def centred(x):
        return (x - mean) - left / n

    def fold(batches):
        r = np.zeros((d, d))
        some = False
        for batch in batches:
            x = _rows(batch.column(0), d)
            for lo in range(0, len(x), ROWS):
                r, some = triangle(np.vstack([r, centred(x[lo:lo + ROWS])])), True
        if some:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()]), pa.array([r.ravel().tolist()])], ["part", "r"])

    def fold_again(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, values in zip(batch.column("part").to_pylist(), batch.column("r").to_pylist()):
                own = held.get(part, np.zeros((d, d)))
                held[part] = triangle(np.vstack([own, np.array(values).reshape(d, d)]))
        for part, r in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([r.ravel().tolist()])], ["part", "r"])

    kind_r = "part long, r array<double>"
    parts, triangles = fit.rdd.getNumPartitions(), fit.mapInArrow(fold, kind_r)
    while parts > 1:
        parts = -(-parts // FOLDED)
        again = triangles.select(F.expr(f"part div {FOLDED}").alias("part"), "r").repartition(parts, "part")
        triangles = again.sortWithinPartitions("part").mapInArrow(fold_again, kind_r)
    one = triangles.first()
    r = np.array(one["r"]).reshape(d, d)
    squares, directions = principal(r, min(components, d))
    values, trace = squares / n, float((r ** 2).sum()) / n
    alive = np.sqrt(squares) > 8 * d * EPS * float(np.sqrt(squares.max(initial=0.0)))
    project = directions / np.where(alive, np.sqrt(values), 1.0)
    k = len(values)

    def moments(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            z = centred(_rows(batch.column(0), d)) @ project
            first, second = first + z.sum(axis=0), second + z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([first, second.ravel()]).tolist()], pa.list_(pa.float64()))], ["m"])

    moment = np.array(_spread(fit.mapInArrow(moments, "m array<double>"), ["m"], k + k * k)["m"], float) / n
    covariance = moment[k:].reshape(k, k) - np.outer(moment[:k], moment[:k])
    error = float(np.abs(covariance - np.eye(k))[np.ix_(alive, alive)].max()) if alive.any() else None
    share = (values / trace).tolist() if trace > 0 else [None] * k

    def deviations(x):
        t = x - mean
        if float(np.abs(t).max(initial=0)) * n + n < 2.0 ** 31 / d ** 0.5:
            t = n * t - left
            return (t * t).sum(axis=1).tolist()
        exact = [sum((n * a - b) ** 2 for a, b in zip(row, left.tolist())) for row in t.tolist()]
        return [v if v < 1 << 63 else None for v in exact]

    def apply(batches):
        for batch in batches:
            x = _rows(batch.column("x"), d)
            for lo in range(0, len(x), ROWS):
                part = x[lo:lo + ROWS]
                m = len(part)
                z = centred(part) @ project
                owner = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").slice(lo, m).take(pa.array(owner)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, n)), pa.array(deviations(part), pa.int64()).take(pa.array(owner)),
                     pa.array(z.ravel(), mask=np.tile(~alive, m)), pa.array(share * m, pa.float64()), pa.array([error] * (m * k), pa.float64())],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(apply, schema)
