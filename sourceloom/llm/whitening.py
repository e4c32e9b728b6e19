"""Embedding whitening: the leading eigenpairs of the covariance by Jacobi-Davidson, with products that Spark sums over the vectors.

The covariance is never formed. A product of it with a narrow block is one job: each task centres its vectors, multiplies them with the block and with the result's transpose, and
the tasks' sums meet by way of a number of partial sums that grows with the root of the number of tasks. What reaches the driver has the size of dimensions x block.

The search space begins with a random block. Rayleigh-Ritz in it gives approximate pairs; those in front whose residuals are as small as double precision allows are locked and the space is kept
orthogonal to them; for the next ones the projected correction equation (I - QQ')(A - theta)(I - QQ') t = -r is solved by a few MINRES steps, all of a block at once, so that a step is one
product, and the corrections widen the space. When it holds too many directions it restarts from its best Ritz vectors. It ends when all wanted pairs are locked and nothing that is left exceeds them.

An entry c becomes x = floor(64 c) + 1,000,000. The sums of x over all vectors are exact integers, and centring takes off the whole part of the mean before its fraction, so no digits are lost.

Defined cases: vectors that are null or hold a null, NaN, infinite or very large entry (64 |c| of 2^44 or more) are dropped, and so are vectors whose length is not the most frequent one (of ties the longest); repeated
vectors and ids count as often as they come; a table without vectors, or without variance, gives an empty result; components whose variance is below ``RANK`` of the largest are left out, as there is nothing to
divide by; a deviation that does not fit a long is null. Only id and vector are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.plans.durable import Workspace

COMPONENTS = 32
LIMIT = 2.0**44
PACK = 4096  # vectors in a stored row, at most
GUARD = 8  # directions beyond the wanted ones
STEPS = 6  # of MINRES
RANK = 1e-9
ROUNDS = 200


def usable(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, x) for each length of vectors in a column: the places of the usable vectors, and their x by rows."""
    places = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    column = column.drop_null()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False) * 64.0
    begin = np.cumsum(lengths) - lengths
    bad = np.flatnonzero(~(np.abs(flat) < LIMIT))
    good = lengths > 0
    good[np.searchsorted(begin + lengths, bad, "right")] = False
    for length in np.unique(lengths[good]).tolist():
        own = np.flatnonzero(good & (lengths == length))
        rows = flat[begin[own][:, None] + np.arange(length)]
        yield length, places[own], np.floor(rows).astype(np.int64) + 1_000_000


@dataclass
class Vectors:
    """The packed x of all vectors of one length, their number and exact sums, and how to run sums over them."""

    packed: DataFrame
    n: int
    sums: list[int]

    @property
    def low(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """What the sums are above n times the whole part of the mean."""
        return np.array([s % self.n for s in self.sums], np.int64)

    def total(self, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum of f(centred vectors) over all packed rows, in an order that a repeated task does not change."""
        low, part = self.low, self.rest / self.n
        slots = math.isqrt(max(1, self.packed.rdd.getNumPartitions() - 1)) + 1

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, at = None, TaskContext.get().partitionId()
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    y = (np.frombuffer(raw, "<i8").reshape(-1, len(low)) - low).astype(float) - part
                    out = f(y) if out is None else out + f(y)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([at % slots], pa.int32()), pa.array([at], pa.int32()), pa.array([out.astype("<f8").tobytes()], pa.binary())], names=["slot", "at", "sum"])

        def join(table: pa.Table) -> pa.Table:
            table = table.sort_by("at")
            out = sum(np.frombuffer(x, "<f8") for x in table.column("sum").to_pylist())
            return pa.table({"slot": table.column("slot")[:1], "sum": pa.array([out.tobytes()], pa.binary())})

        sums = self.packed.select("x").mapInArrow(partial, "slot int, at int, sum binary")
        met = sums.groupBy("slot").applyInArrow(join, "slot int, sum binary").collect()
        return sum(np.frombuffer(r.sum, "<f8") for r in sorted(met, key=lambda r: r.slot))


def pack(vectors: DataFrame, work: Workspace, vector: str = "embedding") -> Vectors | None:
    """The usable vectors of the most frequent length, in a table of the workspace; None without any."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, x in usable(batch.column(0)):
                step = max(1, min(PACK, (1 << 22) // length))
                parts = [x[k : k + step] for k in range(0, len(x), step)]
                cols = [pa.array([length] * len(parts), pa.int32()), pa.array([len(p) for p in parts], pa.int64()), pa.array([p.astype("<i8").tobytes() for p in parts], pa.binary()), pa.array([p.sum(0).tolist() for p in parts], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["length", "n", "x", "sums"])

    table = work.keep(vectors.select(vector).mapInArrow(scan, "length int, n long, x binary, sums array<long>"))
    best = table.groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    if best is None:
        work.drop(table)
        return None
    own = work.drops_with(table.where(F.col("length") == best.length), table)
    sums = own.select(F.posexplode("sums").alias("pos", "s")).groupBy("pos").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("pos").collect()
    return Vectors(own, best.n, [int(r.s) for r in sums])


def minres(apply: Callable[[np.ndarray], np.ndarray], rhs: np.ndarray, steps: int, tol: float) -> np.ndarray:
    """Approximate solutions of symmetric systems, one a column, after some steps; each step applies the operator to all columns at once."""
    x, before, w, w_before = (np.zeros_like(rhs) for _ in range(4))
    beta = np.linalg.norm(rhs, axis=0)
    safe = lambda v: np.where(v > 0, v, 1.0)
    eta, goal = beta.copy(), tol * beta
    v = rhs / safe(beta)
    c = c_before = np.ones_like(beta)
    s = s_before = np.zeros_like(beta)
    for _ in range(steps):
        p = apply(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - beta * before
        fresh = np.linalg.norm(p, axis=0)
        delta = c * alpha - c_before * s * beta
        rho = safe(np.hypot(delta, fresh))
        w, w_before = (v - (s_before * beta) * w_before - (s * alpha + c_before * c * beta) * w) / rho, w
        c_before, s_before, c, s = c, s, delta / rho, fresh / rho
        x = x + (c * eta) * w
        eta = -s * eta
        before, v, beta = v, p / safe(fresh), fresh
        if (np.abs(eta) <= goal).all():
            break
    return x


def _orthonormal(t: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """The directions of t that the given orthonormal columns do not hold, without those that rounding alone makes."""
    norm = np.linalg.norm(t, axis=0)
    t = t[:, norm > 0] / norm[norm > 0]
    for _ in range(2):
        for q in against:
            t = t - q @ (q.T @ t)
        if t.shape[1]:
            u, size, _ = np.linalg.svd(t, full_matrices=False)
            t = u[:, size > 1e-10]
    return t


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors of a symmetric operator without negative eigenvalues."""
    k = min(k, d)
    most = min(d, 3 * (k + GUARD))
    locked, values = np.zeros((d, 0)), []
    space = _orthonormal(np.random.default_rng(seed).standard_normal((d, min(d, k + GUARD))))
    image = product(space)
    top, smallest = 0.0, math.inf
    for turn in range(ROUNDS):
        small = space.T @ image
        theta, turned = np.linalg.eigh((small + small.T) / 2)
        theta, turned = theta[::-1], turned[:, ::-1]
        space, image = space @ turned, image @ turned
        left = image - space * theta
        residual = np.linalg.norm(left, axis=0)
        top = max(top, theta[0] if len(theta) else 0.0)
        precise = 4 * max(d, 64) * np.finfo(float).eps * top
        full = space.shape[1] + locked.shape[1] >= d
        if full and len(residual) and residual.max() > precise:
            # The space is all there is: what is left is the rounding of images that restarts carried on.
            image = product(space)
            left = image - space * theta
            residual, precise = np.linalg.norm(left, axis=0), math.inf
        wanted = lambda: len(values) < k or (len(theta) and theta[0] > min(values) + precise)  # noqa: B023, E731
        while len(theta) and residual[0] <= precise and wanted():
            locked, values = np.column_stack([locked, space[:, 0]]), [*values, float(theta[0])]
            space, image, theta, left, residual = space[:, 1:], image[:, 1:], theta[1:], left[:, 1:], residual[1:]
        if not wanted():
            break
        if space.shape[1] + k > most - locked.shape[1] // 2 and space.shape[1] > k + GUARD:
            space, image, theta, left = (x[..., : k + GUARD] for x in (space, image, theta, left))
        active = max(1, min(k - len(values), space.shape[1]))
        near = np.column_stack([locked, space[:, :active]])
        outside = lambda x: x - near @ (near.T @ x)  # noqa: B023, E731
        shift = theta[:active]
        apply = lambda v: outside(product(outside(v)) - shift * outside(v))  # noqa: B023, E731
        fresh = minres(apply, -outside(left[:, :active]), STEPS, 2.0 ** -(turn + 1))
        fresh = _orthonormal(fresh, locked, space)
        if not fresh.shape[1]:
            fresh = _orthonormal(np.random.default_rng(seed + turn + 1).standard_normal((d, GUARD)), locked, space)
        fresh = fresh[:, : d - space.shape[1] - locked.shape[1]]
        space, image = np.column_stack([space, fresh]), np.column_stack([image, product(fresh) if fresh.shape[1] else fresh])
    else:
        raise ArithmeticError(f"{len(values)} of {k} eigenpairs after {ROUNDS} rounds")
    order = np.argsort(-np.array(values), kind="stable")[:k]
    vectors = locked[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return np.array(values)[order], vectors * sign


@dataclass(frozen=True)
class Whitening:
    """A fitted transformation: number of vectors and exact sums, components by columns, their variances and shares, and the error of the whitened covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float


def fit(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> Whitening | None:
    """The whitening of all usable vectors; None where there are none or all are the same."""
    work = Workspace(vectors.sparkSession)
    rows = pack(vectors, work, vector)
    if rows is None:
        return None
    d, n = len(rows.sums), rows.n
    trace = float(rows.total(lambda y: np.array([np.square(y).sum()]))[0] / n)
    if trace == 0:
        work.drop(rows.packed)
        return None
    product = lambda b: rows.total(lambda y: (y.T @ (y @ b)).ravel()).reshape(d, -1) / n
    values, axes = jacobi_davidson(product, d, components)
    good = values > RANK * values[0]
    values, axes = values[good], axes[:, good]
    scaled = axes / np.sqrt(values)
    k = len(values)

    def moments(y: np.ndarray) -> np.ndarray:
        z = y @ scaled
        return np.concatenate([z.sum(0), (z.T @ z).ravel()])

    met = rows.total(moments)
    mean, square = met[:k] / n, met[k:].reshape(k, k) / n
    error = float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())
    work.drop(rows.packed)
    return Whitening(n, rows.sums, axes, values, values / trace, error)


def _deviations(y: np.ndarray, rest: np.ndarray, n: int) -> list[int | None]:
    """The sums of (n x - S)^2, exact; None where one does not fit a long."""
    reach = (int(np.abs(y).max()) + 1) * n + n if y.size else 0
    if reach * reach * y.shape[1] < 1 << 63:
        return np.square(y * n - rest).sum(1).tolist()
    exact = [sum((n * a - b) ** 2 for a, b in zip(row, rest.tolist())) for row in y.tolist()]
    return [x if x < 1 << 63 else None for x in exact]


def whiten(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, deviation, whitened) for each vector that the fit takes: the squared distance of n x from the sums, and the whitened vector."""
    low = np.array([s // model.n for s in model.sums], np.int64)
    rest = np.array([s % model.n for s in model.sums], np.int64)
    n, scaled = model.n, model.components / np.sqrt(model.variances)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, places, x in usable(batch.column(1)):
                if length == len(low):
                    y = x - low
                    z = (y.astype(float) - rest / n) @ scaled
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places)), pa.array(_deviations(y, rest, n), pa.int64()), flat], names=["id", "deviation", "whitened"])

    schema = f"id {vectors.schema[id_col].dataType.simpleString()}, deviation long, whitened array<double>"
    return vectors.select(F.col(id_col).alias("id"), vector).mapInArrow(scan, schema).withColumnRenamed("id", id_col)


def whitened_components(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component, numbered from 1."""
    names = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    model = fit(vectors, components, vector)
    if model is None:
        kinds = ("int", "long", "long", "double", "double", "double")
        return vectors.limit(0).select(id_col, *(F.lit(None).cast(t).alias(c) for c, t in zip(names, kinds)))
    rows = whiten(vectors, model, id_col, vector).select(id_col, "deviation", F.posexplode("whitened").alias("pos", "whitened"))
    shares = F.array(*(F.lit(float(x)) for x in model.explained))
    return rows.select(
        id_col, (F.col("pos") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("pos") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error")
    )
