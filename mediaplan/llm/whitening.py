"""Embedding whitening by Jacobi-Davidson iterations.

The covariance is never formed. A product of it with a few vectors is one pass over the
stored table: every task centres its rows, multiplies them with the vectors and sums
(x - mean) ((x - mean) . v). The driver holds a subspace of at most ``BASIS`` vectors and does the
Rayleigh-Ritz steps; corrections come from MINRES on the projected equation, all open pairs in
step, so that one pass serves all of them. A pair is locked once its residual is within
rounding of the largest eigenvalue; locked pairs stay in the basis and take no part in corrections."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from mediaplan.sources.tables import keep

COMPONENTS = 8
#: Entries become floor(1024 * entry) + 100000.
SCALE, SHIFT = 1024.0, 100_000
#: Entries beyond this size are held at it, so that whole numbers stay exact in doubles.
LARGEST = float(1 << 43)
BASIS, INNER, INNER_GOAL, OUTER = 64, 8, 0.02, 400
ROUNDING = 100 * np.finfo(float).eps
#: Bytes of a stored block of rows.
BLOCK_BYTES = 4_000_000
_LONG = 2**63 - 1


def whole_numbers(docs: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Blocks of rows as whole numbers: (dim, ids, x), x being row-major longs. Rows whose vector
    is null, empty, or holds null or non-finite entries are left out."""

    def pack(batches):
        for batch in batches:
            lists, ids = batch.column("v"), batch.column("id")
            if pa.types.is_large_list(lists.type):
                lists = lists.cast(pa.list_(lists.type.value_type))
            flat = lists.flatten()
            entry = np.asarray(flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False))
            size = np.asarray(pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
            first = np.cumsum(size) - size
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(entry))])
            good = (size > 0) & (bad[first + size] == bad[first])
            x = (np.floor(np.clip(np.where(np.isfinite(entry), entry, 0.0), -LARGEST / SCALE, LARGEST / SCALE) * SCALE)).astype(np.int64) + SHIFT
            for dim in np.unique(size[good]):
                rows = np.flatnonzero(good & (size == dim))
                step = max(1, BLOCK_BYTES // (8 * int(dim)))
                for i in range(0, len(rows), step):
                    part = rows[i:i + step]
                    block = x[first[part][:, None] + np.arange(dim)]
                    yield pa.RecordBatch.from_arrays([pa.array([int(dim)], pa.int64()), pa.array([ids.take(pa.array(part)).to_pylist()], pa.list_(pa.int64())),
                                                      pa.array([block.tobytes()], pa.binary())], ["dim", "ids", "x"])

    given = docs.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"))
    return given.mapInArrow(pack, "dim long, ids array<long>, x binary")


def rows_of(batch: pa.RecordBatch, dim: int):
    """(ids, rows) of every stored block."""
    for ids, x in zip(batch.column("ids"), batch.column("x")):
        yield ids.values, np.frombuffer(x.as_buffer(), np.int64).reshape(-1, dim)


class Fit:
    """Number of rows, exact sums and, by passes, products of the covariance of the stored rows."""

    def __init__(self, blocks: DataFrame, dim: int, n: int, sums: list[int]):
        self.blocks, self.dim, self.n, self.sums = blocks, dim, n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)
        self.passes = 0

    @classmethod
    def of(cls, blocks: DataFrame) -> Fit | None:
        """Of the vectors of the length that most rows have (of equal ones the longest); None without rows."""
        lengths = blocks.groupBy("dim").agg(F.sum(F.size("ids")).alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
        if not lengths:
            return None
        dim, n = lengths[0]["dim"], lengths[0]["n"]
        blocks = blocks.filter(F.col("dim") == dim)

        def add(batches):
            total = np.zeros(dim, object)
            for batch in batches:
                for _, x in rows_of(batch, dim):
                    total += x.sum(axis=0)  # a block's sum stays within a long
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int64()), pa.array([str(int(t)) for t in total])], ["slot", "part"])

        sums = blocks.select("ids", "x").mapInArrow(add, "slot long, part string").groupBy("slot").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s"))
        found = {r["slot"]: int(r["s"]) for r in sums.collect()}
        return cls(blocks, dim, n, [found[i] for i in range(dim)])

    def scaled(self, x: np.ndarray, whole: np.ndarray | None = None) -> np.ndarray:
        """n * x - S, exact: longs, or Python's whole numbers where those are too short."""
        off = x - self.whole
        if int(np.abs(off).max(initial=0)) + 1 < _LONG // max(self.n, 1):
            return self.n * off - self.rest
        return self.n * off.astype(object) - self.rest.astype(object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once."""
        return (self.scaled(x) / self.n).astype(float)

    def sums_over(self, work: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """Sum of ``work`` over the centred rows of all blocks: a task sums its own, Spark sums those by cell."""
        self.passes += 1
        fit = _Centre(self)
        size = int(np.prod(shape))

        def partial(batches):
            total = np.zeros(size)
            for batch in batches:
                for _, x in rows_of(batch, fit.dim):
                    total += work(fit.centred(x)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int64()), pa.array(total)], ["slot", "part"])

        found = self.blocks.select("ids", "x").mapInArrow(partial, "slot long, part double").groupBy("slot").agg(F.sum("part").alias("s")).toArrow()
        out = np.zeros(size)
        out[found.column("slot").to_numpy()] = found.column("s").to_numpy()
        return out.reshape(shape)

    def product(self, vectors: np.ndarray) -> np.ndarray:
        """The covariance times some vectors: one pass, whose size does not grow with the rows."""
        return self.sums_over(lambda c: c.T @ (c @ vectors), vectors.shape) / self.n

    def trace(self) -> float:
        return float(self.sums_over(lambda c: np.array([(c * c).sum()]), (1,))[0]) / self.n


class _Centre:
    """What tasks need of a fit."""

    def __init__(self, fit: Fit):
        self.dim, self.n, self.whole, self.rest = fit.dim, fit.n, fit.whole, fit.rest

    scaled, centred = Fit.scaled, Fit.centred


def orthonormal(vectors: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """An orthonormal basis of what the vectors add to ``against``; what adds nothing is dropped."""
    kept = np.zeros((len(vectors), 0)) if against is None else against
    known = kept.shape[1]
    for v in vectors.T:
        size = np.linalg.norm(v)
        if not size > 0:
            continue
        v = v / size
        for _ in range(3):
            v = v - kept @ (kept.T @ v)
        left = np.linalg.norm(v)
        if left > 1e-10:
            v = v / left
            kept = np.column_stack([kept, v - kept @ (kept.T @ v)])
            kept[:, -1] /= np.linalg.norm(kept[:, -1])
    return kept[:, known:]


def minres(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, shifts: np.ndarray, fixed: np.ndarray,
           steps: int, goal: float) -> np.ndarray:
    """Solves P (A - shift) P t = P right for each column in step, P projecting out ``fixed``: at most
    ``steps`` products, fewer once every residual is ``goal`` of where it began."""
    project = lambda v: v - fixed @ (fixed.T @ v)
    right = project(right)
    begin = np.linalg.norm(right, axis=0)
    before, v = np.zeros_like(right), right / np.where(begin > 0, begin, 1)
    beta, left, size = np.zeros(len(shifts)), begin.copy(), begin.copy()
    w, w_before, t = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    c = c_before = np.ones(len(shifts))
    s = s_before = np.zeros(len(shifts))
    for _ in range(steps):
        if np.all(left <= goal * begin):
            break
        u = project(product(v) - v * shifts)
        alpha = (v * u).sum(axis=0)
        u = project(u - alpha * v - beta * before)
        follow = np.linalg.norm(u, axis=0)
        plain = c * alpha - c_before * s * beta
        turned = np.hypot(plain, follow)
        turned = np.where(turned > 0, turned, 1)
        near, far = s * alpha + c_before * c * beta, s_before * beta
        c_before, s_before, c, s = c, s, plain / turned, follow / turned
        w_before, w = w, (v - far * w_before - near * w) / turned
        t = t + c * size * w
        size, left = -s * size, left * np.abs(s)
        before, v, beta = v, u / np.where(follow > 0, follow, 1), follow
    return t


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], dim: int, count: int = COMPONENTS, basis: int = BASIS,
                  inner: int = INNER, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues (falling) and eigenvectors of a symmetric positive operator, residuals
    within rounding."""
    count = min(count, dim)
    width = min(dim, 2 * count)
    room = max(basis, 3 * count)
    space = orthonormal(np.random.default_rng(seed).standard_normal((dim, width)))
    image = product(space)
    for _ in range(OUTER):
        inside = space.T @ image
        values, turn = np.linalg.eigh((inside + inside.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        top, pairs = values[:count], space @ turn[:, :count]
        residual = image @ turn[:, :count] - pairs * top
        open_ = np.linalg.norm(residual, axis=0) > ROUNDING * max(values[0], 0.0)
        if not open_.any():
            return top, pairs
        if space.shape[1] + open_.sum() > room:  # go on with the best of the basis
            space = orthonormal(space @ turn[:, :min(width, space.shape[1])])
            image = product(space)
        # an expansion that starts from the residual keeps to what rounding allows when MINRES adds nothing
        step = minres(product, -residual[:, open_], top[open_], pairs, inner, INNER_GOAL)
        new = orthonormal(step, space)
        if not new.shape[1]:
            new = orthonormal(residual[:, open_], space)
        if not new.shape[1]:  # the basis holds all there is
            return top, pairs
        space, image = np.column_stack([space, new]), np.column_stack([image, product(new)])
    raise RuntimeError("eigenvectors did not settle")


def whiten(docs: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each remaining row and component: vec_id, component (from 1), n, deviation (null where it
    passes a long), whitened, explained, identity_error, deviation_wide (decimal(38,0), null only beyond that).

    Rows whose vector is null, empty, or holds null or non-finite entries go; so do vectors of another length than most.
    Components without variance (beyond rounding) have no rows: with one row, or equal rows only, the result is empty,
    as it is for an empty table. Repeated rows and ids are rows of their own; other columns are ignored."""
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, "
              "deviation_wide decimal(38,0)")
    spark = docs.sparkSession
    fit = Fit.of(keep(whole_numbers(docs, vec_id, vector), "embeddings"))
    trace = fit.trace() if fit else 0.0
    if not trace > 0:
        return spark.createDataFrame([], schema)
    values, vectors = leading_pairs(fit.product, fit.dim, components)
    there = values > 1e-12 * trace
    values, vectors = values[there], vectors[:, there]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    onto = vectors / np.sqrt(values)
    moments = fit.sums_over(lambda c: _moments(c @ onto), (len(values) + 1, len(values)))
    mean = moments[0] / fit.n
    error = float(np.abs(moments[1:] / fit.n - np.outer(mean, mean) - np.eye(len(values))).max())
    centre, parts = _Centre(fit), (values / trace).tolist()

    def project(batches):
        for batch in batches:
            for ids, x in rows_of(batch, centre.dim):
                scaled = centre.scaled(x)
                if scaled.dtype == object or float(np.abs(scaled).max(initial=0)) ** 2 * centre.dim >= 2.0**62:
                    deviation = [sum(int(v) ** 2 for v in row) for row in scaled.tolist()]
                else:
                    deviation = (scaled * scaled).sum(axis=1).tolist()
                z, k = (scaled / centre.n).astype(float) @ onto, len(parts)
                rows = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(rows), centre.n, np.int64)),
                    pa.array([d if d <= _LONG else None for d in deviation], pa.int64()).take(pa.array(rows)), pa.array(z.ravel()),
                    pa.array(np.tile(parts, len(x))), pa.array(np.full(len(rows), error)),
                    pa.array([str(d) for d in deviation]).take(pa.array(rows))], [*_COLUMNS, "wide"])

    out = fit.blocks.select("ids", "x").mapInArrow(project, schema.replace("deviation_wide decimal(38,0)", "wide string"))
    return out.select(*_COLUMNS, F.expr("try_cast(wide AS decimal(38,0))").alias("deviation_wide"))


_COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def _moments(z: np.ndarray) -> np.ndarray:
    return np.vstack([z.sum(axis=0), z.T @ z])
