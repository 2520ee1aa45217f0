"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become whole numbers and each distinct one is fitted once, so counts, sums and
deviations are exact.  The centred rows X stay in a written table.  A step of the
bidiagonalisation makes one pass over it: every task forms Xv for its rows and adds up
X'(Xv) and the products of Xv with all former left vectors, which it rebuilds from its
own rows, since a left vector is X times a vector of as many entries as a row.  What
comes back is one vector.  Both sides are orthogonalised against all former vectors,
and the singular values and right vectors of the small bidiagonal matrix give the
components.

As many steps are made as a vector has entries: fewer would find one component only
where several have equal variances.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewarden.sources.stage import stage

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: A deviation (singular value) below this share of the largest is rounding and no component.
RANK = 1e-11
#: Rows of one matrix in a task, by entries.
_ENTRIES = 1 << 20


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): rows whose vector has entries and only finite ones, floor(SCALE * c) + SHIFT of each.

    Where lengths differ, those of the length with the most rows (of equals, the longest)
    remain.  Repeated rows and null ids stay.
    """
    finite = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    valid = (rows.filter(F.col(vector_col).isNotNull()).filter(finite & (F.size(vector_col) > 0))
             .select(F.col(id_col).alias("vec_id"), F.transform(
                 vector_col, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long")).alias("x")))
    most = valid.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return valid.filter(F.size("x") == (most.size if most else 0))


def _matrices(batches: Iterator[pa.RecordBatch], column: int, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of batches with their vectors as a matrix of long."""
    step = max(1, _ENTRIES // dims)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, part.column(column).flatten().to_numpy().reshape(-1, dims)


def _total(fit: DataFrame, dims: int, of: Callable[[np.ndarray], np.ndarray], width: int, kind: type = float) -> np.ndarray:
    """Sum over the matrices of ``fit`` (x) of a vector with ``width`` entries; only that sum reaches the driver."""
    arrow = pa.float64() if kind is float else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.float64 if kind is float else np.int64)
        for _, x in _matrices(batches, 0, dims):
            total += of(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total, arrow)], names=["at", "v"])

    parts = fit.select("x").mapInArrow(run, f"at long, v {'double' if kind is float else 'long'}")
    out = np.zeros(width, np.float64 if kind is float else np.int64)
    for r in parts.groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r.at] = r.v
    return out


class Fit:
    """Size and sums of the distinct vectors, and their components once :meth:`bidiagonalise` was called."""

    def __init__(self, fit: DataFrame):
        self.table = fit
        first = fit.first()
        self.dims = len(first.x) if first else 0
        dims = self.dims
        counted = _total(fit, dims, lambda x: np.append(x.sum(axis=0), len(x)), dims + 1, int) if dims else np.zeros(1, np.int64)
        self.n, self.sums = int(counted[-1]), counted[:-1]

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        """x - S/n of a matrix, from exact whole numbers."""
        n, sums = self.n, self.sums
        return lambda x: (x * n - sums) / float(n)

    def bidiagonalise(self, seed: int = 11) -> None:
        """Deviations (singular values, falling) and right vectors (columns) of the centred rows."""
        d, centred, rnd = self.dims, self.centred(), np.random.default_rng(seed)
        right, left, pulled = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # V; P with U = XP; X'U
        alpha, beta = np.zeros(d), np.zeros(d)

        def fresh() -> np.ndarray:
            return _orthogonal(rnd.standard_normal(d), right)

        v = fresh()
        for j in range(d):
            right = np.column_stack([right, v])
            p = v - (beta[j - 1] * left[:, -1] if j else 0)

            def products(x: np.ndarray, p=p, left=left) -> np.ndarray:
                rows = centred(x)
                u = rows @ p
                return np.concatenate([rows.T @ u, (rows @ left).T @ u, [u @ u]])

            got = _total(self.table, d, products, d + j + 1)
            y, drift, square = got[:d], got[d:-1], got[-1]
            p, y = p - left @ drift, y - pulled @ drift
            alpha[j] = np.sqrt(max(square - drift @ drift, 0.0))
            if alpha[j] <= RANK * max(alpha.max(), beta.max(), 1e-300):
                alpha[j], p, y = 0.0, np.zeros(d), np.zeros(d)
            else:
                p, y = p / alpha[j], y / alpha[j]
            left, pulled = np.column_stack([left, p]), np.column_stack([pulled, y])
            if j + 1 == d:
                break
            w = y - alpha[j] * v
            for _ in range(2):
                w = w - right @ (right.T @ w)
            beta[j] = np.linalg.norm(w)
            if beta[j] <= RANK * max(alpha.max(), beta.max(), 1e-300):
                beta[j], v = 0.0, fresh()
            else:
                v = w / beta[j]
        _, self.deviations, turned = np.linalg.svd(np.diag(alpha) + np.diag(beta[:d - 1], 1))
        self.right = right @ turned.T

    def components(self, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit components (columns), their standard deviations and shares of the trace; at most the rank."""
        if not self.dims or not self.deviations[0]:
            return np.zeros((self.dims, 0)), np.zeros(0), np.zeros(0)
        k = min(most, int((self.deviations > RANK * self.deviations[0]).sum()))
        square = self.deviations ** 2
        return self.right[:, :k], self.deviations[:k] / np.sqrt(self.n), square[:k] / square.sum()


def _orthogonal(v: np.ndarray, to: np.ndarray) -> np.ndarray:
    for _ in range(3):
        v = v - to @ (to.T @ v)
    return v / np.linalg.norm(v)


def _squares(off: np.ndarray, largest: int) -> list[int | None]:
    """Exact sums of squares by row; null where one is beyond a long."""
    if largest * largest * off.shape[1] < 1 << 63:
        return (off * off).sum(axis=1).tolist()
    sums = [sum(v * v for v in row) for row in off.tolist()]
    return [s if s < 1 << 63 else None for s in sums]


def whitened(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error by row and component.

    Rows with a null or empty vector or an entry that is not finite are left out.  Fewer
    components than asked come where the distinct vectors vary in fewer directions, none
    (and so no rows) where there is one vector or none.  A deviation beyond a long is null.
    """
    valid = whole_vectors(rows, id_col, vector_col)
    kind = valid.schema["vec_id"].dataType
    valid = stage(valid.withColumn("vec_id", F.col("vec_id").cast("long")) if kind.typeName() != "string" else valid)
    fit = Fit(stage(valid.select("x").distinct()))
    if fit.dims:
        fit.bidiagonalise()
    dirs, spread, share = fit.components(components)
    k, n, sums, dims, centred = len(spread), fit.n, fit.sums, fit.dims, fit.centred()
    project = dirs / spread

    def gram(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ project
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    error = 0.0
    if k:
        got = _total(fit.table, dims, gram, k + k * k)
        mean = got[:k] / n
        error = float(np.abs(got[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    id_kind = "string" if kind.typeName() == "string" else "long"
    schema = (f"vec_id {id_kind}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, 1, max(dims, 1)):
            off = x * n - sums
            far = _squares(off, int(np.abs(off).max()))
            m = len(x)
            ids = part.column(0).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n)),
                 pa.array(far, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                 pa.array((centred(x) @ project).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                names=[f.split()[0] for f in schema.split(", ")])

    return (valid if k else valid.limit(0)).select("vec_id", "x").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
