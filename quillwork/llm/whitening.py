"""Embedding whitening with Spark MLlib's BlockMatrix.

Rows are centred exactly and indexed into blocks of BLOCK_ROWS; the transpose times the matrix is the scatter; its eigenvectors,
found on the driver, give the whitening matrix, by which the blocks are multiplied.

A product of BlockMatrix has the grid of its result for partitions: the plain scatter, a single block, would be summed in one
task, and the tall projection in the root of their number. So blocks are spread over a square of column blocks, each block in one
place, all others empty: block i in column block i % side in the left matrix, in (i // side) % side in the right one. The product
is then a square of partial scatters, each over its own blocks, and the projection by a block-diagonal whitening matrix a grid
with as many columns.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
BLOCK_ROWS = 1024
#: Column blocks of a square of partial products, at most.
SIDE = 32
#: Entries are held within this bound, so that n * x fits a long for n up to 2^30.
BOUND = 1 << 32
#: An eigenvalue under this share of the trace is rounding: that component has no variance.
RANK = 1e-12
EXACT = "decimal(38,0)"
PACKED = "part int, k long, dim int, ids array<long>, x binary, total array<long>"


def integer_entries(vectors: DataFrame) -> DataFrame:
    """vec_id, dim and x array<long>, floor(SCALE * entry) + SHIFT, of the vectors without null or non-finite entries."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(float(BOUND))), F.lit(float(-BOUND)))).cast("long") + SHIFT
    kept = vectors.where(F.coalesce(finite, F.lit(False)) & (F.size("embedding") > 0))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), F.transform(v, held).alias("x"))


def packed(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows (vec_id, dim, x) in packs of one length and at most block_rows rows: part and k number them, x holds the entries,
    total their sum."""

    def pack(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def out(dim: int, n: int):
            nonlocal k
            table = pa.Table.from_batches(held[dim]).combine_chunks()
            held[dim] = table.slice(n).to_batches()
            own = table.slice(0, n)
            x = np.asarray(own.column("x").combine_chunks().flatten(), dtype="<i8").reshape(n, dim)
            values = [part], [k], [dim], [own.column("vec_id").to_pylist()], [x.tobytes()], [x.sum(axis=0).tolist()]
            types = pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())
            k += 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], ["part", "k", "dim", "ids", "x", "total"])

        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                held.setdefault(dim, []).append(batch.filter(pa.array(dims == dim)))
                while (n := sum(b.num_rows for b in held[dim])) >= block_rows:
                    yield out(dim, block_rows)
        for dim in held:
            if n := sum(b.num_rows for b in held[dim]):
                yield out(dim, n)

    return rows.mapInArrow(pack, PACKED)


def _entries(x: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(x, dtype="<i8").reshape(-1, dim)


def block_matrix(packs: DataFrame, n: int, sums: list[int], side: int, left: bool, block_rows: int = BLOCK_ROWS) -> BlockMatrix:
    """The centred rows x - S / n of packs (block, dim, x), padded with zeros to whole blocks, spread over `side` column blocks."""
    dim, shift = len(sums), np.array(sums, dtype=np.int64)
    blocks = packs.agg(F.max("block")).first()[0] + 1

    def centred(row):
        x = np.zeros((block_rows, dim))
        own = _entries(row.x, dim)
        # n * x - S is exact; the division rounds once
        x[: len(own)] = (n * own - shift) / n
        column = row.block % side if left else row.block // side % side
        return (row.block, column), DenseMatrix(block_rows, dim, x.ravel(order="F"))

    return BlockMatrix(packs.select("block", "x").rdd.map(centred), block_rows, dim, blocks * block_rows, side * dim)


def scatter(left: BlockMatrix, right: BlockMatrix) -> np.ndarray:
    """The sum of left's transpose times right over the square of partial products: at most SIDE^2 blocks, added in a tree."""
    partial = left.transpose().multiply(right).blocks.map(lambda b: b[1].toArray())
    return partial.treeReduce(np.add)


def diagonal(spark, matrix: np.ndarray, side: int) -> BlockMatrix:
    """`side` copies of matrix along the diagonal."""
    rows, columns = matrix.shape
    blocks = [((i, i), DenseMatrix(rows, columns, matrix.ravel(order="F"))) for i in range(side)]
    return BlockMatrix(spark.sparkContext.parallelize(blocks, min(side, 8)), rows, columns, side * rows, side * columns)


def whitening_matrix(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, eigenvalues): columns are the k leading unit eigenvectors over the root of their eigenvalue, or zeros where there
    is no variance."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    real = values > RANK * max(covariance.trace(), 1e-300)
    return np.where(real, vectors / np.sqrt(np.where(real, values, 1.0)), 0.0), np.where(real, values, 0.0)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """The exact sum of (n * x - S)^2 of each row; null where it does not fit a long."""
    c = n * x - sums
    if not c.size or int(np.abs(c).max()) ** 2 * c.shape[1] < 1 << 63:
        return (c * c).sum(axis=1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in c]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, k: int = COMPONENTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every fitted vector and component up to k.

    Vectors that are null, empty or hold null or non-finite entries are left out. All fitted vectors have one length: the
    commonest, of equally common ones the longest; others are left out. Entries beyond 2^32 / 64 count as that. A deviation that
    does not fit a long is null. Components without variance have whitened and explained 0 and stay out of identity_error.
    Repeated and null vec_ids keep their rows. An empty table gives no rows; further columns are ignored.

    The driver holds moments of one vector length and the numbers of blocks, a pair of integers for each BLOCK_ROWS rows.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    packs = stash(packed(integer_entries(vectors), block_rows))
    common = packs.groupBy("dim").agg(F.sum(F.size("ids")).alias("n"), F.max("part").alias("parts")).orderBy(F.desc("n"), F.desc("dim")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    dim, n = common.dim, common.n
    parts = packs.agg(F.max("part")).first()[0] + 1
    # numbers of blocks may leave gaps, which are blocks without rows
    packs = packs.where(F.col("dim") == dim).select((F.col("k") * parts + F.col("part")).cast("int").alias("block"), "ids", "x", "total")
    totals = packs.select(F.posexplode("total").alias("d", "s")).groupBy("d").agg(F.sum(F.col("s").cast(EXACT)).alias("s")).collect()
    sums = [int(r.s) for r in sorted(totals, key=lambda r: r.d)]
    # a product has as many partitions as its inputs, if the square is as large
    side = min(SIDE, math.ceil(math.sqrt(packs.rdd.getNumPartitions())))
    left = block_matrix(packs, n, sums, side, True, block_rows)
    covariance = scatter(left, block_matrix(packs, n, sums, side, False, block_rows)) / n
    matrix, values = whitening_matrix(covariance, k)
    width, trace = matrix.shape[1], max(float(covariance.trace()), 1e-300)
    projected = left.multiply(diagonal(spark, matrix, side)).blocks
    rows = projected.map(lambda b: (int(b[0][0]), int(b[0][1]), b[1].toArray().astype("<f8").tobytes())).filter(lambda b: b[0] % side == b[1])
    white = stash(spark.createDataFrame(rows, "block int, column int, white binary"))
    error = identity_error(white, n, width, values > 0, side, block_rows)
    shift, explained = np.array(sums, dtype=np.int64), values / trace

    def unpack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x, m = _entries(row["x"], dim), len(row["ids"])
                w = np.frombuffer(row["white"], dtype="<f8").reshape(block_rows, width)[:m]
                each = lambda values, t: pa.array(values, t).take(pa.array(np.repeat(np.arange(m), width)))
                columns = [
                    each(row["ids"], pa.int64()), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), m)), pa.array(np.full(m * width, n, dtype=np.int64)),
                    each(_deviations(x, n, shift), pa.int64()), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * width, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return packs.select("block", "ids", "x").join(white.select("block", "white"), "block").select("ids", "x", "white").mapInArrow(unpack, schema)


def identity_error(white: DataFrame, n: int, width: int, real: np.ndarray, side: int, block_rows: int) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, over components with variance."""

    def blocks(left: bool) -> BlockMatrix:
        def block(row):
            x = np.frombuffer(row.white, dtype="<f8").reshape(block_rows, width)
            return (row.block, row.block % side if left else row.block // side % side), DenseMatrix(block_rows, width, x.ravel(order="F"))

        return BlockMatrix(white.rdd.map(block), block_rows, width, (top + 1) * block_rows, side * width)

    def sums(batches):
        for batch in batches:
            for value in batch.column(0).to_pylist():
                x = np.frombuffer(value, dtype="<f8").reshape(block_rows, width)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(x.sum(axis=0))], ["d", "s"])

    top = white.agg(F.max("block")).first()[0]
    totals = {r.d: r.s for r in white.select("white").mapInArrow(sums, "d int, s double").groupBy("d").agg(F.sum("s").alias("s")).collect()}
    mean = np.array([totals[d] for d in range(width)]) / n
    off = scatter(blocks(True), blocks(False)) / n - np.outer(mean, mean) - np.eye(width)
    return float(np.abs(off[np.ix_(real, real)]).max(initial=0.0))
