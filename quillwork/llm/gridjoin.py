"""Embedding near-duplicates by an epsilon grid order join.

Vectors are scaled to length 1, so that cosine >= c means a distance of at most eps = sqrt(2 - 2c). They are projected on the
leading principal dimensions of all vectors, a projection that never lengthens a distance, cut into grid cells of side eps and
sorted by cell. The sorted sequence is cut into intervals. Two intervals, or two halves of them in the recursion, are skipped
where their cells are provably more than one apart in some dimension; what is left is compared exactly in double precision.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, tree_sum
from .components import components, forest_links

COSINE = 0.98
DIMENSIONS = 6
INTERVAL_ROWS = 512
#: So many intervals next to each other travel together: they are sent once for all their neighbours in another such group.
GROUP = 8
#: Intervals meet by the cells of so many leading dimensions.
KEY_DIMENSIONS = 2
LEAF_ROWS = 128


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length as doubles."""
    n = len(column)
    return np.asarray(column.flatten(), dtype=float).reshape(n, -1) if n else np.zeros((0, 0))


def usable(vectors: DataFrame) -> DataFrame:
    """Vectors that can link: id and label not null, components finite and not all zero. dim tells lengths apart."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    good = vectors.select(F.col("vec_id").cast("long"), v.alias("embedding"), F.col("label").cast("long"))
    good = good.where("vec_id is not null and label is not null and embedding is not null")
    return good.where(F.coalesce(finite, F.lit(False)) & F.coalesce(some, F.lit(False))).withColumn("dim", F.size("embedding"))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows scaled by a power of two, so that squares neither overflow nor vanish and no digit changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal(classes: DataFrame, k: int) -> dict[int, np.ndarray]:
    """The k leading principal directions (columns) of unit vectors of each length, from second moments over all rows."""
    out = {}

    def moments(batches):
        total = None
        for batch in batches:
            x = _unit(_matrix(batch.column(0)))
            part = (np.array([len(x)]), x.sum(axis=0), (x.T @ x).ravel())
            total = part if total is None else tuple(a + b for a, b in zip(total, part, strict=True))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([t.astype(float).tolist()], pa.list_(pa.float64())) for t in total], ["n", "s", "o"])

    for dim in sorted(r[0] for r in classes.select("dim").distinct().collect()):
        rows = classes.where(F.col("dim") == dim).select("embedding").mapInArrow(moments, "n array<double>, s array<double>, o array<double>")
        m = tree_sum(rows, ["n", "s", "o"])
        mean = m["s"] / m["n"][0]
        _, directions = np.linalg.eigh(m["o"].reshape(dim, dim) / m["n"][0] - np.outer(mean, mean))
        out[dim] = directions[:, ::-1][:, : min(k, dim)]
    return out


def _cells(directions: dict[int, np.ndarray], eps: float, k: int):
    def project(batches):
        for batch in batches:
            dims = batch.column(batch.schema.get_field_index("dim")).to_numpy(zero_copy_only=False)
            cells = np.zeros((len(dims), k), dtype=np.int32)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                d = directions[int(dim)]
                x = _matrix(batch.column(batch.schema.get_field_index("embedding")).take(pa.array(own)))
                # a hair is added to eps, so that rounding never puts linked vectors two cells apart
                cells[own, : d.shape[1]] = np.floor(_unit(x) @ d / (eps * (1 + 1e-9)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(dims) + 1, k, dtype=np.int32)), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "cell"])

    return project


INTERVAL = "interval long, label long, dim int, low array<int>, high array<int>, keys array<long>, ids binary, mult binary, cells binary, vectors binary"


def _keys(cells: np.ndarray) -> np.ndarray:
    """One number for the leading cells; cells of unit vectors are few to either side of 0."""
    lead = cells[:, :KEY_DIMENSIONS].astype(np.int64)
    return lead @ (np.int64(1) << (24 * np.arange(lead.shape[1], dtype=np.int64)))


def _neighbours() -> list[int]:
    return [sum(s << (24 * k) if s >= 0 else -(-s << (24 * k)) for k, s in enumerate(step)) for step in product((-1, 0, 1), repeat=KEY_DIMENSIONS)]


def _bytes(vectors: np.ndarray) -> bytes:
    """Doubles, or floats where all of them are floats."""
    with np.errstate(over="ignore"):
        short = vectors.astype("<f4")
    return short.tobytes() if (short == vectors).all() else vectors.astype("<f8").tobytes()


def _vectors(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<f4" if len(data) == 4 * n * dim else "<f8").astype(float).reshape(n, dim)


def _pack(rows: int):
    """Cuts sorted rows (label, dim, first, mult, embedding, cell) into intervals of one label."""

    def interval(number, part, held):
        ids, mult, cells, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
        values = [[number], [part[0]], [part[1]], [cells.min(axis=0).tolist()], [cells.max(axis=0).tolist()], [np.unique(_keys(cells)).tolist()], [ids.astype("<i8").tobytes()], [mult.astype("<i8").tobytes()], [cells.astype("<i4").tobytes()], [_bytes(vectors)]]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], [c.split()[0] for c in INTERVAL.split(", ")])

    def pack(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        part, held, n = None, [], 0
        for batch in batches:
            label, dim = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (dim[1:] != dim[:-1])]) if len(label) else []
            for s, e in zip(starts, np.r_[starts[1:], len(label)] if len(label) else [], strict=True):
                at = int(s)
                while at < e:
                    if held and (part != (int(label[at]), int(dim[at])) or n >= rows):
                        yield interval(number, part, held)
                        number, held, n = number + 1, [], 0
                    part = (int(label[at]), int(dim[at]))
                    to = min(int(e), at + rows - n)
                    own = batch.slice(at, to - at)
                    held.append((own.column(2).to_numpy(), own.column(3).to_numpy(), _matrix(own.column(5)).astype(np.int32), _matrix(own.column(4))))
                    n, at = n + to - at, to
        if held:
            yield interval(number, part, held)

    return pack


def _join_sequences(a: np.ndarray, b: np.ndarray, u: np.ndarray, v: np.ndarray, cosine: float, same: bool, i0: int = 0, j0: int = 0):
    """Row pairs of two sequences with cosine at least so much: recursive halving, skipping parts whose cells are over one apart.

    a, b: cells; u, v: unit vectors in the same order. In a sequence with itself each pair comes once.
    """
    if (a.min(axis=0) > b.max(axis=0) + 1).any() or (b.min(axis=0) > a.max(axis=0) + 1).any():
        return
    if len(a) <= LEAF_ROWS and len(b) <= LEAF_ROWS:
        # products that may round to either side are left to the exact test
        i, j = np.nonzero(u @ v.T >= cosine - 1e-9)
        keep = i + i0 < j + j0 if same else slice(None)
        yield i[keep] + i0, j[keep] + j0
        return
    for s in (slice(0, len(a) // 2), slice(len(a) // 2, None)) if len(a) > LEAF_ROWS else (slice(None),):
        for t in (slice(0, len(b) // 2), slice(len(b) // 2, None)) if len(b) > LEAF_ROWS else (slice(None),):
            i, j = i0 + (s.start or 0), j0 + (t.start or 0)
            if not same or i <= j:
                yield from _join_sequences(a[s], b[t], u[s], v[t], cosine, same, i, j)


def _compare(cosine: float):
    """Compares the intervals of two groups that have to be: each row holds an interval and the later ones it meets."""

    def load(row: dict):
        ids = np.frombuffer(row["ids"], dtype="<i8")
        return ids, np.frombuffer(row["mult"], dtype="<i8"), np.frombuffer(row["cells"], dtype="<i4").reshape(len(ids), -1), _scaled(_vectors(row["vectors"], len(ids), row["dim"]))

    def compare(table: pa.Table) -> pa.Table:
        rows = {r["interval"]: r for r in table.to_pylist()}
        sides = {k: load(r) for k, r in rows.items()}
        out = [pair(sides[k], sides[o], k == o) for k in sorted(rows) for o in sorted(rows[k]["others"] or [])]
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in "abn"})

    def pair(one, other, same: bool) -> pa.Table:
        (ids_a, mult_a, cells_a, x), (ids_b, mult_b, cells_b, y) = one, other
        found = list(_join_sequences(cells_a, cells_b, _unit(x), _unit(y), cosine, same))
        i, j = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))
        exact = []
        for at in range(0, len(i), 4096):
            p, q = x[i[at : at + 4096]], y[j[at : at + 4096]]
            exact.append((p * q).sum(axis=1) / (np.sqrt((p * p).sum(axis=1)) * np.sqrt((q * q).sum(axis=1))) >= cosine)
        keep = np.concatenate(exact) if exact else np.zeros(0, bool)
        i, j = i[keep], j[keep]
        ids = ids_a if same else np.concatenate([ids_a, ids_b])
        n = np.zeros(len(ids), dtype=np.int64)
        shift = 0 if same else len(ids_a)
        np.add.at(n, i, mult_b[j])
        np.add.at(n, j + shift, mult_a[i])
        links = forest_links(len(ids), i, j + shift)
        has = np.flatnonzero(n)
        return pa.table({"a": np.concatenate([ids[has], ids[links[:, 0]]]), "b": pa.array(ids[links[:, 1]]).cast(pa.int64()) if not len(has) else pa.chunked_array([pa.nulls(len(has), pa.int64()), pa.array(ids[links[:, 1]], pa.int64())]).combine_chunks(), "n": np.concatenate([n[has], np.zeros(len(links), dtype=np.int64)])})

    return compare


def vector_links(classes: DataFrame, cosine: float = COSINE, k: int = DIMENSIONS, rows: int = INTERVAL_ROWS) -> DataFrame:
    """From distinct vectors (label, dim, embedding, first id, mult copies): rows (a, null, n), n vectors linked to a by one
    comparison, and rows (a, b, 0), links that connect vectors as all links do."""
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) or 1e-9
    directions = principal(classes, k)
    named = classes.select("label", "dim", "first", "mult", "embedding")
    celled = named.mapInArrow(_cells(directions, eps, k), "label long, dim int, first long, mult long, embedding array<double>, cell array<int>")
    ordered = celled.repartitionByRange("label", "dim", "cell", "first").sortWithinPartitions("label", "dim", "cell", "first")
    intervals = stash(ordered.mapInArrow(_pack(rows), INTERVAL))
    bounds = intervals.select("interval", "label", "dim", "low", "high", "keys")
    a = bounds.select(F.col("interval").alias("a"), "label", "dim", F.col("low").alias("a_low"), F.col("high").alias("a_high"), F.explode("keys").alias("cell"))
    near = F.array_distinct(F.flatten(F.transform("keys", lambda x: F.array(*[x + F.lit(s) for s in _neighbours()]))))
    b = bounds.select(F.col("interval").alias("b"), "label", "dim", F.col("low").alias("b_low"), F.col("high").alias("b_high"), F.explode(near).alias("cell"))
    meet = F.forall(F.arrays_zip("a_low", "a_high", "b_low", "b_high"), lambda z: (z["a_low"] <= z["b_high"] + 1) & (z["b_low"] <= z["a_high"] + 1))
    pairs = a.join(b, ["label", "dim", "cell"]).where(meet).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # an interval goes once to each pair of groups in which it meets others, at most 2 * GROUP intervals
    group = lambda c: F.floor(F.col(c) / GROUP)
    sides = pairs.select(group("a").alias("ga"), group("b").alias("gb"), F.explode(F.array(F.struct(F.col("a").alias("interval"), F.col("b").alias("other")), F.struct(F.col("b").alias("interval"), F.lit(None).cast("long").alias("other")))).alias("s"))
    sides = sides.groupBy("ga", "gb", F.col("s.interval").alias("interval")).agg(F.collect_set("s.other").alias("others"))
    loaded = sides.join(intervals.select("interval", "dim", "ids", "mult", "cells", "vectors"), "interval")
    return loaded.groupBy("ga", "gb").applyInArrow(_compare(cosine), "a long, b long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, k: int = DIMENSIONS, rows: int = INTERVAL_ROWS) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable) and kept of every row.

    Vectors link only within a label that is not null and with others of their length. Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing, nor do rows with a null vec_id. Equal vectors are compared once and
    counted each; repeated vec_ids keep their rows. An empty table gives no rows; further columns are ignored.
    """
    rows_in = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long"))
    classes = stash(usable(vectors).groupBy("label", "dim", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("mult")))
    links = stash(vector_links(classes, cosine, k, rows))
    counts = links.where("b is null").groupBy("a").agg(F.sum("n").alias("others"))
    found = components(links.where("b is not null").select("a", "b"))
    classes = classes.join(counts, classes["first"] == counts["a"], "left").drop("a")
    classes = classes.join(found, classes["first"] == found["node"], "left").drop("node")
    known = classes.select("label", "embedding", (F.col("mult") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "first").alias("found"))
    out = rows_in.join(known, ["label", "embedding"], "left")
    # a row that was left out of the classes never takes part, whatever its vector equals
    mine = F.col("vec_id").isNotNull()
    component = F.when(mine, F.coalesce("found", "vec_id"))
    return out.select("vec_id", F.when(mine, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
