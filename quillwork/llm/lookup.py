"""Centroid clustering of integer vectors whose distances come from scalar lookup tables.

Components become integers. Vectors travel in blocks: a block lists the integers that occur in each dimension and each vector's
places in those lists. A round tabulates, for each dimension, the squared difference of every occurring integer and every
centroid; the distance of a vector is then a sum of table rows gathered by its places. Tables hold no more rows than a block has
vectors, so nothing but the centroids is sent to tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

DIMENSIONS = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
BLOCK_ROWS = 4096
#: Components are held within this many units of 0, so that a squared distance of 64 of them fits a long.
BOUND = 1 << 27
BLOCKS = "ids array<long>, first array<int>, seen array<int>, places binary"
EXACT = "decimal(38,0)"


def integer_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and x array<int>: floor(scale * component) of the vectors with `dimensions` components, none null or non-finite."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(BOUND))), F.lit(float(-BOUND)))).cast("int")
    kept = vectors.where((F.size("embedding") == dimensions) & F.coalesce(finite, F.lit(False)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, held).alias("x"))


def first_centroids(rows: DataFrame, k: int = CENTROIDS, seed: int = 2) -> np.ndarray:
    """The k vectors with the smallest sha256 of `<seed>:<vec_id>`, in that order; ties by components. At most k reach the driver."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    least = rows.select(name.alias("name"), "x").orderBy("name", "x").limit(k).collect()
    return np.array([r.x for r in least], dtype=np.int64)


def in_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows (vec_id, x) as BLOCKS: ids; the integers seen in each dimension, one list after another, which begin at `first`; and
    for each vector and dimension its place in `seen`."""

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                x = np.asarray(part.column(1).flatten(), dtype=np.int32).reshape(part.num_rows, -1)
                seen, places, first = [], np.empty(x.shape, dtype="<i4"), [0]
                for d, column in enumerate(x.T):
                    values, inverse = np.unique(column, return_inverse=True)
                    seen.append(values)
                    places[:, d] = inverse + first[-1]
                    first.append(first[-1] + len(values))
                values = [part.column(0).to_pylist()], [first], [np.concatenate(seen).tolist()], [places.tobytes()]
                types = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], ["ids", "first", "seen", "places"])

    return rows.mapInArrow(pack, BLOCKS)


def _nearest(first: np.ndarray, seen: np.ndarray, places: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each vector of a block; ties go to the smaller number."""
    dimension = np.repeat(np.arange(len(first) - 1), np.diff(first))
    # table[s, c]: squared difference of the s-th seen integer and centroid c in that integer's dimension
    table = (seen[:, None].astype(np.int64) - centroids.T[dimension]) ** 2
    distance = np.zeros((len(places), len(centroids)), dtype=np.int64)
    for column in places.T:
        distance += table[column]
    own = distance.argmin(axis=1)
    return own, distance[np.arange(len(own)), own]


def _loaded(batches):
    for batch in batches:
        for row in batch.to_pylist():
            first = np.array(row["first"], dtype=np.int64)
            yield row["ids"], first, np.array(row["seen"], dtype=np.int64), np.frombuffer(row["places"], dtype="<i4").reshape(len(row["ids"]), len(first) - 1)


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of the exact mean of each one's vectors; those without vectors stay. A task gives one
    row a centroid and dimension; the driver gets the sums of these."""
    k, dims = centroids.shape

    def add(batches):
        sums, sizes = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for _, first, seen, places in _loaded(batches):
            own, _ = _nearest(first, seen, places, centroids)
            np.add.at(sums, own, seen[places])
            sizes += np.bincount(own, minlength=k)
        c, d = np.nonzero(np.repeat(sizes[:, None] > 0, dims, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(sums[c, d]), pa.array(sizes[c])], ["c", "d", "total", "size"])

    parts = blocks.mapInArrow(add, "c int, d int, total long, size long")
    out = centroids.copy()
    for r in parts.groupBy("c", "d").agg(F.sum(F.col("total").cast(EXACT)).alias("total"), F.sum("size").alias("size")).collect():
        out[r.c, r.d] = int(r.total) // r.size
    return out


def assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance of every vector."""

    def assign(batches):
        for ids, first, seen, places in _loaded(batches):
            own, distance = _nearest(first, seen, places, centroids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(assign, "vec_id long, cluster int, distance long")


def centroids_of(rows: DataFrame, blocks: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after `rounds` rounds; fewer than k where there are fewer vectors."""
    centroids = first_centroids(rows, k)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(blocks, centroids)
    return centroids


def _by_cluster(values: dict[int, object], kind: str) -> Column:
    """A column of values by cluster, at most one for each centroid."""
    out = F.lit(None).cast(kind)
    if values:
        out = F.create_map(*[F.lit(x) for c, v in values.items() for x in (c, v)])[F.col("cluster")].cast(kind)
    return out


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector with exactly 64 finite components.

    Other rows (null vectors, other lengths, null or non-finite components) are left out. Components beyond 2^27 units of 1/256
    count as that, so that every distance fits a long; an inertia that does not fit is null. A null vec_id is hashed as an empty
    one; repeated vec_ids keep their rows, and equal hashes are ordered by components. An empty table, or one without such
    vectors, gives no rows; further columns are ignored.
    """
    rows = integer_vectors(vectors)
    blocks = stash(in_blocks(rows, block_rows))
    centroids = centroids_of(rows, blocks, k, rounds)
    if not len(centroids):
        return assigned(blocks, np.zeros((1, DIMENSIONS), dtype=np.int64)).selectExpr("*", "distance as cluster_inertia", "distance as inertia", "'' as centroid_sha256")
    out = stash(assigned(blocks, centroids))
    inertia = {r.cluster: int(r.d) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast(EXACT)).alias("d")).collect()}
    fits = lambda v: v if v < 1 << 63 else None
    names = {c: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for c, x in enumerate(centroids.tolist())}
    known = {c: fits(v) for c, v in inertia.items()}
    return out.select("*", _by_cluster(known, "long").alias("cluster_inertia"), F.lit(fits(sum(inertia.values()))).cast("long").alias("inertia"), _by_cluster(names, "string").alias("centroid_sha256"))


def oracle_sql(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for `cluster`: centroids as rows (cluster, dimension, value), one pair of tables a round."""
    distances = "select r, c, sum((x - y) * (x - y)) as distance from e join c{n} using (d) group by r, c"
    parts = [
        "v as materialized (select row_number() over () as r, vec_id, list_transform(embedding::double[], lambda z: floor(256 * z)::bigint) as x from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda z: isfinite(z::double))) = 64)",
        "e as materialized (select r, unnest(range(64)) as d, unnest(x) as x from v)",
        f"first as materialized (select r, row_number() over (order by sha256('2:' || coalesce(vec_id::varchar, '')), x) - 1 as c from v qualify c < {k})",
        "c0 as materialized (select c, d, x as y from first join e using (r))",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} as materialized (select r, arg_min(c, (distance, c)) as c, min(distance) as distance from ({distances.format(n=n)}) group by r)")
        if n < rounds:
            parts.append(f"s{n} as materialized (select c, d, floor_div as y from (select c, d, (sum(x) - ((sum(x) % count(*) + count(*)) % count(*))) // count(*) as floor_div from a{n} join e using (r) group by c, d))")
            parts.append(f"c{n + 1} as materialized (select c, d, coalesce(s{n}.y, c{n}.y)::bigint as y from c{n} left join s{n} using (c, d))")
    last = f"a{rounds}"
    parts.append(f"h as (select c, sha256(string_agg(y::varchar, ',' order by d)) as centroid_sha256 from c{rounds} group by c)")
    return "with " + ",\n".join(parts) + f"\nselect vec_id, c::int as cluster, distance::bigint as distance, (sum(distance) over (partition by c))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia, centroid_sha256 from {last} join v using (r) join h using (c)"
