"""SimHash near-duplicates by tiled exact comparison: exclusive-or and bit counts, without tile pairs too far apart.

A fingerprint's tile is the vector of its population counts in four 16-bit quarters. Each differing bit changes one count by
one, so two fingerprints within the radius have counts that differ by at most the radius in sum: other tile pairs are skipped,
and none is missed. Distinct fingerprints are compared, each in its own tile and, as a visitor, in the 64 neighbouring tiles of
higher order: a constant factor, not one that grows with the data.
"""

from __future__ import annotations

from functools import cache
from itertools import product
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stash, words_of
from .components import Forest, components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Residents of a tile that one task holds; a larger tile is cut by a hash, and visitors go to every cut.
TILE_ROWS = 1 << 17
CHUNK_WORDS = 1 << 16
#: Rows of one fingerprint that one task joins with its component.
COPIES = 1000


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a whole text; a bit is 1 if set in over half of the hashes."""
    words = words_of(text or b"")
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(b" ".join(words), SEED)
    ones, n = np.zeros(64, dtype=np.int64), len(words) - shingle + 1
    for at in range(0, n, CHUNK_WORDS):
        part = words[at : min(n, at + CHUNK_WORDS) + shingle - 1]
        hashes = np.fromiter((digest(b" ".join(s), SEED) for s in zip(*(part[k:] for k in range(shingle)), strict=False)), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of every row; null and empty texts have fingerprint 0."""

    def compute(batches):
        for batch in small(batches):
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(compute, "doc_id long, fp long")


def _ahead(radius: int) -> list[tuple[int, ...]]:
    """Tile offsets within the radius whose first nonzero count is positive: one of each pair of opposite offsets."""
    near = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]
    return [d for d in near if next((x for x in d if x), 0) > 0]


def _pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool = False):
    """Row and column numbers of pairs within the radius, block by block; rows are a word or, in two dimensions, a few. Of a table
    with itself only the blocks on and under the diagonal, so that no pair is missed."""
    a, b = (np.ascontiguousarray(np.atleast_2d(x.T)) for x in (a, b))
    for at in range(0, a.shape[1], 256):
        for off in range(0, min(b.shape[1], at + 256) if same else b.shape[1], 8192):
            bits = (np.bitwise_count(x[at : at + 256, None] ^ y[None, off : off + 8192]) for x, y in zip(a, b, strict=True))
            close = sum(bits, start=next(bits)) <= radius
            i, j = np.nonzero(close)
            if len(i):
                yield i + at, j + off


def _compare(radius: int):
    def compare(batches):
        tile, residents, parts = None, None, []

        def links_of(visitors: np.ndarray, same: bool):
            # visitors are numbered after residents; residents among themselves keep their numbers
            both, shift = (residents, 0) if same else (np.concatenate([residents, visitors]), len(residents))
            forest = Forest(len(both))
            for i, j in _pairs(visitors, residents, radius, same):
                forest.add(i + shift, j)
            links = forest.pairs()
            return pa.RecordBatch.from_arrays([pa.array(both[links[:, k]].view(np.int64)) for k in (0, 1)], ["a", "b"]) if len(links) else None

        def settle():
            nonlocal residents
            residents = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
            return links_of(residents, True) if len(residents) > 1 else None

        for batch in batches:
            key, role = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fp = batch.column(2).to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (role[1:] != role[:-1])]) if len(key) else []
            for s, e in zip(starts, np.r_[starts[1:], len(key)] if len(key) else [], strict=True):
                s, e = int(s), int(e)
                if key[s] != tile:
                    if tile is not None and residents is None and (out := settle()):
                        yield out
                    tile, residents, parts = key[s], None, []
                if role[s] == 0:
                    parts.append(fp[s:e].copy())
                    continue
                if residents is None and (out := settle()):
                    yield out
                if len(residents) and (out := links_of(fp[s:e], False)):
                    yield out
        if tile is not None and residents is None and (out := settle()):
            yield out

    return compare


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """a, b: links that connect distinct fingerprints (column fp, each once) exactly as all pairs within the radius do."""
    quarters = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))).cast("int") for k in range(4)]
    # a count is 0..16; with room for the radius on both sides
    base = 17 + 2 * radius
    code = lambda counts: sum((c + radius) * base**k for k, c in enumerate(counts))
    steps = F.array(*[F.lit(sum(x * base**k for k, x in enumerate(d))) for d in _ahead(radius)])
    placed = prints.select("fp", code(quarters).cast("long").alias("tile"))
    placed, cuts_of = with_cuts(placed, tile_rows)
    placed = placed.withColumn("cut", F.pmod(F.xxhash64("fp"), "cuts"))
    residents = placed.select("tile", "cut", F.lit(0).alias("role"), "fp")
    visitors = cuts_of(placed.withColumn("to", F.explode(steps)).select((F.col("tile") + F.col("to")).alias("tile"), "fp"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("cut")
    visitors = visitors.select("tile", every, F.lit(1).alias("role"), "fp")
    # inside a tile that is cut, a row visits the later cuts
    inside = placed.where("cut < cuts - 1").select("tile", F.explode(F.sequence(F.col("cut") + 1, F.col("cuts") - 1)).alias("cut"), F.lit(1).alias("role"), "fp")
    both = residents.unionByName(visitors).unionByName(inside).select((F.col("tile") * (1 << 24) + F.col("cut")).alias("tile"), "role", "fp")
    return both.repartition("tile").sortWithinPartitions("tile", "role").mapInArrow(_compare(radius), "a long, b long")


#: Large tiles whose cuts are sent to all executors; more of them are joined by a shuffle.
SENT_TILES = 10_000


def with_cuts(rows: DataFrame, tile_rows: float | Column):
    """rows (tile) with cuts, the number of parts of a tile, so that a part has about tile_rows rows; and a function that adds
    cuts to other rows with a tile. Only tiles over that size are listed, so the list has at most rows / tile_rows entries."""
    tile_rows = tile_rows if isinstance(tile_rows, Column) else F.lit(tile_rows)
    large = rows.groupBy("tile").count().where(F.col("count") > tile_rows).select("tile", F.ceil(F.col("count") / tile_rows).cast("long").alias("cuts"))
    large = stash(large)
    n = large.count()

    def cuts_of(other: DataFrame) -> DataFrame:
        if not n:
            return other.withColumn("cuts", F.lit(1).cast("long"))
        known = F.broadcast(large) if n <= SENT_TILES else large
        return other.join(known, "tile", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1).cast("long")))

    return cuts_of(rows), cuts_of


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable by links, itself included) of every row.

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows each keep their row. A null doc_id never is a
    component's id while another doc_id is in it. An empty table gives no rows; further columns are ignored.
    """
    seen = stash(fingerprints(docs, shingle))
    prints = stash(seen.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = components(fingerprint_links(prints.select("fp"), radius))
    known = linked.join(prints, linked["node"] == prints["fp"]).select("fp", "component", "first")
    of = known.groupBy("component").agg(F.min("first").alias("component_id"))
    own = known.join(of, "component").select("fp", "component_id")
    ids = prints.join(own, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    # a fingerprint of many rows is dealt over tasks by their ids
    rows, cuts_of = with_cuts(seen.withColumnRenamed("fp", "tile"), COPIES)
    rows = rows.withColumn("cut", F.pmod(F.xxhash64("doc_id"), "cuts"))
    known = cuts_of(ids.withColumnRenamed("fp", "tile")).withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))).drop("cuts")
    return rows.join(known, ["tile", "cut"]).select("doc_id", F.lower(F.lpad(F.hex("tile"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs, whole, less near-duplicates: of each component the document with the smallest doc_id stays, and of rows
    that repeat a doc_id one. Rows with a null doc_id stay."""
    found = near_duplicates(docs, radius, shingle)
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    return one_of_each(docs, first)


def one_of_each(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs, whole, whose doc_id is in ids (each once), one of those that repeat a doc_id, and all without a doc_id.

    A row travels as one column, so its columns may have any name and type. Which of the rows that repeat a doc_id stays follows
    from their contents, not from their order.
    """
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), F.xxhash64(rest).alias("r"), row)
    named = rows.join(ids.select(F.col("doc_id").alias("id")), "id", "left_semi")
    n = F.row_number().over(Window.partitionBy("id").orderBy("h", "r"))
    return named.withColumn("n", n).where("n = 1").select("row.*").unionByName(docs.where("doc_id is null"))


# ---- near-duplicates by shingle similarity: a wide fingerprint of distinct shingles finds candidates, exact counts decide

WIDE_WORDS = 16
FIRST_WORDS = 2
SIMILARITY = 0.8
#: Most chance of missing a pair at the similarity, each for the first 128 bits and for all.
MISS = 1e-6
CUTS = 3
CUT_ROWS = 1 << 17
#: Shingle hashes that one side of a task holds where sets travel: 32 MB.
CUT_HASHES = 1 << 22


def gram_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """The hashes of the distinct word shingles of a whole text, sorted."""
    words = words_of(text or b"")
    grams = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else ()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), dtype=np.uint64, count=len(grams)))


def set_key(hashes: np.ndarray) -> int:
    """Equal for equal sets: a signed 64-bit hash."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """A SimHash of 1024 bits of a set of hashes, each expanded by 16 odd multipliers; of none zeros."""
    rng = np.random.default_rng(SEED)
    odd = rng.integers(1, 2**63, (2, WIDE_WORDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    ones = np.zeros(64 * WIDE_WORDS, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        x = hashes[at : at + 4096, None] * odd[0]
        x = (x ^ (x >> np.uint64(29))) * odd[1]
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def _binomial(n: int, p: float = 0.5) -> np.ndarray:
    return np.array([comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])


def disagreement(common: int, a: int, b: int) -> float:
    """The chance that a SimHash bit differs between sets with so many common and own elements; ties are zeros."""
    k = np.arange(common + 1)
    above = lambda own: np.r_[np.cumsum(_binomial(own)[::-1])[::-1], 0][np.clip((common + own) // 2 + 1 - k, 0, own + 1)]
    x, y = above(a), above(b)
    return float((_binomial(common) * (x * (1 - y) + y * (1 - x))).sum())


@cache
def radii(similarity: float, size: int) -> tuple[int, ...]:
    """Differing bits of the first 128 and of all that sets of that size or more, and that similar, exceed by a chance of MISS.

    Sets with Jaccard similarity j differ in a bit by the angle's share of pi, most at equal sizes (cosine 2j / (1 + j)). That
    holds for large sets; unions up to 128 are counted out, and beyond them no rounding adds 2 %.
    """
    worst = 1.02 * np.arccos(2 * similarity / (1 + similarity)) / np.pi
    for union in range(size + 1, 129):
        common = int(np.ceil(similarity * union - 1e-9))
        worst = max([worst, *(disagreement(common, x, union - common - x) for x in range((union - common) // 2 + 1))])
    return tuple(int(np.argmax(np.cumsum(_binomial(n, worst)[::-1])[::-1] < MISS)) for n in (64 * FIRST_WORDS, 64 * WIDE_WORDS))


def _least_size(similarity: float) -> int:
    """Smaller sets are that similar only if equal: one more element on one side is too much."""
    return int(np.ceil(similarity / (1 - similarity) - 1e-9))


def _tile_radii(similarity: float, tile: int) -> tuple[int, ...]:
    return radii(similarity, min(128, max(_least_size(similarity), int(np.ceil(similarity**-tile - 1e-6)))))


def _nearest(n: int, links: np.ndarray) -> np.ndarray:
    """Of links (i, j, distance) among n rows a tree each component, nearest links first."""
    root = list(range(n))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    keep = []
    order = np.argsort(links[:, 2], kind="stable")
    for at, i, j in zip(order.tolist(), *links[order, :2].T.tolist(), strict=True):
        i, j = find(i), find(j)
        if i != j:
            root[i] = j
            keep.append(at)
    return links[keep]


class _Cell:
    """One comparison: side 0 with side 1, or side 0 with itself. Rows of side 0 come first."""

    def __init__(self, table: pa.Table, similarity: float):
        side = table.column("side").to_numpy()
        self.order = np.argsort(side, kind="stable")
        self.keys, self.n = table.column("key").to_numpy()[self.order], int((side == 0).sum())
        self.bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), dtype="<u8").reshape(len(side), WIDE_WORDS)[self.order] if len(side) else None
        self.same = len(side) > 0 and table.column("way")[0].as_py() == 0 and table.column("i")[0].as_py() == table.column("j")[0].as_py()
        self.radii = _tile_radii(similarity, table.column("tile")[0].as_py()) if len(side) else (0, 0)

    def pairs(self):
        """(i, j, differing bits) of pairs within the radii, at most 65,536 at a time."""
        if not self.same and self.n in (0, len(self.keys)):
            return
        shift = 0 if self.same else self.n
        a, b = (self.bits, self.bits) if self.same else (self.bits[: self.n], self.bits[self.n :])
        first, whole = self.radii
        for i, j in _pairs(a[:, :FIRST_WORDS], b[:, :FIRST_WORDS], first):
            for at in range(0, len(i), 1 << 16):
                p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                if self.same:
                    p, q = p[p < q], q[p < q]
                far = np.bitwise_count(a[p] ^ b[q]).sum(axis=1, dtype=np.int64)
                close = far <= whole
                if close.any():
                    yield p[close], q[close] + shift, far[close]

    def links(self, found: list[tuple[int, int]] | np.ndarray) -> pa.Table:
        found = np.asarray(found, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": self.keys[found[:, 0]], "b": self.keys[found[:, 1]]})


def _nearest_links(similarity: float):
    """Of each cell the nearest candidates that join its components: no more links than rows."""

    def compare(table: pa.Table) -> pa.Table:
        cell, found = _Cell(table, similarity), [np.zeros((0, 3), dtype=np.int64)]
        for p, q, far in cell.pairs():
            found.append(np.stack([p, q, far], axis=1))
            if sum(map(len, found)) > (1 << 16) + len(cell.keys):
                found = [_nearest(len(cell.keys), np.concatenate(found))]
        return cell.links(_nearest(len(cell.keys), np.concatenate(found))[:, :2])

    return compare


def alike(a: bytes, b: bytes, similarity: float) -> bool:
    """Whether two sets of hashes have at least that Jaccard similarity, from exact counts."""
    a, b = np.frombuffer(a, dtype="<u8"), np.frombuffer(b, dtype="<u8")
    both = np.sort(np.concatenate([a, b]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common >= similarity * (len(both) - common) - 1e-9


def _joining_links(similarity: float):
    """Every candidate between different groups of a cell is decided by its sets, unless links found before have joined its groups:
    so what a cell gives out are trees, however many candidates a dense region has."""

    def compare(table: pa.Table) -> pa.Table:
        cell, found = _Cell(table, similarity), []
        group = np.unique(table.column("grp").to_numpy()[cell.order], return_inverse=True)[1]
        sets = table.column("hashes").to_pylist()
        sets = [sets[k] for k in cell.order]
        root = list(range(len(group)))

        def find(k):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for p, q, _ in cell.pairs():
            apart = group[p] != group[q]
            for i, j in zip(p[apart].tolist(), q[apart].tolist(), strict=True):
                x, y = find(int(group[i])), find(int(group[j]))
                if x != y and alike(sets[i], sets[j], similarity):
                    root[x] = y
                    found.append((i, j))
        return cell.links(found)

    return compare


def compared(classes: DataFrame, compare, similarity: float = SIMILARITY, cuts: int = CUTS, rows: float = CUT_ROWS, hashes: int | None = None) -> DataFrame:
    """a, b: what `compare` finds in cells of classes (key, size, bits and further columns of theirs).

    Sets that similar differ in size by the same factor at most, so classes are tiled by the logarithm of their size and compared
    within a tile and with the next. Tiles are cut by a hash into parts of about so many rows (or, where sets travel, hashes), and
    each pair of parts is one task.
    """
    step = -np.log(similarity)
    tiled = classes.where(F.col("size") >= _least_size(similarity)).withColumn("tile", F.floor(F.log("size") / step + 1e-9).cast("long"))
    most = F.lit(float(rows)) if hashes is None else F.greatest(F.lit(64.0), F.lit(float(hashes)) * F.pow(F.lit(similarity), F.col("tile")))
    tiled, cuts_of = with_cuts(tiled, most)
    part = tiled.withColumn("cuts", F.greatest("cuts", F.lit(cuts))).withColumn("part", F.pmod(F.xxhash64("key"), "cuts"))
    beside = lambda step: cuts_of(part.drop("cuts").withColumn("own", F.col("tile")).withColumn("tile", F.col("tile") + step)).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("cuts", F.lit(cuts)) - 1)))
    rest = [c for c in classes.columns if c != "size"]
    # within a tile a part meets itself and each later part; with the next tile every part meets every part
    own = part.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))).select("tile", F.lit(0).alias("way"), F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), (F.col("part") > F.col("o")).cast("int").alias("side"), *rest)
    low = beside(1).select(F.col("own").alias("tile"), F.lit(1).alias("way"), F.col("part").alias("i"), F.col("o").alias("j"), F.lit(0).alias("side"), *rest)
    high = beside(-1).select("tile", F.lit(1).alias("way"), F.col("o").alias("i"), F.col("part").alias("j"), F.lit(1).alias("side"), *rest)
    cells = own.unionByName(low).unionByName(high)
    return cells.groupBy("tile", "way", "i", "j").applyInArrow(compare, "a long, b long")


def verified(links: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The links (a, b) whose sets (key, hashes) have at least that Jaccard similarity."""

    def count(batches):
        for batch in small(batches):
            keep = [alike(a, b, similarity) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], ["a", "b"])

    one, other = (sets.select(F.col("key").alias(k), F.col("hashes").alias(f"set_{k}")) for k in "ab")
    pairs = links.join(one, "a").join(other, "b").select("a", "b", "set_a", "set_b")
    return pairs.mapInArrow(count, "a long, b long")


def keep_one_similar(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, whole, less near-duplicates by word shingles: of each group linked by texts of at least that Jaccard
    similarity the document with the smallest doc_id stays, and of rows that repeat a doc_id one. Texts without words are copies
    of each other. Rows with a null doc_id stay.

    1024 bits name candidates and exact counts of shingle hashes decide: first over the nearest candidates that join each cell's
    components, then over every candidate whose ends the exact links have not joined yet. So links between all exact pairs are
    kept up to components, and a large group of copies costs about its rows, not its pairs.
    """

    def compute(batches):
        for batch in small(batches):
            found = [gram_hashes(t, shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([set_key(h) for h in found], pa.int64()), pa.array([len(h) for h in found], pa.int64()), pa.array([sketch(h).tobytes() for h in found], pa.binary())], ["doc_id", "key", "size", "bits"])

    def sets_of(batches):
        for batch in small(batches):
            found = [gram_hashes(t, shingle) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(h) for h in found], pa.int64()), pa.array([h.tobytes() for h in found], pa.binary())], ["key", "hashes"])

    named = docs.where("doc_id is not null")
    seen = named.select(F.col("doc_id").cast("long"), "text").mapInArrow(compute, "doc_id long, key long, size long, bits binary")
    classes = stash(seen.groupBy("key", "size", "bits").agg(F.min("doc_id").alias("id")))
    ids = classes.select("key", "id")

    def by_id(links):
        a, b = (ids.select(F.col("key").alias(k), F.col("id").alias(f"id_{k}")) for k in "ab")
        return stash(links.join(a, "a").join(b, "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))

    # every class with a candidate is in a tree of the nearest, so their sets serve both rounds
    nearest = stash(compared(classes.select("key", "size", "bits"), _nearest_links(similarity), similarity).distinct())
    ends = nearest.select(F.col("a").alias("key")).union(nearest.select("b")).distinct()
    texts = named.join(ids.join(ends, "key", "left_semi").select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").select("text")
    # a repeated doc_id has several texts
    sets = stash(texts.mapInArrow(sets_of, "key long, hashes binary").groupBy("key").agg(F.first("hashes").alias("hashes")))
    links = by_id(verified(nearest, sets, similarity))
    groups = components(links).select(F.col("node").alias("id"), "component")
    grouped = classes.join(ends, "key", "left_semi").join(groups, "id", "left").select("key", "size", "bits", F.coalesce("component", "id").alias("grp"))
    further = compared(grouped.join(sets, "key"), _joining_links(similarity), similarity, cuts=1, hashes=CUT_HASHES)
    found = components(links.unionByName(by_id(further.distinct())))
    first = classes.select("id").join(found.where("node <> component").select(F.col("node").alias("id")), "id", "left_anti").select(F.col("id").alias("doc_id")).distinct()
    return one_of_each(docs, first)
