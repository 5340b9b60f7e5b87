"""Mixing sources to target weights by Pfair scheduling. DataFrame functions only on the rows; the driver plans one period.

Each source's rows form blocks. With w the source's share, its block j (from 0) is released at slot floor(j / w) and is due by
slot ceil((j + 1) / w). Earliest deadline first over released blocks then keeps every source within one block of w * slots at
every slot. Shares are integers, so the schedule repeats with their sum as period; one period is planned from the shares alone.
When a source has no blocks left, the next phase goes on with the others' shares.

Sources without a share have equal ones, so k of them are planned as one task of k times that share, whose blocks go round them:
block j of each in turn, then block j + 1 of those that have one. The task is less than one block off its share, and so is each
of them off a k-th of it, whatever their number.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The columns that mixing adds.
COLUMNS = ("mix_source", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_position")
OTHER = "(other)"
BLOCK_ROWS = 64
SLICES = 1024
#: A source has a slice for so many rows, up to SLICES.
SLICE_ROWS = 256
#: Target shares of the pipeline and of op10; a source not named here has the share of OTHER.
SHARES = {"src0": 8, **{f"src{i}": 4 for i in range(1, 10)}, **{f"src{i}": 2 for i in range(10, 20)}, OTHER: 1}


def period(shares: Mapping[str, int]) -> dict[str, list[int]]:
    """The slots of one period that each source's blocks take: earliest deadline first among released blocks, ties by name."""
    total = sum(shares.values())
    slots: dict[str, list[int]] = {s: [] for s in shares}
    waiting, ready = [(0, s) for s in sorted(shares)], []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * total // shares[s]), s))
        s = heapq.heappop(ready)[1]
        slots[s].append(t)
        if len(slots[s]) < shares[s]:
            heapq.heappush(waiting, (len(slots[s]) * total // shares[s], s))
    return slots


def phases(blocks: Mapping[str, int], shares: Mapping[str, int]) -> list[dict]:
    """The phases of the schedule: until some source runs out, with each active source's first and last block and its slots."""
    done, start, out = dict.fromkeys(blocks, 0), 0, []
    while active := {s: shares[s] for s in sorted(blocks) if done[s] < blocks[s]}:
        slots, total = period(active), sum(active.values())
        # the slot after the last block of the source that ends first
        length = min((n - 1) // active[s] * total + slots[s][(n - 1) % active[s]] + 1 for s in active for n in [blocks[s] - done[s]])
        rounds, rest = divmod(length, total)
        took = {s: rounds * active[s] + sum(x < rest for x in slots[s]) for s in active}
        out.append({"start": start, "total": total, "shares": active, "slots": slots, "first": dict(done), "took": took})
        done = {s: done[s] + took.get(s, 0) for s in done}
        start += length
    return out


def mix(docs: DataFrame, shares: Mapping[str, int] = SHARES, block_rows: int = BLOCK_ROWS, key: str = "doc_id", source: str = "source", slices: int = SLICES, own_streams: bool = False) -> DataFrame:
    """Every row of docs with mix_source, mix_block, mix_slot, mix_release, mix_deadline and mix_position (gapless from 0).

    No row is dropped, repeated or sampled. A source without a share has that of `shares[OTHER]` or else the least: with
    `own_streams` each by itself, null sources as OTHER, else all of them pooled as OTHER. What a source without a share leaves
    when it ends goes to the others of its kind; what a source with a share leaves, to all. Inside a source rows come in a hash
    order of the whole row; a source's last block may be short. An empty table gives an empty result. Other columns, of any type
    and name, pass through untouched; a column of docs with the name of one of the six is replaced.

    Rows are numbered in up to `slices` hash slices a source, so that no task holds a whole source; equal rows share a slice. The
    driver learns each source's size and plans (sum of shares) slots for each phase. Sizes of slices (a row for each source and
    one for every SLICE_ROWS rows, at most `slices` a source), and the phase and slot tables are broadcast.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in COLUMNS])
    return _positions(docs, own, shares, block_rows, key, source, slices, own_streams).select("row.*", *COLUMNS)


def _last_at_most(bounds: np.ndarray, x: Column) -> Column:
    """How many of the sorted bounds are at most x: a binary search, a step for each bit of their number."""
    if not len(bounds):
        return F.lit(0)
    listed = _array(bounds)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.element_at(listed, F.least(at + step, F.lit(len(bounds)))) <= x), at + step).otherwise(at))


def _array(values: np.ndarray) -> Column:
    """A constant array of longs; its text form is folded once and costs no expression for each value."""
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast("array<bigint>")


def _hashable(kind: object) -> bool:
    return "map<" not in kind.simpleString() and "variant" not in kind.simpleString()


def _positions(docs: DataFrame, row: Column, shares: Mapping[str, int], block_rows: int, key: str, source: str, slices: int, own_streams: bool) -> DataFrame:
    """row and COLUMNS. All that docs has travels in the one column `row`, so its names meet no other."""
    spark, shares = docs.sparkSession, dict(shares)
    least = shares.pop(OTHER, min(shares.values()))
    named = F.col("source").isin(list(shares))
    # rows of one key, null keys above all, are dealt over slices by their other columns
    salt = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if _hashable(f.dataType)])
    docs = docs.select(row.alias("row"), F.col(key).alias("key"), F.col(source).alias("source"), salt.alias("salt"))
    docs = docs.withColumn("mix_source", F.when(named, F.col("source")).otherwise(F.coalesce("source", F.lit(OTHER)) if own_streams else F.lit(OTHER)))
    counts = {r[0]: r[1] for r in docs.groupBy("mix_source").count().collect()}
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    # sources without a share, in the order in which a round serves them: those with more blocks first, so that a round's are a prefix
    loose = sorted((s for s in counts if s not in shares), key=lambda s: (-blocks[s], s))
    rank = {s: i for i, s in enumerate(loose)}
    held = np.sort(np.array([blocks[s] for s in loose], dtype=np.int64))
    ends, first = np.unique(held, return_index=True)
    # blocks of all rounds before round j: base + (members of round j) * (j - from), for the span of rounds that j lies in
    froms = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    members = len(loose) - first
    base = np.concatenate([[0], np.cumsum(members * (ends - froms))[:-1]]) if len(ends) else ends
    tasks = {s: n for s, n in blocks.items() if s in shares} | ({OTHER: int(held.sum())} if loose else {})
    plan = phases(tasks, shares | {OTHER: least * max(1, len(loose))})
    spans = [(s, p, ph["first"][s], ph["first"][s] + n, ph["start"], ph["total"], ph["shares"][s]) for p, ph in enumerate(plan) for s, n in ph["took"].items()]
    takes = [(s, p, i, t) for p, ph in enumerate(plan) for s, slots in ph["slots"].items() for i, t in enumerate(slots)]
    span = spark.createDataFrame(spans, "task string, _phase int, _first long, _end long, _start long, _total long, _share long")
    take = spark.createDataFrame(takes, "task string, _phase int, _i long, _slot long")
    # a source's last block is short by some rows; later blocks start that much earlier
    short = sorted((_slot_of(plan, *_turn(s, blocks[s] - 1, rank, froms, members, base)), blocks[s] * block_rows - n) for s, n in counts.items() if n % block_rows)
    after, lost = np.array([x[0] for x in short], dtype=np.int64), np.concatenate([[0], np.cumsum([x[1] for x in short])]).astype(np.int64)
    each = spark.createDataFrame([(s, rank.get(s, -1), min(slices, -(-n // SLICE_ROWS))) for s, n in counts.items()], "mix_source string, _rank int, _slices int")
    rows = docs.join(F.broadcast(each), "mix_source").withColumn("_slice", F.pmod(F.xxhash64("key", "salt"), "_slices"))
    before = Window.partitionBy("mix_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("mix_source", "_slice").count()
    offsets = sizes.select("mix_source", "_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("mix_source", "_slice").orderBy("key", "source", "salt")
    n = F.row_number().over(inside) - 1 + F.col("_offset")
    out = rows.join(F.broadcast(offsets), ["mix_source", "_slice"]).withColumn("_n", n).withColumn("mix_block", F.floor(F.col("_n") / block_rows))
    # a block's number among its task's: its own, or that of its turn among sources without a share
    at = F.when(F.col("_rank") >= 0, _last_at_most(froms, F.col("mix_block"))).otherwise(1)
    turn = F.element_at(_array(base), at) + F.element_at(_array(members), at) * (F.col("mix_block") - F.element_at(_array(froms), at)) + F.col("_rank") if loose else F.col("mix_block")
    out = out.withColumn("task", F.when(F.col("_rank") >= 0, F.lit(OTHER)).otherwise(F.col("mix_source"))).withColumn("_turn", F.when(F.col("_rank") >= 0, turn).otherwise(F.col("mix_block")))
    out = out.join(F.broadcast(span), "task").where((F.col("_turn") >= F.col("_first")) & (F.col("_turn") < F.col("_end")))
    own = F.col("_turn") - F.col("_first")
    out = out.withColumn("_i", own % F.col("_share")).join(F.broadcast(take), ["task", "_phase", "_i"])
    out = out.withColumn("mix_slot", F.col("_start") + F.floor(own / F.col("_share")) * F.col("_total") + F.col("_slot"))
    out = out.withColumn("mix_release", F.col("_start") + F.floor(own * F.col("_total") / F.col("_share"))).withColumn("mix_deadline", F.col("_start") + F.ceil((own + 1) * F.col("_total") / F.col("_share")))
    gone = F.element_at(_array(lost), _last_at_most(after, F.col("mix_slot") - 1) + 1)
    out = out.withColumn("mix_position", F.col("mix_slot") * block_rows + F.col("_n") % block_rows - gone)
    longs = ["mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_position"]
    return out.select("row", "mix_source", *[F.col(c).cast("long").alias(c) for c in longs])


def _turn(source: str, block: int, rank: Mapping[str, int], froms: np.ndarray, members: np.ndarray, base: np.ndarray) -> tuple[str, int]:
    """The task of a source and the number that a block of it has among the task's."""
    if source not in rank:
        return source, block
    at = int(np.searchsorted(froms, block, side="right")) - 1
    return OTHER, int(base[at] + members[at] * (block - froms[at])) + rank[source]


def _slot_of(plan: list[dict], task: str, turn: int) -> int:
    ph = next(ph for ph in plan if ph["first"].get(task, 0) <= turn < ph["first"].get(task, 0) + ph["took"].get(task, 0))
    j, share = turn - ph["first"][task], ph["shares"][task]
    return ph["start"] + j // share * ph["total"] + ph["slots"][task][j % share]


def mixed(docs: DataFrame, shares: Mapping[str, int] = SHARES, block_rows: int = BLOCK_ROWS, key: str = "doc_id", source: str = "source", slices: int = SLICES, own_streams: bool = False) -> DataFrame:
    """The rows of docs in mixed order, with docs' own columns, whatever their names and types.

    Null and empty texts, null sources, repeated rows and an empty table are as in `mix`: every row stays once.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return _positions(docs, own, shares, block_rows, key, source, slices, own_streams).orderBy("mix_position").select("row.*")
