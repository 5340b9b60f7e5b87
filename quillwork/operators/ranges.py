"""Order across rows without one task a group: carries over ranges of rows.

A group of rows (a sheet, a document) is cut into ranges along its order. Each range is summed up by one row, the summaries are
scanned in order, and what a range inherits is joined back to its rows. Windows over rows hold one range each; only the summaries
of a group, one row for each `RANGE_ROWS` positions, come together in a task. Rows and summaries are partitioned by the same
column, so the join moves no row again.

Null keys and positions are values like others and come first, and rows are carried as a struct, so a caller's columns may have any
names. Equal rows are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS = 4096


def range_of(position: str, rows: int = RANGE_ROWS) -> Column:
    """The number of the range of an integer position; null for a null one."""
    return F.floor(F.col(position) / rows)


def plain_columns(df: DataFrame, without: tuple[str, ...], of: str = "r") -> list[Column]:
    """Columns of the struct `of` that holds df's rows, but for those whose names a result takes (in any case)."""
    taken = {n.lower() for n in without}
    return [F.col(f"{of}.`{c.replace('`', '``')}`").alias(c) for c in df.columns if c.lower() not in taken]


def _ranged(df: DataFrame, group: list[str], part: Column, order: list[Column]) -> DataFrame:
    """r (the row), o (its place within the group) and seg (group and range), partitioned by seg: what the windows ask for, so rows
    move once, and long expressions of the caller's are computed before."""
    return df.select(F.struct("*").alias("r"), F.struct(*order).alias("o"), F.struct(F.struct(*group).alias("g"), part.alias("p")).alias("seg")).repartition("seg")


def _windows() -> tuple:
    """Windows over the rows of a range, over the summaries of a group, and over the summaries before each."""
    ranges = Window.partitionBy("seg.g").orderBy("seg.p")
    return Window.partitionBy("seg").orderBy("o"), ranges, ranges.rowsBetween(Window.unboundedPreceding, -1)


def carry_down(df: DataFrame, group: list[str], position: str, value: str, result: str, rows: int = RANGE_ROWS) -> DataFrame:
    """df with result: the last value that is not null at or before each row of its group, in order of an integer position.

    Rows before a group's first value get null. Of rows that share a position, the greatest value counts last.
    """
    inside, _, before = _windows()
    d = _ranged(df, group, range_of(position, rows), [F.col(position), F.col(value)])
    v = F.col("o")[value]
    d = d.withColumn("own", F.last(v, True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    last = d.groupBy("seg").agg(F.max_by(v, F.when(v.isNotNull(), F.col("o"))).alias("last"))
    inherited = last.select(F.col("seg").alias("to"), F.last("last", True).over(before).alias("got"))
    return d.join(inherited, F.col("seg") == F.col("to")).select(*plain_columns(df, (result,)), F.coalesce("own", "got").alias(result))


def running_start(df: DataFrame, group: list[str], part: Column, order: list[str], size: Column, result: str) -> DataFrame:
    """df with result (long): the sum of size, an expression on the row `r`, over the rows that stand before each row in its group. `part` numbers ranges in an order
    that agrees with `order`; null sizes count as 0."""
    inside, _, before = _windows()
    d = _ranged(df, group, part, [F.col(c) for c in order]).withColumn("size", F.coalesce(size.cast("long"), F.lit(0)))
    d = d.withColumn("own", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = d.groupBy("seg").agg(F.sum("size").alias("total"))
    inherited = total.select(F.col("seg").alias("to"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("got"))
    return d.join(inherited, F.col("seg") == F.col("to")).select(*plain_columns(df, (result,)), (F.col("own") + F.col("got")).alias(result))


def runs(df: DataFrame, group: list[str], position: str, order: list[str], key: Column, rows: int = RANGE_ROWS) -> DataFrame:
    """df with key, run (from 1, by group), place (of the row in its run, from 1) and run_rows (its length): maximal runs of equal keys
    in `order`, which starts with the integer position. A null key equals no key, so each is a run."""
    inside, ranges, before = _windows()
    d = _ranged(df.withColumn("key", key), group, range_of(position, rows), [F.col(c) for c in order])
    k = F.col("r.key")
    d = d.withColumn("at", F.row_number().over(inside).cast("long")).withColumn("back", F.lag(k).over(inside))
    # whether a range's first row opens a run is known only from the range before
    opens = (F.col("at") > 1) & ~F.coalesce(F.col("back") == k, F.lit(False))
    d = d.withColumn("opens", opens).withColumn("opened", F.sum(opens.cast("long")).over(inside)).withColumn("since", F.last(F.when(opens, F.col("at")), True).over(inside))
    ahead = inside.rowsBetween(1, Window.unboundedFollowing)
    d = d.withColumn("until", F.min(F.when(F.col("opens"), F.col("at"))).over(ahead))
    s = d.groupBy("seg").agg(
        F.count("*").alias("n"), F.max("opened").alias("opened"), F.min_by("r.key", "at").alias("first"), F.max_by("r.key", "at").alias("last"),
        F.min(F.when(F.col("opens"), F.col("at"))).alias("first_open"), F.max(F.when(F.col("opens"), F.col("at"))).alias("last_open"),
    )
    s = s.withColumn("fresh", ~F.coalesce(F.lag("last").over(ranges) == F.col("first"), F.lit(False)))
    s = s.withColumn("rows_before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("runs_before", F.coalesce(F.sum(F.col("opened") + F.col("fresh").cast("long")).over(before), F.lit(0)))
    one = F.when(F.col("fresh"), F.lit(1))
    s = s.withColumn("newest", F.col("rows_before") + F.coalesce("last_open", one)).withColumn("oldest", F.col("rows_before") + F.coalesce(one, "first_open"))
    whole = Window.partitionBy("seg.g")
    s = s.withColumn("start", F.when(F.col("fresh"), F.col("rows_before") + 1).otherwise(F.last("newest", True).over(before)))
    s = s.withColumn("end", F.coalesce(F.min("oldest").over(ranges.rowsBetween(1, Window.unboundedFollowing)), F.sum("n").over(whole) + 1))
    s = s.select(F.col("seg").alias("to"), "fresh", "rows_before", "runs_before", "start", "end")
    at, start = F.col("rows_before") + F.col("at"), F.coalesce(F.col("rows_before") + F.col("since"), F.col("start"))
    end = F.coalesce(F.col("rows_before") + F.col("until"), F.col("end"))
    d = d.join(s, F.col("seg") == F.col("to"))
    return d.select(*plain_columns(df, ("key", "run", "place", "run_rows")), k.alias("key"), (F.col("runs_before") + F.col("fresh").cast("long") + F.col("opened")).alias("run"), (at - start + 1).alias("place"), (end - start).alias("run_rows"))


def text_blocks(pieces: DataFrame, group: list[str], part: Column, order: list[str], text: str = "text", separator: str = "", budget: int = 1 << 20) -> DataFrame:
    """group, block (from 0), start (bytes before it) and text: each group's texts, joined in order, as blocks of at most `budget`
    UTF-8 bytes.

    The blocks of a group, one after the other, are its texts joined by the separator; block numbers have no gaps. A block holds what
    starts within half a budget, and longer texts are cut into pieces of an eighth of the budget in characters, so no block needs more
    than its own rows. Null texts count as empty; a group of empty texts has one empty block. Of rows that are equal in `order`, the
    smaller text comes first.
    """
    if budget < 8:
        raise ValueError("a block holds at least 8 bytes")
    half, chars, gap = budget // 2, budget // 8, len(separator.encode())
    d = pieces.select(F.struct(*group).alias("g"), part.alias("p"), F.struct(*order, F.coalesce(F.col(text), F.lit("")).alias("text")).alias("o"))
    d = running_start(d, ["g"], F.col("p"), ["o"], F.octet_length(F.col("r.o.text")) + gap, "start")
    # a group's first text has no separator before it
    d = d.select("g", F.greatest(F.lit(0), F.col("start") - gap).alias("start"), F.when(F.col("start") > 0, F.concat(F.lit(separator), "o.text")).otherwise(F.col("o.text")).alias("t"))
    count = F.greatest(F.lit(1), F.ceil(F.length("t") / chars).cast("int"))
    d = d.select("g", "start", "t", count.alias("n"), F.explode(F.sequence(F.lit(0), count - 1)).alias("i"))
    before = F.when(F.col("i") > 0, F.octet_length(F.substring("t", F.lit(1), F.col("i") * chars))).otherwise(0)
    d = d.select("g", (F.col("start") + before).alias("start"), F.when(F.col("n") == 1, F.col("t")).otherwise(F.substring("t", F.col("i") * chars + 1, F.lit(chars))).alias("t"))
    # empty texts only see to it that their group has a block
    d = d.withColumn("block", F.when(F.col("t") == "", 0).otherwise(F.floor(F.col("start") / half)).cast("long"))
    d = d.groupBy("g", "block").agg(F.min("start").alias("start"), F.array_sort(F.collect_list(F.when(F.col("t") != "", F.struct("start", "t")))).alias("ts"))
    return d.select("g.*", "block", "start", F.array_join(F.transform("ts", lambda x: x["t"]), "").alias("text"))
