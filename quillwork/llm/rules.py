"""Quality rules with thresholds that adapt to each language and source, from mergeable quantile sketches.

A sketch counts the values of a metric in log-linear buckets: values under 2^(BITS + 1) have a bucket each, larger ones keep their
BITS + 1 leading bits, so that a quantile errs by less than 2^-BITS of itself. Sketches merge by adding counts: those of a
language are the sums of its sources', and neither depends on how rows are cut into partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stash

WORDS_LEAST = 10
REPEAT_PERCENT = 20
WINDOW = 5
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
BITS = 7
#: Metrics in thousandths: (name, the least spread). A document fails where a metric is over REACH spreads from the group's median.
METRICS = (("word_length", 90), ("symbols", 6), ("line_copies", 20))
REACH = 20
#: A group of fewer documents takes the merged sketch of its language, a smaller language that of all documents.
GROUP_LEAST = 100
#: Groups whose thresholds are sent to all executors; more of them are joined by a shuffle over SALTS copies.
SENT_GROUPS = 10_000
SALTS = 16
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(words: Sequence[bytes], window: int = WINDOW) -> int:
    """How many words lie in runs of `window` words that occur twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    run = ids
    for k in range(1, window):
        # runs one word longer, numbered anew, so that numbers stay small and exact
        _, run = np.unique(run[: len(words) - k] * len(known) + ids[k:], return_inverse=True)
    starts = np.flatnonzero(np.bincount(run)[run] > 1)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of a whole text; a null text counts as empty."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and COUNTS of every row. A null language or source counts as the empty one."""

    def compute(batches):
        for batch in small(batches):
            found = np.array([counts(t) for t in batch.column(3).to_pylist()], dtype=np.int64).reshape(batch.num_rows, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, found.T)], ["doc_id", "lang", "source", *COUNTS])

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(F.col("doc_id").cast("long"), *text, "text").mapInArrow(compute, schema)


def bucket(value: Column, bits: int = BITS) -> Column:
    """The least value that shares value's bucket: its bits + 1 leading bits, the others 0. For value >= 0."""
    spare = F.greatest(F.length(F.bin(value)) - (bits + 1), F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", value, spare), spare)


def metrics() -> list[Column]:
    thousandths = lambda a, b: F.floor(1000 * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("long")
    values = (thousandths("word_chars", "n_words"), thousandths("n_symbols", "n_words"), thousandths("n_dup_lines", "n_lines"))
    return [v.alias(name) for v, (name, _) in zip(values, METRICS, strict=True)]


def sketches(seen: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n: the sketch of each metric over all documents with a word. Counts are added before the
    shuffle, so a hot source costs each task its number of buckets."""
    values = F.map_from_arrays(F.array(*[F.lit(name) for name, _ in METRICS]), F.array(*metrics()))
    rows = seen.where("n_words > 0").select("lang", "source", F.explode(values).alias("metric", "value"))
    return rows.groupBy("lang", "source", "metric", bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, size and for each metric low_ and high_: the median less and plus REACH spreads, over the sketches merged by keys.

    The spread is the smaller distance of a quartile from the median, so that junk on one side does not widen it, or the metric's
    least spread. A quantile is the bucket at which the running count reaches its share.
    """
    by = ", ".join([*keys, "metric"])
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    running = merged.selectExpr("*", f"sum(n) over (partition by {by} order by bucket) as upto", f"sum(n) over (partition by {by}) as size")
    at = [F.min(F.when(F.col("upto") * 4 >= F.col("size") * k, F.col("bucket"))).alias(f"q{k}") for k in (1, 2, 3)]
    quartiles = running.groupBy(*keys, "metric").agg(F.max("size").alias("size"), *at)
    least = F.create_map(*[F.lit(x) for pair in METRICS for x in pair])
    reach = F.greatest(F.least(F.col("q2") - F.col("q1"), F.col("q3") - F.col("q2")), least[F.col("metric")]) * REACH
    limits = quartiles.select(*keys, "size", "metric", (F.col("q2") - reach).alias("low"), (F.col("q2") + reach).alias("high"))
    pick = [F.max(F.when(F.col("metric") == name, F.col(side))).alias(f"{side}_{name}") for name, _ in METRICS for side in ("low", "high")]
    return limits.groupBy(*keys).agg(F.max("size").alias("size"), *pick)


def thresholds(sketch: DataFrame, group_least: int = GROUP_LEAST) -> DataFrame:
    """lang, source, scope (source, language or all: whose sketch is used) and the limits low_ and high_ of each metric."""
    limits = [f"{side}_{name}" for name, _ in METRICS for side in ("low", "high")]
    own = fences(sketch, ["lang", "source"]).select("lang", "source", F.col("size"), F.struct(*limits).alias("own"))
    wide = fences(sketch, ["lang"]).select("lang", F.col("size").alias("lang_size"), F.struct(*limits).alias("wide"))
    every = fences(sketch, []).first()
    widest = F.struct(*[F.lit(every[c] if every else None).cast("long").alias(c) for c in limits])
    large, common = F.col("size") >= group_least, F.col("lang_size") >= group_least
    out = own.join(wide, "lang").select("lang", "source", F.when(large, "source").when(common, "language").otherwise("all").alias("scope"), F.when(large, F.col("own")).when(common, F.col("wide")).otherwise(widest).alias("limit"))
    return out.select("lang", "source", "scope", "limit.*")


def with_thresholds(rows: DataFrame, limits: DataFrame, sent_groups: int = SENT_GROUPS) -> DataFrame:
    """rows joined with the limits of their language and source. Few groups are sent to all executors; of more, each is copied
    SALTS times, so that a source with a third of all rows is dealt over as many tasks."""
    if limits.count() <= sent_groups:
        return rows.join(F.broadcast(limits), ["lang", "source"], "left")
    salted = limits.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    salt = F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(SALTS)).cast("int")
    return rows.withColumn("salt", salt).join(salted, ["lang", "source", "salt"], "left").drop("salt")


def apply_rules(docs: DataFrame, group_least: int = GROUP_LEAST, sent_groups: int = SENT_GROUPS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, scope and failed (names of the
    metrics outside their limits) of every row, from its whole text.

    A null text counts as empty and fails the base rules, as every text under WORDS_LEAST words does; null and repeated doc_ids
    keep their rows; a null language or source counts as the empty one. Equal values share a bucket, so ties never split. A value
    at a limit passes. An empty table gives no rows; further columns are ignored.
    """
    seen = stash(measured(docs))
    limits = stash(thresholds(sketches(seen), group_least))
    rows = with_thresholds(seen, limits, sent_groups).select("*", *metrics())
    outside = [F.when((F.col(name) < F.col(f"low_{name}")) | (F.col(name) > F.col(f"high_{name}")), F.lit(name)) for name, _ in METRICS]
    failed = F.array_compact(F.array(*outside))
    base = (F.col("n_words") < WORDS_LEAST) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.select("doc_id", *[c for c in COUNTS if c != "n_lines"], base.alias("base_failed"), (~base & (F.size(failed) == 0)).alias("kept"), "scope", F.array_join(failed, ",").alias("failed"))


#: DuckDB SQL for apply_rules: the same counts and the same bucket arithmetic.
ORACLE_SQL = r"""
with d as materialized (select row_number() over () as r, doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
w as materialized (select r, unnest(ws) as w, generate_subscripts(ws, 1) as i from (select r, list_filter(string_split_regex(text, '[ \x09-\x0D]+'), lambda x: x <> '') as ws from d)),
g as (select r, i, w || ' ' || lead(w, 1) over p || ' ' || lead(w, 2) over p || ' ' || lead(w, 3) over p || ' ' || lead(w, 4) over p as g from w window p as (partition by r order by i)),
twice as (select r, i from (select r, i, count(*) over (partition by r, g) as n from g where g is not null) where n > 1),
hit as (select r, count(distinct j) as n_repeat_words from (select r, unnest(range(i, i + 5)) as j from twice) group by r),
wc as (select r, count(*) as n_words, sum(length(w)) as word_chars from w group by r),
l as (select r, count(*) as n_lines, count(*) - count(distinct x) as n_dup_lines from (select r, unnest(string_split(text, chr(10))) as x from d) where regexp_matches(x, '[^ \x09-\x0D]') group by r),
m as materialized (select d.r, doc_id, lang, source, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0)::bigint as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
  coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words from d left join wc using (r) left join l using (r) left join hit using (r)),
v as materialized (select *, 1000 * word_chars // greatest(n_words, 1) as word_length, 1000 * n_symbols // greatest(n_words, 1) as symbols, 1000 * n_dup_lines // greatest(n_lines, 1) as line_copies from m),
u as (select lang, source, metric, value, greatest(length(bin(value)) - 8, 0)::int as s from (unpivot (select lang, source, n_words, word_length, symbols, line_copies from v where n_words > 0) on word_length, symbols, line_copies into name metric value value)),
sk as materialized (select 'source' as scope, lang, source, metric, (value >> s) << s as b from u union all select 'language', lang, '', metric, (value >> s) << s from u union all select 'all', '', '', metric, (value >> s) << s from u),
cnt as (select scope, lang, source, metric, b, count(*) as n from sk group by all),
run as (select *, sum(n) over (partition by scope, lang, source, metric order by b) as upto, sum(n) over (partition by scope, lang, source, metric) as size from cnt),
q as (select scope, lang, source, metric, max(size) as size, min(b) filter (upto * 4 >= size) as q1, min(b) filter (upto * 4 >= size * 2) as q2, min(b) filter (upto * 4 >= size * 3) as q3 from run group by all),
f as materialized (select scope, lang, source, metric, size, q2 - e as low, q2 + e as high from (select *, 20 * greatest(least(q2 - q1, q3 - q2), case metric when 'word_length' then 90 when 'symbols' then 6 else 20 end) as e from q)),
t as materialized (select o.lang, o.source, o.metric, case when o.size >= 100 then 'source' when w.size >= 100 then 'language' else 'all' end as scope,
  case when o.size >= 100 then o.low when w.size >= 100 then w.low else a.low end as low, case when o.size >= 100 then o.high when w.size >= 100 then w.high else a.high end as high
  from f o join f w on w.scope = 'language' and w.lang = o.lang and w.metric = o.metric join f a on a.scope = 'all' and a.metric = o.metric where o.scope = 'source'),
x as (select v.*, a.scope, concat_ws(',', case when word_length < a.low or word_length > a.high then 'word_length' end, case when symbols < b.low or symbols > b.high then 'symbols' end, case when line_copies < c.low or line_copies > c.high then 'line_copies' end) as failed
  from v left join t a on a.lang = v.lang and a.source = v.source and a.metric = 'word_length' left join t b on b.lang = v.lang and b.source = v.source and b.metric = 'symbols' left join t c on c.lang = v.lang and c.source = v.source and c.metric = 'line_copies')
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and failed = '' as kept, scope, failed from x
"""
