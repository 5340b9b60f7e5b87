"""Accounting of runs: costs, stages, retries, events and jobs; and the result cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import joined, ladder, text_of

CALL_TOKENS, FORMAT_TOKENS, PRICE = 1500, 2000, 3
TTL_SECONDS = 86_400
COMPONENTS = (("extraction_seconds", "Extraction"), ("report_seconds", "Quality report"), ("summary_seconds", "Summary"))


def token_cost(df: DataFrame) -> DataFrame:
    """df (calls, tokens) with vision, formatting and total tokens and cost in dollars at 3 a million. Unknown totals are
    estimated from the calls."""
    calls, total = F.coalesce("calls", F.lit(0)), F.coalesce("tokens", F.lit(0))
    vision = calls * CALL_TOKENS
    guess = (total == 0) & (calls > 0)
    formatting = F.when(guess, FORMAT_TOKENS).otherwise(F.greatest(F.lit(0), total - vision))
    df = df.withColumn("vision_tokens", vision.cast("long")).withColumn("formatting_tokens", formatting.cast("long"))
    df = df.withColumn("total_tokens", F.when(guess, vision + FORMAT_TOKENS).otherwise(total).cast("long"))
    return df.withColumn("cost", (F.col("vision_tokens") + F.col("formatting_tokens")) * PRICE / 1_000_000)


def run_analytics(runs: DataFrame) -> DataFrame:
    """One row a run (run_id) of stages: tokens and seconds a stage, the largest stage's token share in percent, and every stage's
    share and seconds as `name: share% seconds s` by name."""
    total = F.sum("tokens").over(Window.partitionBy("run_id"))
    each = runs.withColumn("part", F.concat("stage", F.lit(": "), F.format_number(F.when(total > 0, F.col("tokens") * 100 / total).otherwise(F.lit(0.0)), 1), F.lit("% "), F.col("seconds").cast("string"), F.lit(" s")))
    d = each.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list("part")), ", ").alias("parts"), F.count("*").alias("stages"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("most"), F.sum("seconds").alias("seconds"), F.sum(F.col("success").cast("long")).alias("ok"))
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return d.withColumn("tokens_per_stage", per("tokens", "stages")).withColumn("seconds_per_stage", per("seconds", "stages")).withColumn("top_share", F.when(F.col("tokens") > 0, F.col("most") * 100 / F.col("tokens")).otherwise(F.lit(0.0))).drop("most")


def result_analytics(results: DataFrame) -> DataFrame:
    """results (pages, calls, words, seconds, vision_tokens, formatting_tokens, and seconds of each component) with calls and
    seconds a page, token shares in percent and the components' times as one text. Nulls count as 0, no pages as one."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    pages, tokens = F.greatest(n("pages"), F.lit(1)), n("vision_tokens") + n("formatting_tokens")
    share = lambda c: F.when(tokens > 0, n(c) * 100 / tokens).otherwise(F.lit(0.0))
    df = results.withColumn("calls_per_page", F.when(n("pages") > 0, F.round(n("calls") / pages, 1)).otherwise(F.lit(0.0))).withColumn("seconds_per_page", n("seconds") / pages)
    df = df.withColumn("vision_share", share("vision_tokens")).withColumn("formatting_share", share("formatting_tokens"))
    parts = [(c, title) for c, title in COMPONENTS if c in results.columns]
    told = F.array_join(F.array(*[F.concat(F.lit(f"{title}: "), F.format_number(n(c), 2), F.lit("s")) for c, title in parts]), ", ")
    some = sum((F.when(n(c) > 0, 1).otherwise(0) for c, _ in parts), F.lit(0)) > 0
    return df.withColumn("timings", F.when(some, told).otherwise(""))


def stage_rollup(runs: DataFrame) -> DataFrame:
    """Per stage and in all (stage null): runs, successes, success rate, mean confidence, tokens and seconds."""
    d = runs.rollup("stage").agg(F.count("*").alias("n"), F.sum(F.col("success").cast("long")).alias("ok"), F.sum("tokens").alias("tokens"), F.sum("seconds").alias("seconds"))
    return d.withColumn("rate", F.col("ok") * 100 / F.col("n"))


def stage_chain(runs: DataFrame) -> DataFrame:
    """Stages of each run up to and with its first failure."""
    failed = F.min(F.when(~F.col("success"), F.col("stage_no"))).over(Window.partitionBy("run_id"))
    return runs.withColumn("_failed", failed).where("_failed is null or stage_no <= _failed").drop("_failed")


def retry_outcome(attempts: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """One row a key: the first successful attempt of at most `most`, else the last error."""
    d = attempts.where(F.col("attempt") <= most).groupBy(*keys).agg(F.min(F.when(F.col("success"), F.col("attempt"))).alias("attempt"), F.min_by("content", F.when(F.col("success"), F.col("attempt"))).alias("content"), F.max_by("error", "attempt").alias("_error"))
    return d.withColumn("success", F.col("attempt").isNotNull()).withColumn("error", F.when(~F.col("success"), F.concat(F.lit("Max retries: "), text_of("_error")))).drop("_error")


def last_events(events: DataFrame, key: str, order: list[str], most: int = 50) -> DataFrame:
    """The newest events of each key with their age (from 1), ties by the further orders; null keys are a key of their own."""
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("age", F.row_number().over(newest).cast("long")).where(F.col("age") <= most)


def agent_confidence(events: DataFrame) -> DataFrame:
    """Entries and mean confidence of each agent, from hundredths; null hundredths count as 0, no events give no rows."""
    return events.groupBy("agent_id").agg(F.count("*").alias("entries"), (F.sum("hundredths") / F.count("*") / 100).alias("confidence"))


def error_class(message: Column) -> Column:
    """timeout, rate_limit or other, by words of the message; null is other."""
    low = F.lower(message)
    return ladder((low.contains("timeout"), "timeout"), (low.contains("rate"), "rate_limit"), otherwise="other")


def truncated(finish_reason: Column) -> Column:
    """Whether a reply ended for its length; null is not."""
    return F.coalesce(finish_reason.isin("length", "max_tokens"), F.lit(False))


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """The newest state of each job."""
    return jobs.withColumn("_n", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("updated_at"), F.desc("event_id")))).where("_n = 1").drop("_n")


def raw_capture(pages: DataFrame) -> DataFrame:
    """doc_id and capture: each page under its heading, with a rule of 100 signs between pages."""
    piece = F.concat(F.lit("Page "), F.col("page_no").cast("string"), F.lit(" - standard extraction:\n"), text_of())
    return pages.groupBy("doc_id").agg(joined(F.struct(F.col("page_no").alias("pos"), piece.alias("value")), "\n" + "=" * 100 + "\n").alias("capture"))


def cache_key(content: Column, strategy: Column, page: Column) -> Column:
    return F.concat_ws("_", F.substring(F.sha2(content, 256), 1, 16), strategy, page.cast("string"))


def cache_lookup(pages: DataFrame, cache: DataFrame, now: str, ttl: int = TTL_SECONDS) -> DataFrame:
    """pages (key) with payload and hit: an entry younger than the time to live. `now` is given, never read from a clock."""
    age = F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp("written_at")
    # of a key's fresh entries the newest serves; ties by payload
    fresh = cache.where(age < ttl).groupBy("key").agg(F.max(F.struct("written_at", "payload"))["payload"].alias("payload"))
    return pages.join(fresh, "key", "left").withColumn("hit", F.col("payload").isNotNull())


def cache_upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with new entries; of each key the newest is kept, a new one before an old one of the same time."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("written_at"), F.desc("_new"), F.desc("payload")))).where("_n = 1").drop("_n", "_new")
