"""URL verdicts from host rules and from trust and distrust that spread over the graph of host links."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import STASHES, cut, forget, lower_ascii, stash

#: (verdict, host, path): a rule fits its host and all subdomains if the url's path starts with its path; the longest wins.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
RESTART = 0.15
#: Rounds end when STRIDE of them change the ranks by less than this share of all mass; the restart bounds their number.
TOLERANCE = 1e-6
#: Rounds between two checkpoints, and two looks at the change.
STRIDE = 6
ROUNDS = math.ceil(math.log(TOLERANCE) / math.log(1 - RESTART))
#: A host is blocked where its distrust exceeds its trust by this share of the blocked seeds' own mean distrust. Ranks are relative
#: to the mean over hosts, and a seed's rank shrinks as seeds multiply; their own mean shrinks with it.
SEED_SHARE = 0.5
#: Host edges that one task may hold: a graph up to this size is not dealt out.
TASK_EDGES = 100_000
SALTS = 16
#: Names under which two-letter domains register, as in co.uk. Hosts below such a pair are no relatives.
REGISTRIES = ("ac", "co", "com", "edu", "gob", "gov", "go", "mil", "ne", "net", "nom", "or", "org", "sch")
SUFFIX = rf"^({'|'.join(REGISTRIES)})\.[a-z]{{2}}$"


def with_host_path(pages: DataFrame) -> DataFrame:
    """pages with host and path; a null url, or one without ://, has both empty."""
    at = F.locate("://", F.col("url"))
    rest = F.when(at > 0, F.col("url").substr(at + 3, F.length("url"))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return pages.withColumn("host", lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def _best(rules: Sequence[tuple[str, str, str]], value) -> Column:
    """value(rule) of the longest rule that fits host and path, else null."""
    out: Column = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1] + r[2])):
        host, path = rule[1], rule[2]
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def with_rule(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages (host, path) with rule and ruled, its verdict: of the rules that fit the longest, null where none does. Null hosts and
    paths fit none; repeated rows and an empty table pass through."""
    return pages.withColumn("rule", _best(rules, lambda r: r[1] + r[2])).withColumn("ruled", _best(rules, lambda r: r[0]))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight: absolute links in the html between different hosts, plus a link each way between a host and its parent
    domain, that and its parent, and so on down to two labels, but never to a public suffix such as co.uk. Counts are pre-aggregated, so a hot host costs its number of distinct neighbours. Repeated
    rows add to a link's weight; null html has no links; an empty table gives none."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?i)(?:href|src)\s*=\s*[\"']?https?://([^/?#\"'\s>]+)"), F.lit(1))
    found = pages.where(F.col("host") != "").select(F.col("host").alias("src"), F.explode(links).alias("dst")).withColumn("dst", lower_ascii(F.col("dst")))
    found = found.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    labels = pages.where(F.col("host") != "").select("host").distinct().select(F.split("host", r"\.").alias("labels"))
    chain = labels.select(F.explode(F.expr("transform(sequence(1, size(labels)), k -> array_join(slice(labels, k, size(labels) - k + 1), '.'))")).alias("host")).distinct()
    parent = chain.select("host", F.expr("substring(host, locate('.', host) + 1)").alias("parent")).where(F.col("parent").contains(".") & (F.col("parent") != F.col("host")) & ~F.col("parent").rlike(SUFFIX))
    up = parent.select(F.col("host").alias("src"), F.col("parent").alias("dst"), F.lit(1.0).alias("weight"))
    down = parent.select(F.col("parent").alias("src"), F.col("host").alias("dst"), F.lit(1.0).alias("weight"))
    both = reduce(DataFrame.unionByName, [found, up, down]).where("src != dst")
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, restart: float = RESTART, rounds: int = ROUNDS, tolerance: float = TOLERANCE, task_edges: int = TASK_EDGES) -> DataFrame:
    """host, trust, distrust from seeds (host, trusted, blocked: shares of its pages) by personalised PageRank.

    Rounds end when STRIDE of them change the ranks of each kind by at most `tolerance` of its mass (0.85^6 / (1 - 0.85^6), or 0.6
    times that, is then in transit at the default restart), or after `rounds`, rounded up to whole strides, when no more than that
    can be. Trust starts at trusted seeds and follows links; distrust starts at blocked seeds and follows links backwards, to those who
    link there. Both are relative to the mean over hosts. What reaches a host without further links stays there unspread.

    A round is one join and one pre-aggregated sum over host edges. A graph of up to `task_edges` edges is one partition, broadcast
    to the one task of its rounds, so that they shuffle nothing; a larger one is dealt by host once, and a round shuffles the sums alone. Every STRIDE rounds the
    ranks are written to the shared folder, and those before are deleted.
    """
    spark = edges.sparkSession
    ahead = edges.join(edges.groupBy("src").agg(F.sum("weight").alias("all")), "src").select(F.lit(0).alias("way"), F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("weight") / F.col("all")).alias("p"))
    back = edges.join(edges.groupBy("dst").agg(F.sum("weight").alias("all")), "dst").select(F.lit(1).alias("way"), F.col("dst").alias("host"), F.col("src").alias("to"), (F.col("weight") / F.col("all")).alias("p"))
    written = stash(ahead.unionByName(back))
    small = written.count() <= 2 * task_edges
    laid = (lambda df: df.coalesce(1)) if small else (lambda df: df)
    step = F.broadcast(laid(written)) if small else cut(written.repartition("host", "way")).hint("merge")
    totals = seeds.agg(F.sum("trusted"), F.sum("blocked"), F.count("*")).first()
    t, b, n = totals[0] or 1.0, totals[1] or 1.0, totals[2] or 1
    start = stash(laid(seeds.selectExpr(f"stack(2, 0, trusted * {n} / {t!r}, 1, blocked * {n} / {b!r}) as (way, r)", "host").select("host", "way", F.col("r").cast("double").alias("r"), F.lit(0.0).alias("was")).where("r > 0")))
    base = laid(start).select("host", "way", (F.col("r") * restart).alias("r"))
    rank, path = start, None
    for _ in range(0, rounds, STRIDE):
        # the ranks of STRIDE rounds ago come along, to tell the change
        rank = laid(rank)
        old = rank.select("host", "way", F.lit(0.0).alias("r"), F.col("r").alias("was"))
        for left in reversed(range(STRIDE)):
            moved = rank.join(step, ["host", "way"]).select(F.col("to").alias("host"), "way", (F.col("r") * F.col("p") * (1 - restart)).alias("r"))
            both = base.unionByName(moved).withColumn("was", F.lit(0.0))
            both = both if left else both.unionByName(old)
            # the union of three single partitions has three again
            rank = laid(both).groupBy("host", "way").agg(F.sum("r").alias("r"), F.sum("was").alias("was"))
        rank = stash(rank)
        forget(spark, [path] if path else [])
        path = STASHES[-1]
        changes = rank.groupBy("way").agg(F.sum(F.abs(F.col("r") - F.col("was")))).collect()
        if all(change <= tolerance * n for _, change in changes):
            break
    return rank.groupBy("host").agg(F.sum(F.when(F.col("way") == 0, F.col("r")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("way") == 1, F.col("r")).otherwise(0.0)).alias("distrust"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, seed_share: float = SEED_SHARE) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust and threshold of every page: the rule's verdict, else block where the
    host's distrust exceeds its trust by more than the threshold, else allow.

    The threshold is `seed_share` of the mean distrust of blocked seeds (hosts weighted by their share of blocked pages); without
    blocked seeds nothing is blocked by the method, and the threshold is null.

    A null or malformed url has empty host and path, fits no rule and is allowed. Repeated rows each keep their row; an empty
    table gives none. Further columns are ignored.
    """
    known = with_rule(with_host_path(pages.select("page_id", "url", "html")), rules)
    share = lambda v: F.avg(F.when(F.col("ruled") == v, 1.0).otherwise(0.0))
    seeds = known.where("host != ''").groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked"))
    seeds = stash(seeds)
    ranks = stash(propagate(seeds, host_edges(known)))
    level = seeds.where("blocked > 0").join(ranks, "host").agg(F.sum(F.col("blocked") * F.col("distrust")) / F.sum("blocked")).first()[0]
    threshold = F.lit(None if level is None else level * seed_share).cast("double")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    spread = F.when(distrust - trust > threshold, F.lit("block")).otherwise(F.lit("allow"))
    # a hot host's pages are dealt over SALTS copies of its ranks
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    copies = ranks.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    out = known.drop("html").withColumn("salt", salt).join(copies, ["host", "salt"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", spread).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"), threshold.alias("threshold"))
