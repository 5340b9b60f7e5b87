"""Plan records in nested JSON: parsing, checks and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import flag, strip, text_of, title_case

MONEY = "map<string,double>"
PLAN = f"struct<plan_name:string,network:string,premiums:{MONEY},deductibles:{MONEY},coinsurance:string,copays:{MONEY},rx_tiers:map<string,string>>"


def parse_plans(raw: DataFrame, column: str = "response") -> DataFrame:
    """raw with plans (array), error and n_plans: the JSON of a reply, fenced or not. A broken reply has no plans and an error."""
    t = text_of(column)
    bare = strip(F.regexp_replace(t, r"```(?:json)?", ""))
    df = raw.withColumn("_json", bare).withColumn("_ok", flag(F.expr("try_parse_json(_json) is not null and _json like '{%'")))
    plans = F.coalesce(F.from_json("_json", f"plans array<{PLAN}>")["plans"], F.array().cast(f"array<{PLAN}>"))
    df = df.withColumn("plans", F.when(F.col("_ok"), plans).otherwise(F.array().cast(f"array<{PLAN}>"))).withColumn("error", F.when(~F.col("_ok"), "unreadable reply"))
    return df.withColumn("n_plans", F.size("plans").cast("long")).withColumn("n_unclear", F.regexp_count(t, F.lit(r"\[UNCLEAR\]|\[EXTRACTION FAILED")).cast("long")).drop("_json", "_ok")


def plan_rows(parsed: DataFrame) -> DataFrame:
    """One row for each plan with its place i; replies without plans give none."""
    return parsed.select("doc_id", F.posexplode("plans").alias("i", "plan")).select("doc_id", "i", "plan.*")


def duplicate_premiums(parsed: DataFrame) -> DataFrame:
    """doc_id, plan_name, warning for a plan whose sorted premiums equal an earlier plan's."""
    rows = plan_rows(parsed).withColumn("v", F.array_sort(F.filter(F.map_values("premiums"), lambda x: x.isNotNull()))).where("size(v) > 0")
    n, named = F.row_number().over(Window.partitionBy("doc_id", "v").orderBy("i")), F.coalesce("plan_name", F.lit("Unknown"))
    return rows.withColumn("n", n).where("n > 1").select("doc_id", "plan_name", F.concat(F.lit("DUPLICATE PREMIUMS: "), named, F.lit(" has same premiums as another plan")).alias("warning"))


def missing_sections(parsed: DataFrame) -> DataFrame:
    """doc_id, plan_name, section, warning for each null or empty one of premiums, deductibles and copays; a reply without plans
    gives one row with a warning alone."""
    rows = plan_rows(parsed)
    gone = F.array_compact(F.array(*[F.when(F.col(s).isNull() | (F.size(s) == 0), F.lit(s)) for s in ("premiums", "deductibles", "copays")]))
    found = rows.select("doc_id", "plan_name", _title(), F.explode(gone).alias("section"))
    found = found.select("doc_id", "plan_name", "section", F.concat("title", F.lit(": Missing "), F.expr("substring(section, 1, length(section) - 1)"), F.lit(" data")).alias("warning"))
    nothing = F.lit(None).cast("string")
    none = parsed.where("n_plans = 0").select("doc_id", nothing.alias("plan_name"), nothing.alias("section"), F.lit("No plans found in extracted data").alias("warning"))
    return found.unionByName(none)


def _title() -> Column:
    return F.coalesce("plan_name", F.concat(F.lit("Plan "), (F.col("i") + 1).cast("string"))).alias("title")


def null_leaves(parsed: DataFrame) -> DataFrame:
    """doc_id, plan_name, path, warning of every field of the known plan schema that is null or missing. For any other fields, at any
    depth, see `null_paths`."""
    rows = plan_rows(parsed)
    plain = [F.struct(F.lit(c).alias("path"), F.col(c).isNull().alias("gone")) for c in ("network", "coinsurance")]
    inside = [F.coalesce(_entries(c), F.array().cast("array<struct<path:string,gone:boolean>>")) for c in ("premiums", "deductibles", "copays", "rx_tiers")]
    every = F.concat(F.array(*plain), *inside)
    found = rows.select("doc_id", "plan_name", _title(), F.explode(F.filter(every, lambda x: x["gone"])).alias("x"))
    return found.select("doc_id", "plan_name", "x.path", F.concat("title", F.lit("."), "x.path", F.lit(": Value is null")).alias("warning"))


def null_paths(replies: DataFrame, column: str = "response") -> DataFrame:
    """doc_id, plan_name, path, warning of every null in a plan's objects, at any depth and under any key.

    Replies (doc_id) are JSON with a list `plans`, fenced or not; unreadable ones give no rows. Objects are opened level by level,
    keys joined by dots; lists are not entered and missing keys are no nulls. A plan without a name is `Plan n`. A round is one
    explode without a shuffle; rounds end with the deepest object.
    """
    bare = strip(F.regexp_replace(text_of(column), r"```(?:json)?", ""))
    plans = replies.select("doc_id", F.try_parse_json(bare).alias("reply")).select("doc_id", F.posexplode(F.expr("try_variant_get(reply, '$.plans', 'array<variant>')")).alias("i", "object"))
    named = F.coalesce(F.expr("try_variant_get(object, '$.plan_name', 'string')"), F.concat(F.lit("Plan "), (F.col("i") + 1).cast("string")))
    level = plans.select("doc_id", named.alias("plan_name"), F.lit("").alias("above"), "object")
    found = None
    while True:
        opened = level.where("schema_of_variant(object) like 'OBJECT%'").lateralJoin(replies.sparkSession.tvf.variant_explode(F.col("object").outer()))
        entries = opened.select("doc_id", "plan_name", F.concat("above", "key").alias("path"), "value")
        nulls = entries.where("is_variant_null(value)").select("doc_id", "plan_name", "path", F.concat("plan_name", F.lit("."), "path", F.lit(": Value is null")).alias("warning"))
        found = nulls if found is None else found.unionByName(nulls)
        level = entries.select("doc_id", "plan_name", F.concat("path", F.lit(".")).alias("above"), F.col("value").alias("object"))
        if level.where("schema_of_variant(object) like 'OBJECT%'").isEmpty():
            return found


def _entries(column: str) -> Column:
    return F.transform(F.map_entries(column), lambda e: F.struct(F.concat(F.lit(f"{column}."), e["key"]).alias("path"), e["value"].isNull().alias("gone")))


def plan_markdown(parsed: DataFrame) -> DataFrame:
    """doc_id, i, markdown of each plan, sections in fixed order, keys in title case (copays in upper case)."""
    def section(name: str, column: str, cased) -> Column:
        entries = F.filter(F.map_entries(column), lambda e: e["value"].isNotNull())
        told = F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(F.lit("- "), cased(F.replace(e["key"], F.lit("_"), F.lit(" "))), F.lit(": $"), F.format_number(e["value"], 2))), "\n")
        return F.when(F.size(entries) > 0, F.concat(F.lit(f"### {name}\n"), told))

    head = F.concat(F.lit("## "), F.coalesce("plan_name", F.lit("Unnamed plan")))
    network = F.when(F.col("network").isNotNull(), F.concat(F.lit("Network: "), "network"))
    return plan_rows(parsed).select("doc_id", F.col("i").cast("long").alias("i"), F.concat_ws("\n", head, network, section("Premiums", "premiums", title_case), section("Deductibles", "deductibles", title_case), section("Copays", "copays", F.upper)).alias("markdown"))
