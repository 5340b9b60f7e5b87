"""Rows worked out by hand, one for each branch that the tables rarely reach, and properties."""

import pytest
from pyspark.sql import functions as F

from quillwork.operators import clean as C
from quillwork.operators import evaluate as E
from quillwork.operators import pages as P
from quillwork.operators import profile as FP
from quillwork.operators import quality as Q
from quillwork.operators import routing as R
from quillwork.operators import runs as A
from quillwork.operators import sheets as X
from quillwork.operators import summary as M


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def column(df, name):
    return [r[name] for r in df.orderBy("doc_id").collect()]


SIMPLE = "A Title\nSome prose line that is long enough.\nAnother prose line that is long enough.\n\nKey points:\n- Item 1\n- Item 2\n- Item 3\n\nEnd of document."
TABLE = "Financial Summary\n\nQuarter    Revenue    Expenses    Profit\nQ1 2024    $50,000    $30,000    $20,000\nQ2 2024    $60,000    $35,000    $25,000"


def test_table_score(spark):
    df = Q.corruption_score(texts(spark, TABLE, SIMPLE, "", None))
    assert column(df, "table_score") == [1.0, 0.5, 0.0, 0.0]
    assert column(df, "sparsity_score")[2:] == [0.4, 0.4]


def test_analysis_of_blank_pages(spark):
    got = R.analyse_pages(texts(spark, "", None, " \n ")).collect()
    assert [(r.text_quality, r.quality_score, r.indicators) for r in got] == [("missing", 0.0, ["no_text_extracted"])] * 3


def _pages(spark, n, doc=0):
    return spark.createDataFrame([(doc, i, "t") for i in range(1, n + 1)], "doc_id long, page_no long, text string")


@pytest.mark.parametrize(("total", "mode", "count", "error"), [(20, "strict", 12, None), (18, "strict", 0, "Invalid range 15-20. Pages must be between 1 and 18"), (18, "clip", 10, None)])
def test_page_ranges(spark, total, mode, count, error):
    specs = spark.createDataFrame([(0, "1-5, 10, 15-20")], "doc_id long, spec string")
    rows = P.page_selection(_pages(spark, total), specs, mode).collect()
    assert sum(r.page_no is not None for r in rows) == count
    assert [r.spec_error for r in rows if r.spec_error] == ([error] if error else [])


def test_quota_runs_out_in_page_order(spark):
    rows = R.with_quota(_pages(spark, 120)).orderBy("page_no").collect()
    assert [r.over_quota for r in rows] == [False] * 100 + [True] * 20


def test_page_heuristic(spark):
    rows = spark.createDataFrame([(40, 0, 0, 0), (40, 1, 0, 0), (600, 0, 0, 0)], "text_len long, images long, drawings long, blocks long")
    assert [(r.recommendation, r.confidence) for r in R.page_heuristic(rows).collect()] == [("NO", 0.95), ("YES", 0.9), ("NO", 0.85)]


def test_chunks(spark):
    got = FP.chunk_plan(_pages(spark, 7)).orderBy("chunk_no").collect()
    assert [(r.first_page, r.last_page) for r in got] == [(1, 3), (4, 6), (7, 7)]
    assert FP.chunk_plan(_pages(spark, 5)).count() == 1


def test_commentary(spark):
    df = C.clean_commentary(texts(spark, "I apologize for the confusion. Here is the extracted text.", "Extracted text here. If you have any questions, feel free to ask.", "Plain text.", "a\n\n\n\nb", None))
    assert column(df, "cleaned") == ["", "Extracted text here.", "Plain text.", "a\n\nb", ""]
    assert [len(x) for x in column(df, "removed")] == [2, 2, 0, 0, 0]


def test_flattened_table(spark):
    text = "| Plan | PCP | ER |\n|---|---|---|\n| Gold | $10 | $50 |\n| Silver | $20 |  |"
    assert column(C.flatten_tables(texts(spark, text, "a | b")), "text") == ["**PCP** - **Gold**: $10\n**ER** - **Gold**: $50\n**PCP** - **Silver**: $20", "a | b"]


def test_cells_keep_their_columns(spark):
    table = "| Plan | | Fee |\n|---|---|---|\n| Gold | yes | 5 |\n| | no | 6 |\n| | | 7 |\n| | x | |"
    df = texts(spark, table, None, "a | b")
    assert column(C.flatten_tables(df, "position"), "text") == ["**Gold**: yes\n**Fee** - **Gold**: 5\nno\n**Fee**: 6\n**Fee**: 7\nx", "", "a | b"]
    assert column(C.flatten_tables(df), "text")[0] == "**Fee** - **Gold**: yes\n**Fee** - **no**: 6\n**Fee**: 7"
    with pytest.raises(ValueError, match="alignment"):
        C.flatten_tables(df, "left")


def test_footnotes(spark):
    df = texts(spark, "Coverage starts in May[1].\n1 Subject to eligibility, see plan. More.", "no notes here")
    assert column(C.footnotes_inline(df), "noted") == ["Coverage starts in May (Subject to eligibility, see plan. More.).", "no notes here"]
    assert column(C.footnotes_inline(df, style="minimal"), "noted")[0] == "Coverage starts in May (Subject to eligibility)."
    assert column(C.footnotes_inline(df, style="preserve"), "noted")[0].startswith("Coverage starts in May[1].")


def test_ratings(spark):
    raw = spark.createDataFrame([(0, "overall_score: 77.5 so REJECT"), (1, None), (2, '```json\n{"overall_score": 91}\n```')], "doc_id long, response string")
    assert [(r.score, r.recommendation) for r in E.parse_ratings(raw).orderBy("doc_id").collect()] == [(77.5, "REJECT"), (0.0, "REVIEW"), (91.0, "REVIEW")]


def test_overlap_and_final(spark):
    rows = spark.createDataFrame([(["a", "b"], ["B ", "c"]), ([], []), (["a"], [])], "a array<string>, b array<string>")
    assert [round(r[0], 2) for r in rows.select(E.item_overlap(F.col("a"), F.col("b"))).collect()] == [33.33, 100.0, 0.0]
    scores = spark.createDataFrame([(89.0,), (90.0,), (69.9,)], "s double")
    assert [r[0] for r in scores.select(E.recommendation_of(F.col("s"))).collect()] == ["REVIEW", "ACCEPT", "REJECT"]


def test_value_formats(spark):
    rows = [("1234.5", "numeric"), ("$1234.5", "text"), ("5%", "text"), ("0.05", "percentage"), ("(5)", "numeric"), ("1200", "numeric"), (None, "text"), ("-0.5", "numeric")]
    df = spark.createDataFrame(rows, "v string, k string").select(X.format_value(F.col("v"), F.col("k")))
    assert [r[0] for r in df.collect()] == ["1,234.5", "$1,234.50", "5.00%", "5.00%", "(5)", "1,200", "", "-0.5"]


def test_a_negative_zero_is_shown_as_zero(spark):
    df = spark.createDataFrame([("-0", "numeric"), ("-0.0", "text"), ("0", "numeric"), ("-0", "currency")], "v string, k string")
    assert [r[0] for r in df.select(X.format_value(F.col("v"), F.col("k"))).collect()] == ["0", "0", "0", "$-0.00"]


def test_group_key_and_title(spark):
    df = spark.createDataFrame([("- Employee Only - VSP - Premium - Monthly = $5.00",), ("other",)], "line string")
    got = df.select(X.group_key(F.col("line")).alias("k")).select("k", X.section_title(F.col("k"))).collect()
    assert [tuple(r) for r in got] == [("Employee Only - VSP - Premium", "VSP - Premium"), ("misc", "Data Section")]


def test_column_name(spark):
    df = spark.createDataFrame([("Unnamed_PPO total",)], "n string").select(X.clean_column_name(F.col("n")))
    assert df.first()[0] == "Value PPO Total"


def test_token_cost(spark):
    rows = A.token_cost(spark.createDataFrame([(4, 10000), (2, 0), (None, None)], "calls int, tokens int")).collect()
    assert [(r.vision_tokens, r.formatting_tokens, r.total_tokens, r.cost) for r in rows] == [(6000, 4000, 10000, 0.03), (3000, 2000, 5000, 0.015), (0, 0, 0, 0.0)]


def test_greedy_fill(spark):
    parts = ["benefit coverage eligible " + "x" * 32, "benefit coverage " + "y" * 31, "benefit " + "z" * 20, "plain " + "w" * 2]
    got = M.smart_truncate(texts(spark, "\n\n".join(parts)), 100).first().text
    assert got.startswith(f"{parts[0]}\n\n{parts[2]}\n\n{parts[3]}") and parts[1] not in got


def test_cache_keys_differ(spark):
    df = spark.range(1).select(*[A.cache_key(F.lit("t"), F.lit(s), F.lit(p)).alias(f"{s}{p}") for s in ("a", "b") for p in (1, 2)])
    assert len(set(df.first())) == 4


def test_one_failed_page_is_isolated(spark):
    attempts = spark.createDataFrame([(0, 1, 1, True, "one"), (0, 2, 1, False, None), (0, 3, 1, True, "three")], "doc_id long, page_no long, attempt int, success boolean, content string")
    rows = R.isolate_errors(_pages(spark, 4), attempts).orderBy("page_no").collect()
    assert [r.success for r in rows] == [True, False, True, False]
    assert rows[1].content == "## Page 2\n\n[Error: extraction failed]" and rows[3].content == "## Page 4\n\n[No text extracted]"


def test_partitioning_does_not_matter(spark):
    df = texts(spark, *["| a | b |\n|---|---|\n| c | d |\ntext"] * 5)
    assert sorted(map(str, C.flatten_tables(df.repartition(4)).collect())) == sorted(map(str, C.flatten_tables(df.coalesce(1)).collect()))


def test_a_result_serves_a_day_and_then_is_made_anew(spark):
    from quillwork.streaming import jobs as J
    from quillwork.sources.files import shared_folder

    hours = [[0, 1, 23.9], [24, 30, 47.9, 47.95], [48.1, 200], [210, 224.5]]
    intake, folder = shared_folder(spark), shared_folder(spark)
    for batch in hours:
        rows = spark.createDataFrame([(k, float(h)) for h in batch for k in (1, None)], "k long, h double")
        events = rows.select("k", F.timestamp_micros((F.col("h") * 3_600_000_000 + 3_600_000_000_000).cast("long")).alias("ts"))
        events.write.mode("append").parquet(intake)
        out = J.run(J.reuse(spark.readStream.schema(events.schema).parquet(intake), ["k"]), folder)
    got = sorted((r.k or 0, r.h) for r in out.select("k", F.round(F.unix_micros("ts") / 3_600_000_000 - 1000, 3).alias("h")).collect())
    assert got == [(k, float(h)) for k in (0, 1) for h in (0, 24, 48.1, 200, 224.5)]


def test_keys_share_states_and_keep_their_own_instants(spark):
    from quillwork.sources.files import shared_folder
    from quillwork.streaming import jobs as J

    intake, folder, hour = shared_folder(spark), shared_folder(spark), 3_600_000_000
    want = []
    for at in (0, 12, 30):
        events = spark.range(3000).selectExpr("nullif(id, 7) + 9007199254740993 as k", "if(id % 2 = 0, 'e', null) as kind", f"timestamp_micros((1000 + {at}) * {hour}L + id) as ts")
        events.write.mode("append").parquet(intake)
        job = J.reuse(spark.readStream.schema(events.schema).parquet(intake), ["k", "kind"])
        out = J.run(job, folder)
        want += [] if at == 12 else [tuple(r) for r in events.collect()]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    states = spark.read.format("statestore").load(f"{folder}/progress").count()
    assert 0 < states <= 1024


def test_repeated_rows_are_taken_each_by_itself(spark):
    rows = spark.createDataFrame([(1, "| a | b |\n|---|---|\n| c | d |"), (1, "a | b"), (None, None), (None, "x")], "doc_id long, text string")
    assert sorted(r.text for r in C.flatten_tables(rows).collect()) == ["", "**b** - **c**: d", "a | b", "x"]
    supplied = spark.createDataFrame([(1, "B", True), (1, "A", True)], "doc_id long, summary string, success boolean")
    assert [r.summary for r in M.resolve_summaries(rows.where("doc_id = 1"), supplied).collect()] == ["A", "A"]
    assert E.rate_documents(rows.withColumn("formatted", F.lit("x"))).count() == 4
    cache = spark.createDataFrame([("k", "old", "2024-06-01 01:00:00"), ("k", "new", "2024-06-01 02:00:00")], "key string, payload string, at string").withColumn("written_at", F.col("at").cast("timestamp")).drop("at")
    assert [r.payload for r in A.cache_lookup(spark.createDataFrame([("k",)], "key string"), cache, "2024-06-01 03:00:00").collect()] == ["new"]


def test_empty_tables(spark):
    none = texts(spark, "x").where("false")
    for f in (Q.corruption_score, C.clean_commentary, C.strip_placeholders, C.flatten_tables, C.footnotes_inline, R.analyse_pages, FP.content_profile, M.keyword_lines, M.paragraph_rank, P.reject_reason):
        assert f(none).count() == 0


def test_derived_sheets_are_bounded_and_texts_whole(spark):
    from pyspark.sql import functions as F

    from quillwork.sources import derived as D

    sf = "/root/testdata/sf0.001"
    rows = D.cells(spark, sf).groupBy("sheet").agg(F.countDistinct("row").alias("n")).collect()
    assert max(r.n for r in rows) <= D.SHEET_ROWS + 1 and sum(r.sheet.startswith("part_") for r in rows) > 1
    whole = D.read(spark, sf, "documents").withColumnRenamed("text", "own").join(D.docs_aug(spark, sf), "doc_id")
    assert whole.where(~F.col("text").startswith(F.coalesce("own", F.lit("")))).count() == 0


def test_reversed_words_are_those_of_a_check_word_by_word(spark):
    import random

    rng = random.Random(5)
    parts = ["gni", "noi", "eci", "de", "erp", "bus", "noc", "noit", "ynapmoc", "dradnats", "x", "ab", "Noit", ".", "é"]
    rows = [" ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(9))) for _ in range(400)]

    def is_reversed(word):
        w = "".join(c for c in word.lower() if c.isalnum())
        return len(w) > 2 and w.startswith(Q.REVERSED_PREFIXES) or w.endswith(Q.REVERSED_SUFFIXES) or w in Q.REVERSED_WORDS

    got = column(texts(spark, *rows).withColumn("n", Q.reversed_words(F.col("text"))), "n")
    assert got == [sum(map(is_reversed, r.split(" "))) for r in rows] and sum(got) > 500


def test_a_text_without_blanks_at_its_ends_is_stripped_by_no_pattern(spark):
    from quillwork.functions.text import strip

    got = texts(spark, "", "a", " ", " a b ", "a b", "\n", "😀 ", None).withColumn("s", strip(F.col("text")))
    assert column(got, "s") == ["", "a", "", "a b", "a b", "", "😀", None]
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "rlike" in plan
