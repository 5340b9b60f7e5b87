"""The first balanced object of a text, against a fold over characters."""

import random
import time

from pyspark.sql import functions as F

from quillwork.operators.plan_tables import null_paths
from quillwork.operators.routing import first_object


def brute(text):
    start = text.find("{")
    if start < 0:
        return None
    depth, quoted, escaped = 0, False, False
    for n, c in enumerate(text[start:], 1):
        inside, quote, was = quoted, c == '"' and not escaped, escaped
        if not inside:
            depth += {"{": 1, "}": -1}.get(c, 0)
        if quote:
            quoted = not inside
        escaped = inside and c == "\\" and not was
        if depth == 0 and not quoted:
            return text[start : start + n]
    return text[start:] + ('"' if quoted else "") + "}" * max(depth, 0)


def test_first_object_equals_a_fold_over_characters(spark):
    rng = random.Random(8)
    texts = ["", "{", "}{", '{"a', '{"a\\', '{"\\\\"}', '{\\"x"}', "{}}", 'é{"ü}": "😀"}x', None] + ["".join(rng.choice('{}""\\\\ab é\n') for _ in range(rng.randrange(40))) for _ in range(400)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", first_object(F.col("t")).alias("o")).collect()
    assert {r.i: r.o for r in rows} == {i: None if t is None else brute(t) for i, t in enumerate(texts)}


def test_long_replies_take_linear_time(spark):
    texts = ['{"a": "' + "x" * 200_000 + '\\"{", "b": {}} tail', '{"a": "' + "\\\\" * 20_000]
    began = time.time()
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(first_object(F.col("t"))).collect()]
    assert got == [brute(t) for t in texts] and time.time() - began < 20


def test_null_paths_of_awkward_replies(spark):
    rows = [(1, None), (2, ""), (3, "{"), (4, '{"plans": [{}]}'), (5, '{"plans": [{"plan_name": null, "a.b": {"c": null}}]}'), (5, '{"plans": [{"a": null}]}'), (None, '{"plans": [{"plan_name": "N", "k": null}]}'), (6, '{"plans": null}')]
    df = spark.createDataFrame(rows, "doc_id long, response string").selectExpr("*", "1 as object", "2 as key", "3 as value", "4 as path")
    got = sorted((str(r.doc_id), r.plan_name, r.path) for r in null_paths(df).collect())
    assert got == [("5", "Plan 1", "a"), ("5", "Plan 1", "a.b.c"), ("5", "Plan 1", "plan_name"), ("None", "N", "k")]
    assert null_paths(df.where("false")).count() == 0
