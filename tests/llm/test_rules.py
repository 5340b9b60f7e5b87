import random
from collections import Counter

import pytest

from quillwork.llm import rules
from quillwork.llm.queries import ORACLES, QUERIES

from ..conftest import SF
from ..test_oracles import _plain, duck  # noqa: F401
from .helpers import AWKWARD, docs


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    df = QUERIES[name](spark, SF)
    columns, rel = sorted(df.columns), duck.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    got = sorted(repr(_plain(list(r))) for r in df.select(*columns).collect())
    assert got == sorted(repr(_plain(list(r))) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall())


def brute_counts(text):
    words = [w for w in (text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\v\f\r")]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)), len(hit))


def test_counts_equal_brute_force():
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a", "a a a a a a", "é ü x  y\nz\nz\r\nz", "\n\nline\nline\n line"]
    texts += ["".join(rng.choice(["a", "b", "cc", "#", " ", " ", "\n", "\v", "ß"]) for _ in range(rng.randrange(200))) for _ in range(300)]
    assert [rules.counts(t) for t in texts] == [brute_counts(t) for t in texts]


def test_counts_of_two_million_distinct_words():
    text = " ".join(map(str, range(2_000_000)))
    assert rules.counts(text + " " + text[:100])[0] == 2_000_000 + len(text[:100].split())
    assert rules.counts(text)[5] == 0


def brute_kept(rows):
    """doc_id -> (base_failed, kept) from sorted lists of bucketed values."""

    def low(v):
        s = max(v.bit_length() - rules.BITS - 1, 0)
        return v >> s << s

    found = [(i, lang or "", source or "", brute_counts(t)) for i, t, lang, source in rows]
    metric = lambda c: (1000 * c[1] // max(c[0], 1), 1000 * c[2] // max(c[0], 1), 1000 * c[4] // max(c[3], 1))
    out = {}
    for i, lang, source, c in found:
        failed = c[0] < 10 or 100 * c[5] > 20 * c[0]
        kept = not failed
        for m, (_, least) in enumerate(rules.METRICS):
            groups = [[f for f in found if f[3][0] and f[1:3] == (lang, source)], [f for f in found if f[3][0] and f[1] == lang], [f for f in found if f[3][0]]]
            group = next((g for g in groups[:2] if len(g) >= 8), groups[2])
            v = sorted(low(metric(f[3])[m]) for f in group)
            q = [v[-(-len(v) * k // 4) - 1] for k in (1, 2, 3)] if v else [0, 0, 0]
            kept &= abs(metric(c)[m] - q[1]) <= rules.REACH * max(min(q[1] - q[0], q[2] - q[1]), least)
        out[i] = (failed, kept)
    return out


@pytest.mark.parametrize("sent", [10_000, 0])
def test_verdicts_equal_brute_force(spark, sent):
    rng = random.Random(5)
    rows = []
    for i in range(90):
        words = [rng.choice(["word", "some", "longer", "text"]) + "x" * rng.randrange(3) + str(rng.randrange(900)) for _ in range(rng.randrange(5, 40))]
        if i % 9 == 0:
            words = [w + "#" * 40 for w in words]
        if i % 11 == 0:
            words = [w * 9 for w in words]
        rows.append((i, " ".join(words) + "\nsame" * rng.choice([0, 0, 1, 9]), rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", "c", None])))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in rules.apply_rules(df, group_least=8, sent_groups=sent).collect()}
    want = brute_kept(rows)
    assert got == want
    assert len(set(want.values())) == 3


def test_awkward_rows(spark):
    rows = rules.apply_rules(docs(spark, AWKWARD, extra=True).selectExpr("*", "1 as salt", "2 as bucket", "3 as n_words", "4 as metric")).collect()
    assert len(rows) == len(AWKWARD)
    assert sorted((str(r.doc_id), r.n_words) for r in rows) == sorted((str(i), brute_counts(t)[0]) for i, t in AWKWARD)
    assert rules.apply_rules(docs(spark, []).where("false")).count() == 0
    assert [r.kept for r in rules.apply_rules(docs(spark, [(1, None)])).collect()] == [False]


def test_sketches_merge(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    seen = rules.measured(df).cache()
    whole = sorted(map(tuple, rules.sketches(seen).collect()))
    half = rules.sketches(seen.where("doc_id % 2 = 0")).unionByName(rules.sketches(seen.where("doc_id % 2 = 1")))
    assert sorted(map(tuple, half.groupBy("lang", "source", "metric", "bucket").sum("n").collect())) == whole


def test_junk_goes_and_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.1"
    out = rules.apply_rules(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    share = {r.quality: r.kept for r in out.where("n_words >= 10 and not base_failed or quality = 0").selectExpr("quality", "cast(kept as int) as kept").groupBy("quality").avg("kept").toDF("quality", "kept").collect()}
    assert share[1] > 0.99 and share[0] < 0.05
