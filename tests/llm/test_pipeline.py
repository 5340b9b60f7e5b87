"""Each stage of the pipeline on its own input, against brute force."""

from collections import Counter

import corpus_pipeline as P
from quillwork.llm import decontam, mixing
from quillwork.llm.common import table

from .helpers import docs, minimal_components

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    if min(len(a), len(b)) < 0.6 * max(len(a), len(b)) or not (n := len(a & b)):
        return 0.0
    return n / (len(a) + len(b) - n)


def test_stages(spark):
    d = table(spark, SF, "documents")
    names = d.columns
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    items = [decontam.normal_words(r.text.encode()) for r in table(spark, SF, "benchmark").collect()]
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "benchmark_leaks", "mixing", "sharding"]
    for name, stage in P.STAGES:
        before = {r.doc_id: r for r in d.collect()}
        out = stage(spark, d, SF)
        after = out.collect()
        assert name == "sharding" or out.columns == names
        kept = {r.doc_id for r in after}
        assert kept <= set(before) and len(after) == len(kept)
        if name == "quality":
            gone = [labels[i] for i in set(before) - kept if i in labels]
            assert gone and sum(gone) / len(gone) < 0.1 and sum(q for i, q in labels.items() if i in kept) > 300
        elif name == "near_duplicates":
            grams = {i: shingles(r.text) for i, r in before.items()}
            ids = sorted(grams)
            close = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if jaccard(grams[a], grams[b]) >= 0.8]
            assert close and kept == set(minimal_components(ids, close).values())
        elif name == "benchmark_leaks":
            held = {i for i, r in before.items() if any(b" ".join(w) in b" ".join(decontam.normal_words(r.text.encode())) for w in items)}
            assert set(before) - kept == held
        else:
            assert kept == set(before)
        if name == "mixing":
            ordered = mixing.mix(d).orderBy("mix_position").collect()
            assert [r.doc_id for r in after] == [r.doc_id for r in ordered]
        d = spark.createDataFrame(after, out.schema)
    assert {r.shard for r in after} <= set(range(24))


def test_run(spark):
    rows = P.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and "shard" in rows[0].asDict() and P.ORACLE_SQL is None


def test_mix_survives_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "STAGES", P.STAGES[-2:])
    P.run(spark, "/root/testdata/sf0.1").repartition(7).write.parquet(f"{tmp_path}/out")
    rows = sorted(spark.read.parquet(f"{tmp_path}/out").select("source", "shard", "mix_position").collect(), key=lambda r: r.mix_position)
    assert [r.mix_position for r in rows] == list(range(len(rows))) and {r.shard for r in rows} == set(range(24))
    stream = [r.source if r.source in mixing.SHARES else mixing.OTHER for r in rows]
    total, taken = Counter(stream), Counter()
    weight = sum(mixing.SHARES[s] for s in total)
    for n, s in enumerate(stream, 1):
        taken[s] += 1
        if taken[s] == total[s]:
            break
        if n % mixing.BLOCK_ROWS == 0:
            assert all(abs(taken[x] - n * mixing.SHARES[x] / weight) < mixing.BLOCK_ROWS for x in total)
    assert n > 20 * mixing.BLOCK_ROWS


def test_stages_take_awkward_rows(spark):
    for extra in (False, True):
        d = docs(spark, [(1, "one two three four five six seven"), (2, None), (3, ""), (None, "no id"), (1, "one two three four five six seven"), (4, "a long text of words " * 20000)], extra)
        for name, stage in P.STAGES:
            out = stage(spark, d, "/root/testdata/sf0.001")
            rows = out.collect()
            assert len(rows) <= 6 and (name == "sharding" or out.columns == d.columns)
            assert len(out.columns) == len(set(out.columns)) and (not extra or {r.odd["a"] for r in rows} <= {1})
            assert stage(spark, d.where("false"), "/root/testdata/sf0.001").count() == 0


def test_run_leaves_one_table_behind(spark):
    from quillwork.llm import common

    before = list(common.STASHES)
    out = P.run(spark, "/root/testdata/sf0.001")
    assert len(common.STASHES) == len(before) + 1 and out.count() > 0
