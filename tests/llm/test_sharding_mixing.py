import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillwork.llm import mixing, sharding
from quillwork.llm.common import table

from ..conftest import SF
from .helpers import AWKWARD, DOCS, docs


def test_shard_table(spark):
    source = table(spark, SF, "documents")
    rows = sharding.shard_table(source).collect()
    texts = {r.doc_id: r.text or "" for r in source.collect()}
    assert len(rows) == len(texts)
    slots = defaultdict(list)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert any(r.grown_shard == 24 for r in rows)


def test_weights_and_growth(spark):
    keys = spark.range(40000).withColumnRenamed("id", "doc_id")
    before = {r.doc_id: r.shard for r in sharding.assign_shards(keys, {0: 1.0, 1: 2.0, 2: 1.0}).collect()}
    sizes = Counter(before.values())
    assert abs(sizes[1] / 20000 - 1) < 0.05
    after = {r.doc_id: r.shard for r in sharding.assign_shards(keys, {0: 1.0, 1: 2.0, 2: 1.0, 3: 1.0}).collect()}
    moved = [k for k in before if before[k] != after[k]]
    assert all(after[k] == 3 for k in moved) and abs(len(moved) / 8000 - 1) < 0.1
    with pytest.raises(ValueError):
        sharding.assign_shards(keys, {})


def test_shards_of_awkward_rows(spark):
    for extra in (False, True):
        rows = sharding.shard_table(docs(spark, AWKWARD, extra)).collect()
        assert len(rows) == len(AWKWARD)
        assert len({r.shard for r in rows if r.doc_id is None}) == 1 and len({r.shard for r in rows if r.doc_id == 5}) == 1
    assert sharding.shard_table(spark.createDataFrame([], DOCS)).count() == 0


def brute_schedule(blocks, shares):
    """Slot by slot: the released block with the earliest deadline, in phases with the sources that are left."""
    done, out, start = dict.fromkeys(blocks, 0), [], 0
    while any(done[s] < blocks[s] for s in blocks):
        active = {s: shares[s] for s in blocks if done[s] < blocks[s]}
        total, own, t = sum(active.values()), dict.fromkeys(active, 0), 0
        while True:
            ready = [s for s in active if own[s] * total // active[s] <= t]
            s = min(ready, key=lambda s: (-(-(own[s] + 1) * total // active[s]), s))
            out.append((s, done[s]))
            own[s], done[s], t = own[s] + 1, done[s] + 1, t + 1
            for x in active:
                assert abs(own[x] - active[x] * t / total) < 1
            if done[s] == blocks[s]:
                break
        start += t
    return out


def test_mix_equals_schedule(spark):
    rows = [(i, "t", ["a", "b", "c", "zz", None][i % 5 if i % 7 else 0]) for i in range(900)]
    shares = {"a": 3, "b": 2, "c": 1}
    got = mixing.mix(docs(spark, rows), shares, block_rows=8).orderBy("mix_position").collect()
    assert [r.mix_position for r in got] == list(range(900)) and len({r.doc_id for r in got}) == 900
    sizes = Counter(r.mix_source for r in got)
    assert set(sizes) == {"a", "b", "c", mixing.OTHER}
    order = list(dict.fromkeys((r.mix_source, r.mix_block) for r in got))
    assert order == brute_schedule({s: -(-n // 8) for s, n in sizes.items()}, shares | {mixing.OTHER: 1})
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)
    per = Counter((r.mix_source, r.mix_block) for r in got)
    last = {s: max(b for x, b in per if x == s) for s in sizes}
    assert all(n == 8 or b == last[s] for (s, b), n in per.items())


def test_unlisted_sources_get_streams(spark):
    rows = [(i, "t", ["a", "x", "y", "z", None][i % 5]) for i in range(1000)]
    got = mixing.mix(docs(spark, rows), {"a": 2}, block_rows=4, own_streams=True).orderBy("mix_position").collect()
    assert [r.mix_position for r in got] == list(range(1000))
    assert Counter(r.mix_source for r in got) == {"a": 200, "x": 200, "y": 200, "z": 200, mixing.OTHER: 200}
    for n in range(20, 1000, 4):
        front = Counter(r.mix_source for r in got[:n])
        # all have the share 2 of 10
        assert all(abs(front[s] - n / 5) < 4 for s in ["a", "x", "y", "z", mixing.OTHER])


@pytest.mark.parametrize("loose", [150, 5000])
def test_each_of_many_loose_sources_stays_within_a_block(spark, loose):
    """A named source of half the weight, and loose ones of different sizes, all with blocks left for the first half."""
    weight, per = loose, 8 if loose == 150 else 2
    rows = spark.range(loose * per * 2 + loose).selectExpr("id as doc_id", f"case when id % 2 = 0 then 'a' else concat('s', (id div 2) % {loose}) end as source")
    got = mixing.mix(rows, {"a": weight, mixing.OTHER: 1}, block_rows=2, own_streams=True).orderBy("mix_position").select("mix_source", "mix_slot", "mix_release", "mix_deadline", "mix_position").collect()
    assert [r.mix_position for r in got] == list(range(len(got))) and all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)
    slots = {}
    for r in got:
        slots.setdefault(r.mix_source, set()).add(r.mix_slot)
    assert len(slots) == loose + 1
    share = {s: (weight if s == "a" else 1) / (2 * loose) for s in slots}
    until = min(max(x) for x in slots.values())
    for s, own in slots.items():
        for k, t in enumerate(sorted(x for x in own if x <= until)):
            # before and after its k-th block
            assert abs(k - share[s] * t) < 1 + 1e-9 and abs(k + 1 - share[s] * (t + 1)) < 1 + 1e-9


def test_rows_without_a_key_spread(spark):
    rows = spark.range(20_000).selectExpr("cast(null as bigint) as doc_id", "'src0' as source", "concat('text ', id) as text")
    plain = mixing.mix(rows).select("mix_position").collect()
    assert sorted(r[0] for r in plain) == list(range(20_000))
    salt = F.xxhash64("doc_id", F.xxhash64("doc_id", "source", "text"))
    assert rows.select(F.pmod(salt, F.lit(-(-20_000 // mixing.SLICE_ROWS)))).distinct().count() > 70


def test_mix_of_awkward_rows(spark):
    for extra in (False, True):
        df = docs(spark, AWKWARD, extra)
        out = mixing.mix(df, {"src1": 1})
        rows = out.collect()
        assert out.columns == [c for c in df.columns if c not in mixing.COLUMNS] + list(mixing.COLUMNS)
        assert sorted(r.mix_position for r in rows) == list(range(len(AWKWARD))) and {r.mix_source for r in rows} == {"src1"}
        mixed = mixing.mixed(df)
        assert mixed.columns == df.columns
        assert sorted(map(str, mixed.collect())) == sorted(map(str, df.collect()))
        if extra:
            assert {(r._n, r._first, r._slice, r["a.b"], r.odd["a"]) for r in rows} == {(4, 9, 6, 23, 1)}
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
