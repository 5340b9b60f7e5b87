"""Footnotes against their SQL on texts that the tables lack: all marker styles, markers in notes, repeats and near misses."""

import random

import duckdb

from quillwork.plans.queries import ORACLES, QUERIES

PIECES = ["Cover[1] and [2], or (3).", "plain 1, 22; 12a 3", "x¹ y² z¹²", "1 First note, with more. End.", "2. Second [1] note", "¹ Upper note", "¹² Longer upper " + "word " * 60, "3 ", "(3) own line", "[2] own line", "4 four", "see 4", "", "   ", "1. again 2.", "2024: a year", "no digits"]


def test_footnotes_of_awkward_texts(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", "\n\n\n", "1", "1 a\n1", *["\n".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 12))) for _ in range(400)]]
    spark.createDataFrame([(i * 16 + 2, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("footnotes_inline", "footnotes_minimal"):
        got = {r.doc_id: r.noted for r in QUERIES[name](spark, str(tmp_path)).collect()}
        want = dict(duck.sql(f"select doc_id, noted from ({ORACLES[name]})").fetchall())
        assert len(got) == len(texts) and got == want
        assert sum("(" in (v or "") and "First note" in v for v in got.values()) > 20
