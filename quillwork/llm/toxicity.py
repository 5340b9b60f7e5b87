"""Toxicity by a factorisation machine over hashed terms.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j): linear weights, plus pairwise interactions through low-rank
factors, so that two terms can matter only together. Terms are words and their character n-grams, present or not.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, stash

BUCKETS = 1 << 21
GRAMS = (4, 5)
TERMS = 4096
RANK = 8
#: At most so many labelled training documents of each class are fitted on, chosen by a hash of their ids.
SAMPLE = 4000


class Hasher:
    """Sorted distinct buckets of a text's terms, or places among the wanted ones. A word's are kept, as words recur.

    Words are runs of letters, digits and _; n-grams are taken of their UTF-8 bytes.
    """

    def __init__(self, wanted: np.ndarray | None = None):
        self.seen: dict[str, tuple[int, ...]] = {}
        self.place = None if wanted is None else {int(b): k for k, b in enumerate(wanted)}

    def word(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "surrogatepass")
        out = [zlib.crc32(raw) % BUCKETS]
        for n in GRAMS:
            out += [zlib.crc32(raw[i : i + n], n) % BUCKETS for i in range(len(raw) - n + 1)]
        found = tuple(out) if self.place is None else tuple(self.place[b] for b in out if b in self.place)
        if len(self.seen) > 200_000:
            self.seen.clear()
        if len(word) <= 64:
            self.seen[word] = found
        return found

    def text(self, text: str | None) -> np.ndarray:
        out: set[int] = set()
        for w in set(re.findall(r"\w+", (text or "").lower())):
            found = self.seen.get(w)
            if found is None:
                found = self.word(w)
            if found:
                out.update(found)
        return np.array(sorted(out), dtype=np.int32)


def choose_terms(rows: DataFrame, most: int = TERMS) -> np.ndarray:
    """The buckets whose presence in rows (toxic, terms) depends most on the class, by chi-squared; ties by bucket. Spark counts
    them, and `most` reach the driver."""

    def flat(batches):
        for batch in batches:
            toxic, terms = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            sizes = [len(t) // 4 for t in terms]
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(terms), dtype="<i4")), pa.array(np.repeat(toxic, sizes).astype(np.int64))], ["bucket", "toxic"])

    n = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = F.lit(float(n.get(1, 0) or 1)), F.lit(float(n.get(0, 0) or 1))
    counts = rows.select("toxic", "terms").mapInArrow(flat, "bucket int, toxic long").groupBy("bucket").agg(F.sum("toxic").alias("a"), F.count("*").alias("both")).where("both >= 3")
    a, both = F.col("a"), F.col("both")
    rest = (n1 - a) + (n0 - (both - a))
    chi = (a * (n0 - (both - a)) - (both - a) * (n1 - a)) ** 2 / F.greatest(F.lit(1e-9), both * rest)
    best = counts.select("bucket", chi.alias("chi")).orderBy(F.desc("chi"), "bucket").limit(most)
    return np.sort(np.array([r.bucket for r in best.select("bucket").collect()], dtype=int))


def _padded(rows: list[np.ndarray], width: int) -> list[np.ndarray]:
    return [r if len(r) else np.array([width], dtype=np.int64) for r in rows]


def _sums(rows: list[np.ndarray], w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Flat terms, their rows, scale of each row, linear sums and factor sums; row `len(w) - 1` is the padding term of weight 0."""
    rows = _padded(rows, len(w) - 1)
    flat, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return flat, np.repeat(np.arange(len(rows)), sizes), np.add.reduceat(w[flat], starts), np.add.reduceat(v[flat], starts), np.add.reduceat((v[flat] ** 2).sum(axis=1), starts)


class Machine:
    """A factorisation machine fitted by AdaGrad on log loss, both classes weighing the same in all."""

    def __init__(self, terms: np.ndarray, seed: int = 7):
        self.terms, rng = terms, np.random.default_rng(seed)
        self.b, self.w = 0.0, np.zeros(len(terms) + 1)
        self.v = np.vstack([rng.normal(0, 0.01, (len(terms), RANK)), np.zeros((1, RANK))])

    def margin(self, rows: list[np.ndarray]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        _, _, linear, factors, squares = _sums(rows, self.w, self.v)
        return self.b + linear + 0.5 * ((factors**2).sum(axis=1) - squares)

    def fit(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.05, l2: float = 1e-4, seed: int = 7) -> Machine:
        if not len(y) or y.min() == y.max():
            self.b = -4.0 if not len(y) or y[0] == 0 else 4.0
            return self
        rng = np.random.default_rng(seed)
        share = y.mean()
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        gb, gw, gv = 1e-8, np.full_like(self.w, 1e-8), np.full_like(self.v, 1e-8)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                own = order[at : at + batch]
                flat, owner, linear, factors, squares = _sums([rows[i] for i in own], self.w, self.v)
                m = self.b + linear + 0.5 * ((factors**2).sum(axis=1) - squares)
                e = weight[own] * (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[own]) / len(own)
                dw = np.bincount(flat, weights=e[owner], minlength=len(self.w)) + l2 * self.w * (np.bincount(flat, minlength=len(self.w)) > 0) / len(own)
                dv = np.zeros_like(self.v)
                np.add.at(dv, flat, e[owner, None] * (factors[owner] - self.v[flat]))
                dw[-1], dv[-1] = 0, 0
                gb, gw, gv = gb + e.sum() ** 2, gw + dw**2, gv + dv**2
                self.b -= rate * e.sum() / np.sqrt(gb)
                self.w -= rate * dw / np.sqrt(gw)
                self.v -= 0.2 * rate * dv / np.sqrt(gv)
        return self

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return (1 / (1 + np.exp(-np.clip(self.margin(rows), -30, 30)))).round(9)


def sample_ids(labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id and toxic of at most `most` training documents of each class, those with the least hashes. Held out:
    crc32(doc_id as text) mod 5 = 0. A document labelled both ways counts as toxic; null labels and ids do not count."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (id_remainder("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda c: known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return pick(1).unionByName(pick(0))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Machine:
    """A machine fitted on the bounded labelled sample. The sample's ids are broadcast (at most 2 * most); of each sampled document
    the driver gets the chosen terms that it holds, at most TERMS. Of rows that repeat a doc_id one counts."""

    def terms(batches):
        hasher = Hasher()
        for batch in batches:
            found = [hasher.text(t).astype("<i4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["doc_id", "toxic", "terms"])

    chosen = docs.select("doc_id", "text").join(F.broadcast(sample_ids(labels, most)), "doc_id").select("doc_id", F.col("toxic").cast("int"), "text")
    hashed = chosen.mapInArrow(terms, "doc_id long, toxic int, terms binary")
    rows = stash(hashed.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("terms").alias("terms")))
    wanted = choose_terms(rows)
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[wanted] = np.arange(len(wanted))

    def places(batches):
        for batch in batches:
            found = [(p := place[np.frombuffer(t, dtype="<i4")])[p >= 0].astype("<i4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["doc_id", "toxic", "terms"])

    kept = sorted((r.doc_id, bytes(r.terms), r.toxic) for r in rows.mapInArrow(places, "doc_id long, toxic int, terms binary").toLocalIterator())
    return Machine(wanted).fit([np.frombuffer(t, dtype="<i4").astype(np.int64) for _, t, _ in kept], np.array([t for _, _, t in kept]))


def classify(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= 0.5) of every row, from its whole text.

    Null and empty texts are scored as texts without terms; null and repeated doc_ids keep their rows; without labels of both
    classes the score is constant. An empty table gives no rows; further columns are ignored.
    """
    machine = train(docs, labels, most)

    def score(batches):
        hasher = Hasher(machine.terms)
        for batch in batches:
            s = machine.scores([hasher.text(t).astype(np.int64) for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), (id_remainder("doc_id", 5) == 0).alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
