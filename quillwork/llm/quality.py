"""Quality classifier by positive-unlabelled learning with a non-negative unbiased risk.

Trusted positives are training documents labelled good; all documents are the unlabelled web text. The model is additive over
hat functions of text statistics and shares of hashed words, g(x) = w . phi(x), with squared loss, so that the risk is a function of moments alone:

    R(w) = pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)]),   l(z) = (1 - z)^2 / 4

E_p and E_u need only means and second moments of phi, which Spark sums over all rows; the driver minimises over d x d matrices.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_rows, id_remainder, small, stash, tree_sum

#: Knots of each statistic's hat functions.
KNOTS = {
    "log_words": (0.0, 2.0, 4.0, 6.0, 8.0),
    "upper": (0.0, 0.05, 0.15, 0.4, 0.8),
    "punct": (0.0, 0.02, 0.05, 0.12, 0.3),
    "digits": (0.0, 0.02, 0.06, 0.15, 0.4),
    "symbols": (0.0, 0.01, 0.03, 0.1, 0.3),
    "pipes": (0.0, 0.01, 0.03, 0.08, 0.2),
    "bangs": (0.0, 0.005, 0.02, 0.06, 0.2),
    "word_length": (2.0, 4.0, 5.5, 7.0, 10.0),
    "distinct": (0.0, 0.15, 0.35, 0.6, 1.0),
    "top_share": (0.0, 0.05, 0.12, 0.3, 0.8),
    "repeats": (0.0, 0.02, 0.1, 0.3, 0.8),
    "line_words": (0.0, 1.5, 2.5, 3.5, 6.0),
    "line_repeats": (0.0, 0.05, 0.2, 0.5, 1.0),
    "short_words": (0.0, 0.1, 0.25, 0.4, 0.7),
    "odd_ends": (0.0, 0.05, 0.15, 0.4, 0.9),
    "capital_starts": (0.0, 0.05, 0.15, 0.4, 0.9),
}
#: Buckets of hashed words.
WORDS = 64
VALUES = len(KNOTS) + WORDS
TOP_PRIOR = 8
WIDTH = 1 + sum(len(k) - 1 for k in KNOTS.values()) + WORDS
RIDGE = 1e-3
MOMENTS = "n_p array<double>, sum_p array<double>, outer_p array<double>, n_u array<double>, sum_u array<double>, outer_u array<double>"


def _bucket(word: str) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORDS


@lru_cache(200_000)
def _known_bucket(word: str) -> int:
    """_bucket of a short word: only those are remembered, so that the memory of a worker is bounded."""
    return _bucket(word)


def statistics(text: str) -> list[float]:
    """The statistics of KNOTS and the shares of each bucket's words over the whole text; an empty text has zeros."""
    n = max(1, len(text))
    words = text.split()
    m = max(1, len(words))
    counts = Counter(words)
    lines = text.split("\n")
    pairs = Counter(zip(words, words[1:], strict=False))
    of = lambda chars: sum(map(text.count, chars)) / n
    letters = sum(map(len, words))
    shares = [0.0] * WORDS
    for w, c in counts.items():
        shares[_known_bucket(w) if len(w) <= 64 else _bucket(w)] += c / m
    return [
        math.log1p(len(words)),
        sum(map(str.isupper, words)) / m,
        of(".,;:?"),
        of("0123456789"),
        of("#$%&*@^~=+<>\\{}[]"),
        of("|"),
        of("!"),
        letters / m,
        len(counts) / m,
        # as if each text had TOP_PRIOR more words: the commonest word of a short text says little
        max(counts.values(), default=0) / (len(words) + TOP_PRIOR),
        sum(c - 1 for c in pairs.values()) / m,
        math.log1p(len(words) / max(1, len(lines))),
        1 - len(set(lines)) / len(lines),
        sum(len(w) <= 2 for w in words) / m,
        sum(not w[-1].isalnum() for w in words) / m,
        sum(w[0].isupper() for w in words) / m,
        *shares,
    ]


def all_statistics(texts: list[str | None]) -> np.ndarray:
    """A row of statistics for each text. A null text counts as empty."""
    return np.array([statistics(t or "") for t in texts]).reshape(len(texts), VALUES)


def features(values: np.ndarray) -> np.ndarray:
    """phi of each row of statistics: 1, the hat functions of each statistic but its first, and roots of shares."""
    out = [np.ones((len(values), 1))]
    for column, knots in zip(values.T[: len(KNOTS)], KNOTS.values(), strict=True):
        k = np.asarray(knots)
        x = np.clip(column, k[0], k[-1])
        at = np.clip(np.searchsorted(k, x, side="right") - 1, 0, len(k) - 2)
        part = (x - k[at]) / (k[at + 1] - k[at])
        hats = np.zeros((len(x), len(k)))
        hats[np.arange(len(x)), at] = 1 - part
        hats[np.arange(len(x)), at + 1] += part
        out.append(hats[:, 1:])
    return np.hstack([*out, np.sqrt(values[:, len(KNOTS) :])])


def _rows(stats: pa.Array) -> np.ndarray:
    return np.asarray(stats.flatten(), dtype=float).reshape(len(stats), VALUES)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, VALUES, dtype=np.int32)), pa.array(values.ravel()))


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and stats (80 numbers) of every row: all that training and scoring need of a text."""

    def compute(batches):
        for batch in small(batches):
            lists = _lists(all_statistics(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["doc_id", "held_out", "stats"])

    rows = docs.select(F.col("doc_id").cast("long"), (id_remainder("doc_id", 3) == 1).alias("held_out"), "text")
    return rows.mapInArrow(compute, "doc_id long, held_out boolean, stats array<double>")


def rows_with_statistics(docs: DataFrame) -> DataFrame:
    """Every row of docs, whole, as `row`, with the statistics of its text."""
    rows = as_rows(docs)

    def compute(batches):
        for batch in small(batches):
            lists = _lists(all_statistics(batch.column(0).field("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["row", "stats"])

    schema = T.StructType([*rows.schema.fields, T.StructField("stats", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(compute, schema)


def _moments(batches):
    """One row for each task: counts, sums and second moments of positives and of all rows; columns positive, stats."""
    sums = {k: [np.zeros(1), np.zeros(WIDTH), np.zeros((WIDTH, WIDTH))] for k in "pu"}
    for batch in batches:
        x = features(_rows(batch.column(1)))
        positive = np.array([bool(v) for v in batch.column(0).to_pylist()], dtype=bool)
        for kind, rows in (("p", x[positive]), ("u", x)):
            s = sums[kind]
            s[0] += len(rows)
            s[1] += rows.sum(axis=0)
            s[2] += rows.T @ rows
    arrays = [pa.array([np.ravel(v).tolist()], pa.list_(pa.float64())) for kind in "pu" for v in sums[kind]]
    yield pa.RecordBatch.from_arrays(arrays, [f"{n}_{kind}" for kind in "pu" for n in ("n", "sum", "outer")])


def class_prior(mean_u: np.ndarray, mean_p: np.ndarray, second_p: np.ndarray, second_u: np.ndarray) -> float:
    """An estimate of the share of positives among the unlabelled rows.

    u = pi p + (1 - pi) n, so the component of u along p in the metric of the pooled second moment, which matches the densities'
    best L2 fit u ~ theta p, gives theta = pi where p and n do not overlap (class-prior estimation by penalised divergence).
    """
    pooled = 0.5 * (second_p + second_u) + RIDGE * np.eye(len(mean_p))
    a = np.linalg.solve(pooled, mean_p)
    # the direction in which positives are constant and the rest differ: a . phi is 1 on positives and below elsewhere
    on_p, on_u = float(a @ mean_p), float(a @ mean_u)
    return float(np.clip(on_u / max(on_p, 1e-12), 0.05, 0.99))


def fit(moments: dict[str, np.ndarray], prior: float | None = None, steps: int = 4000) -> tuple[np.ndarray, float]:
    """(w, class prior). Gradient steps on the non-negative risk: where its second part would go below 0, that part is clipped
    and gives no gradient. Without positives or rows the model is constant: every text scores 1."""
    if not len(moments["n_p"]) or not moments["n_p"][0] or not moments["n_u"][0]:
        return np.eye(WIDTH)[0], 1.0
    n_p, n_u = moments["n_p"][0], moments["n_u"][0]
    mp, mu = moments["sum_p"] / n_p, moments["sum_u"] / n_u
    sp, su = moments["outer_p"].reshape(WIDTH, WIDTH) / n_p, moments["outer_u"].reshape(WIDTH, WIDTH) / n_u
    pi = prior if prior is not None else class_prior(mu, mp, sp, su)
    loss = lambda w, m, s, y: (1 - 2 * y * (w @ m) + w @ s @ w) / 4  # noqa: E731  E[(1 - y g)^2] / 4
    slope = lambda w, m, s, y: (s @ w - y * m) / 2
    # steps are taken in the metric of the pooled second moment, in which the risk is well conditioned
    root = np.linalg.inv(np.linalg.cholesky(su + pi * sp + RIDGE * np.eye(WIDTH)))
    metric = root.T @ root
    w, best, least = np.eye(WIDTH)[0].copy(), None, np.inf
    for step in range(steps):
        negative = loss(w, mu, su, -1) - pi * loss(w, mp, sp, -1)
        risk = pi * loss(w, mp, sp, 1) + max(0.0, negative) + RIDGE * (w @ w)
        if risk < least:
            best, least = w.copy(), risk
        g = pi * slope(w, mp, sp, 1) + 2 * RIDGE * w
        if negative > 0:
            g = g + slope(w, mu, su, -1) - pi * slope(w, mp, sp, -1)
        w = w - (0.5 / (1 + step / 500)) * (metric @ g)
    return best, pi


def trusted(labels: DataFrame) -> DataFrame:
    """doc_id of training documents that are labelled good and never bad. Held out: crc32(doc_id as text) mod 3 = 1."""
    train = labels.where(id_remainder("doc_id", 3) != 1)
    return train.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def train(stats: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and class prior from the statistics of all rows (unlabelled) and of those that `trusted` names (positives). The
    join with labels moves statistics, not texts."""
    good = trusted(labels).select("doc_id", F.lit(True).alias("positive"))
    # rows without an id are unlabelled by themselves: the join would gather them in one task
    named = stats.where("doc_id is not null").join(good, "doc_id", "left").select("positive", "stats")
    rows = named.unionByName(stats.where("doc_id is null").select(F.lit(None).cast("boolean").alias("positive"), "stats"))
    return fit(tree_sum(rows.mapInArrow(_moments, MOMENTS), [c.split()[0] for c in MOMENTS.split(", ")]))


def scores(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.clip((features(values) @ weights + 1) / 2, 0.0, 1.0).round(9)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= 0.5) of every row, from its whole text.

    Null and empty texts are scored as empty texts; null and repeated doc_ids keep their rows; labels of unknown documents and
    null labels count for nothing; an empty table gives no rows. Further columns are ignored.
    """
    seen = stash(text_statistics(docs))
    weights, _ = train(seen, labels)

    def score(batches):
        for batch in batches:
            s = scores(_rows(batch.column(2)), weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return seen.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, whole, that score 0.5 or more. Null and empty texts are scored as empty texts; repeated rows and null
    doc_ids are each judged by their text; columns may have any name and type; an empty table gives none."""
    # texts are analysed once; training reads the statistics alone of what is written here
    rows = stash(rows_with_statistics(docs))
    weights, _ = train(rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), "stats"), labels)

    def keep(batches):
        for batch in batches:
            yield batch.select(["row"]).filter(pa.array(scores(_rows(batch.column(1)), weights) >= 0.5))

    return rows.mapInArrow(keep, rows.select("row").schema).select("row.*")
