"""Language-model scores from an n-gram trie in Elias-Fano levels, built and queried shard by shard.

A bigram model with Dirichlet smoothing by the unigram model p1(w) = (c(w) + 0.1) / Z, Z = N + 0.1 (V + 1):

    p(w | v) = (c(v w) + K(v) p1(w)) / (c(v) + K(v))

K(v) is the context's own count, within LEAST and MOST, for words that make up 1 / HEAD of all tokens or more. These are at most
HEAD, so every task can know their counts. All others share the geometric mean of LEAST and the most that they can count. Its logarithm splits into a part of the pair, log10(c(v w) + K(v) p1(w)), and a part of the context. Every word of
a text is the context of one token, so both parts can be summed where the word's own counts are: the trie holds words and, under
each, the words before it. A shard has the words of one hash range with all their contexts. Documents' tokens go once to their
shards, which count, build the trie and answer from it; only sums come back. Frequent words are spread over all shards by their
contexts; their counts are known from a first pass, and at most 2 a shard, HEAD in all, can be frequent.

Chunks of documents meet shards on two levels once there are more than FAN shards: a chunk sends to the square root of that many
ranges of shards, a range merges what a team of chunks sent before it deals it to its shards, and sums come back the same way. So
messages grow with the input times the square root of it, and no task holds more than about a shard's tokens.
"""

from __future__ import annotations

import math
import struct
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, stash, words_of
from .eliasfano import KEY_BITS, Trie

#: Concentrations: measured on held-out texts, contexts seen n times do best near K = n, from 10 to 1000.
HEAD, LEAST, MOST = 200_000, 10.0, 1000.0
SHARD_TOKENS = 2_000_000
CHUNK_BYTES = 4 << 20
FAN = 256
CONTEXT = np.uint64((1 << KEY_BITS) - 1)
#: No word contains a space, so these never equal one.
END, START = (xxhash.xxh64_intdigest(s, 0) for s in (b" end", b" start"))
LOOKUP_ROWS = 1 << 18


class Concentration:
    """K of each context, by the 40 bits that tell contexts apart."""

    def __init__(self, head: dict[int, int], total: int, constant: float | None = None):
        known = sorted({k & ((1 << KEY_BITS) - 1): n for k, n in head.items()}.items()) if constant is None else []
        self.keys = np.array([k for k, _ in known], dtype=np.uint64)
        self.values = np.clip(np.array([n for _, n in known], dtype=float), LEAST, MOST)
        self.rare = float(np.clip(np.sqrt(LEAST * total / HEAD), LEAST, MOST)) if constant is None else constant

    def of(self, contexts: np.ndarray) -> np.ndarray:
        keys = contexts & np.uint64((1 << KEY_BITS) - 1)
        if not len(self.keys):
            return np.full(len(keys), self.rare)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], self.rare)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 0) for w in words), dtype=np.uint64, count=len(words))


def token_counts(docs: DataFrame) -> DataFrame:
    """token (64-bit hash) and n over the texts of rows whose `train` is true, ends of texts included."""

    def count(batches):
        seen: dict[bytes, int] = {}
        ends = 0

        def flush():
            keys = _hashes(list(seen)).view(np.int64)
            n = np.fromiter(seen.values(), dtype=np.int64, count=len(seen))
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["token", "n"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                ends += 1
                for w in words_of(text or b""):
                    seen[w] = seen.get(w, 0) + 1
                if len(seen) > 500_000:
                    yield flush()
        yield flush()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([np.uint64(END).astype(np.int64)]), pa.array([ends])], ["token", "n"])

    return docs.where("train").select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _pack(*arrays: np.ndarray) -> bytes:
    head = struct.pack(f"<{len(arrays)}q", *(a.nbytes for a in arrays))
    return zstandard.compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(data), 8 * len(kinds), []
    for size, kind in zip(struct.unpack_from(f"<{len(kinds)}q", raw), kinds, strict=True):
        out.append(np.frombuffer(raw, dtype=kind, count=size // np.dtype(kind).itemsize, offset=at))
        at += size
    return out


class Plan:
    """Where words and chunks go: shards, ranges of neighbouring shards, teams of chunks, and the counts of frequent words."""

    def __init__(self, shards: int, frequent: dict[int, int], fan: int):
        self.shards = shards
        self.two_levels = shards > fan
        self.width = math.isqrt(shards - 1) + 1 if self.two_levels else 1
        self.teams = -(-shards // self.width)
        self.keys = np.array(sorted(frequent), dtype=np.uint64)
        self.counts = np.array([frequent[int(k)] for k in self.keys], dtype=float)

    def shard(self, words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """The shard of each pair: by its word, or for a frequent word by its context too."""
        spread = ((contexts & CONTEXT) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        return (np.where(np.isin(words, self.keys), words + spread, words) % np.uint64(self.shards)).astype(np.int64)

    def team(self, chunk: int) -> int:
        return xxhash.xxh64_intdigest(struct.pack("<q", chunk), 0) % self.teams if self.two_levels else chunk


def _dealt(place: np.ndarray, word: np.ndarray, key: np.ndarray, doc: np.ndarray, times: np.ndarray, chunk: np.ndarray, index: np.ndarray, train: np.ndarray):
    """(place, payload) of entries that are sorted by place and have equal pairs beside each other: words, their contexts, the
    contexts' documents, and of these documents (sorted by chunk) chunk, number in it and train flag."""
    cuts = np.r_[np.flatnonzero(np.r_[True, place[1:] != place[:-1]]), len(place)] if len(place) else np.zeros(1, dtype=np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        x, y = word[a:b], key[a:b]
        new_word = np.r_[True, x[1:] != x[:-1]]
        new_pair = new_word | np.r_[True, y[1:] != y[:-1]]
        words_at, pairs_at = np.flatnonzero(new_word), np.flatnonzero(new_pair)
        per_word = np.diff(np.r_[np.searchsorted(pairs_at, words_at), len(pairs_at)])
        docs, own = np.unique(doc[a:b], return_inverse=True)
        chunks, chunk_docs = np.unique(chunk[docs], return_counts=True)
        keys = y[pairs_at].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]
        yield int(place[a]), _pack(
            x[words_at].astype("<u8"), per_word.astype("<u4"), keys, np.diff(np.r_[pairs_at, b - a]).astype("<u4"), own.astype("<u4"), times[a:b].astype("<u4"),
            chunks.astype("<i8"), chunk_docs.astype("<u4"), index[docs].astype("<u4"), np.packbits(train[docs], bitorder="little"),
        )


def _home(chunk: int) -> int:
    """The place of a chunk's own list of documents, which no shard has."""
    return -1 - chunk


class _Chunk:
    """Documents gathered to be sent out together: their tokens by local word numbers."""

    def __init__(self):
        self.words: dict[bytes, int] = {}
        self.ids, self.train, self.tokens, self.size = [], [], [], 0

    def add(self, doc_id, train: bool, text: bytes) -> None:
        words = words_of(text)
        number = self.words
        # 0 is the end, 1 the start
        self.tokens.append(np.fromiter((number.setdefault(w, len(number) + 2) for w in words), dtype=np.int64, count=len(words)))
        self.ids.append(doc_id)
        self.train.append(train)
        self.size += len(text) + 64

    def rows(self, number: int, plan: Plan):
        """(place, team, payload): entries (word, word before, document, times) by shard or range, and the chunk's documents at its home."""
        n = np.array([len(t) + 1 for t in self.tokens])
        w = np.concatenate([x for t in self.tokens for x in (t, np.zeros(1, dtype=np.int64))])
        ends = np.cumsum(n)
        v = np.empty_like(w)
        v[1:] = w[:-1]
        v[ends - n] = 1
        doc = np.repeat(np.arange(len(n)), n)
        hashes = np.concatenate([np.array([END, START], dtype=np.uint64), _hashes(list(self.words))])
        size = len(hashes)
        entry, times = np.unique((w * size + v) * len(n) + doc, return_counts=True)
        pair, doc = np.divmod(entry, len(n))
        w, v = np.divmod(pair, size)
        place = plan.shard(hashes[w], hashes[v]) // plan.width
        order = np.argsort(place, kind="stable")
        place, w, v, doc, times = (a[order] for a in (place, w, v, doc, times))
        every, team = np.arange(len(n)), plan.team(number)
        for at, payload in _dealt(place, hashes[w], hashes[v] & CONTEXT, doc, times, np.full(len(n), number), every, np.array(self.train, dtype=bool)):
            yield at, team, payload
        yield _home(number), team, _pack(*(np.zeros(0, dtype=k) for k in ANSWER[:6]), np.array([i is not None for i in self.ids], dtype=np.uint8), np.array([i or 0 for i in self.ids], dtype="<i8"), n.astype("<u4"))


PAYLOAD = ("<u8", "<u4", "u1", "<u4", "<u4", "<u4", "<i8", "<u4", "<u4", "u1")
ANSWER = ("<i8", "<u4", "<u4", "<u4", "<f8", "<f8", "u1", "<i8", "<u4")
SENT, ANSWERED = "place long, team long, payload binary", "team long, place long, payload binary"


def _send(plan: Plan):
    def send(batches):
        from pyspark import TaskContext

        number, chunk = TaskContext.get().partitionId() << 24, _Chunk()

        def out():
            for row in chunk.rows(number, plan):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["place", "team", "payload"])

        for batch in batches:
            for doc_id, train, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                chunk.add(doc_id, train, text or b"")
                if chunk.size >= CHUNK_BYTES:
                    yield from out()
                    number, chunk = number + 1, _Chunk()
        if chunk.ids:
            yield from out()

    return send


class _Part:
    """The entries of one payload, each array as long as its level: words, pairs, entries, documents."""

    def __init__(self, payload: bytes):
        self.word, self.per_word, key, self.per_pair, self.doc, self.times, self.chunks, self.chunk_docs, self.index, train = _unpack(payload, *PAYLOAD)
        wide = np.zeros((len(self.per_pair), 8), dtype=np.uint8)
        wide[:, : KEY_BITS // 8] = key.reshape(-1, KEY_BITS // 8)
        self.key, self.pair_word = wide.view("<u8").ravel(), np.repeat(self.word, self.per_word)
        self.train = np.unpackbits(train, count=len(self.index), bitorder="little")


def _split(plan: Plan):
    """What a team of chunks sent to a range, merged and dealt to the range's shards."""

    def split(table: pa.Table) -> pa.Table:
        place, team = table.column("place")[0].as_py(), table.column("team")[0].as_py()
        if place < 0:
            return table.select(["place", "team", "payload"])
        parts = [_Part(p) for p in table.column("payload").to_pylist()]
        begins = np.cumsum([0] + [len(p.index) for p in parts])
        chunk, index, train = (np.concatenate(a) for a in zip(*((np.repeat(p.chunks, p.chunk_docs), p.index, p.train) for p in parts), strict=True))
        word, key, doc, times = (np.concatenate(a) for a in zip(*((np.repeat(p.pair_word, p.per_pair), np.repeat(p.key, p.per_pair), p.doc + at, p.times) for p, at in zip(parts, begins[:-1], strict=True)), strict=True))
        del parts
        # documents by their chunk, so that one list of chunks tells whose they are
        by_chunk = np.argsort(chunk, kind="stable")
        number = np.empty_like(by_chunk)
        number[by_chunk] = np.arange(len(by_chunk))
        shard = plan.shard(word, key)
        order = np.lexsort((key, word, shard))
        rows = list(_dealt(shard[order], word[order], key[order], number[doc[order]], times[order], chunk[by_chunk], index[by_chunk], train[by_chunk]))
        return pa.table({"place": pa.array([s for s, _ in rows], pa.int64()), "team": pa.array([team] * len(rows), pa.int64()), "payload": pa.array([p for _, p in rows], pa.binary())})

    return split


class _Shard:
    """Counts of one shard over all its payloads."""

    def __init__(self, payloads: list[bytes], total: float, plan: Plan, concentration: Concentration):
        self.z, self.k = total, concentration
        self.parts = [_Part(p) for p in payloads]
        sums = [np.bincount(np.repeat(np.arange(len(p.key)), p.per_pair), weights=p.train[p.doc] * p.times, minlength=len(p.key)) for p in self.parts]
        self.words, at = np.unique(np.concatenate([p.pair_word for p in self.parts]), return_inverse=True)
        self.pairs, self.pair_of = np.unique((at.astype(np.uint64) << np.uint64(KEY_BITS)) | np.concatenate([p.key for p in self.parts]), return_inverse=True)
        self.pair_n = np.bincount(self.pair_of, weights=np.concatenate(sums), minlength=len(self.pairs))
        self.owner = (self.pairs >> np.uint64(KEY_BITS)).astype(np.int64)
        self.word_n = np.bincount(self.owner, weights=self.pair_n, minlength=len(self.words))
        _, own, known = np.intersect1d(self.words, plan.keys, assume_unique=True, return_indices=True)
        self.word_n[own] = plan.counts[known]

    def trie(self) -> Trie:
        """Words seen in training and their contexts seen in training: log10 p1, log10(c + K), and log10(c(v w) + K(v) p1)."""
        known = np.flatnonzero(self.word_n > 0)
        rank = np.full(len(self.words), -1)
        rank[known] = np.arange(len(known))
        own = np.flatnonzero(self.pair_n > 0)
        c, p1 = self.word_n[known], (self.word_n + 0.1) / self.z
        return Trie.build(self.words[known], [np.log10(p1[known]), np.log10(c + self.k.of(self.words[known]))], rank[self.owner[own]], self.pairs[own] & np.uint64((1 << KEY_BITS) - 1), np.log10(self.pair_n[own] + self.k.of(self.pairs[own]) * p1[self.owner[own]]))

    def answers(self, trie: Trie):
        """For each payload: documents, and sums of known tokens, of log10(c + 0.1), and of the model's parts."""
        rank, there = trie.find(self.words)
        p1 = trie._value(0, rank, there, np.full(len(rank), np.log10(0.1 / self.z)))
        context = trie._value(1, rank, there, np.log10(self.k.of(self.words)))
        context[self.words == np.uint64(END)] = 0.0
        model = np.empty(len(self.pairs))
        for at in range(0, len(self.pairs), LOOKUP_ROWS):
            own = slice(at, at + LOOKUP_ROWS)
            o = self.owner[own]
            place, found = trie.find_children(rank[o], there[o], self.pairs[own] & np.uint64((1 << KEY_BITS) - 1))
            model[own] = trie._value(2, place, found, np.log10(self.k.of(self.pairs[own])) + p1[o]) - context[o]
        base, known, at = np.log10(self.word_n + 0.1), self.word_n > 0, 0
        none = [np.zeros(0, dtype=k) for k in ANSWER[6:]]
        for p in self.parts:
            pair = np.repeat(self.pair_of[at : at + len(p.key)], p.per_pair)
            at += len(p.key)
            o = self.owner[pair]
            add = lambda x, p=p: np.bincount(p.doc, weights=p.times * x, minlength=len(p.index))
            yield _pack(p.chunks, p.chunk_docs, p.index, add(known[o]).astype("<u4"), add(base[o]), add(model[pair]), *none)


def _answer(total: float, plan: Plan, concentration: Concentration):
    def answer(table: pa.Table) -> pa.Table:
        place, payloads = table.column("place")[0].as_py(), table.column("payload")
        if place >= 0:
            shard = _Shard(payloads.to_pylist(), total, plan, concentration)
            with tempfile.TemporaryFile() as f:
                f.write(shard.trie().to_bytes())
                f.flush()
                payloads = pa.array(list(shard.answers(Trie.mapped(np.memmap(f, dtype=np.uint8, mode="r")))), pa.binary())
            place //= plan.width
        return pa.table({"team": table.column("team"), "place": pa.array([place] * table.num_rows, pa.int64()), "payload": payloads})

    return answer


def _sums(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Chunk and number of the documents in these answers, sorted, with the sums of each value."""
    parts = [_unpack(p, *ANSWER)[:6] for p in payloads]
    chunk, index, *values = (np.concatenate(a) for a in zip(*((np.repeat(chunks, n), *rest) for chunks, n, *rest in parts), strict=True))
    order = np.lexsort((index, chunk))
    chunk, index = chunk[order], index[order]
    first = np.flatnonzero(np.r_[True, (chunk[1:] != chunk[:-1]) | (index[1:] != index[:-1])]) if len(chunk) else np.zeros(0, dtype=np.int64)
    return chunk[first], index[first], [np.add.reduceat(v[order], first) if len(first) else v for v in values]


def _join(table: pa.Table) -> pa.Table:
    """A team's answers from one range, added up and given back to each chunk."""
    payloads = table.column("payload").to_pylist()
    if (place := table.column("place")[0].as_py()) < 0:
        return pa.table({"chunk": pa.array([-1 - place], pa.int64()), "payload": pa.array(payloads, pa.binary())})
    chunk, index, values = _sums(payloads)
    chunks, begins = np.unique(chunk, return_index=True)
    none = [np.zeros(0, dtype=k) for k in ANSWER[6:]]
    out = [_pack(chunk[a : a + 1], np.array([b - a], dtype="<u4"), index[a:b], values[0][a:b].astype("<u4"), values[1][a:b], values[2][a:b], *none) for a, b in zip(begins, np.r_[begins[1:], len(chunk)], strict=True)]
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "payload": pa.array(out, pa.binary())})


def _gather(table: pa.Table) -> pa.Table:
    payloads = table.column("payload").to_pylist()
    named, ids, sizes = next(home for p in payloads if len((home := _unpack(p, *ANSWER)[6:])[2]))
    _, index, values = _sums(payloads)
    known, base, model = (np.zeros(len(sizes)) for _ in range(3))
    for out, v in zip((known, base, model), values, strict=True):
        out[index] = v
    return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=named == 0), "n_tokens": sizes.astype(np.int64), "n_known": known.astype(np.int64), "base": base, "model": model})


def _sent(rows: DataFrame, plan: Plan) -> DataFrame:
    """place (shard), team and payload: what chunks send to shards, through ranges if there are many."""
    sent = rows.mapInArrow(_send(plan), SENT)
    return sent.groupBy("place", "team").applyInArrow(_split(plan), SENT) if plan.two_levels else sent


def _prepared(docs: DataFrame, shard_tokens: int, constant: float | None, fan: int):
    """Rows with their train flag; N, V, plan of shards, and contexts' concentrations."""
    rows = docs.select(F.col("doc_id").cast("long"), (id_remainder("doc_id", 10) != 0).alias("train"), "text")
    counts = stash(token_counts(rows))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-n // shard_tokens))
    frequent = {r.token & (2**64 - 1): r.n for r in counts.where((F.col("n") * (2 * shards) > n) & (F.col("n") * HEAD >= n)).collect()}
    head = {r.token & (2**64 - 1): r.n for r in counts.where(F.col("n") * HEAD >= n).collect()} if constant is None else {}
    return rows, n, v, Plan(shards, frequent, fan), Concentration(head, n, constant)


def shard_tries(docs: DataFrame, constant: float | None = None, shard_tokens: int = SHARD_TOKENS, fan: int = FAN) -> DataFrame:
    """shard and trie (bytes for `Trie.mapped`, or for a file to map): the model of docs' training rows. A constant is the
    concentration of every context."""
    rows, n, v, plan, concentration = _prepared(docs, shard_tokens, constant, fan)
    total = n + 0.1 * (v + 1)

    def build(table: pa.Table) -> pa.Table:
        trie = _Shard(table.column("payload").to_pylist(), total, plan, concentration).trie().to_bytes()
        return pa.table({"shard": table.column("place")[:1], "trie": pa.array([trie], pa.binary())})

    return _sent(rows, plan).where("place >= 0").groupBy("place").applyInArrow(build, "shard long, trie binary")


def score_texts(docs: DataFrame, constant: float | None = None, shard_tokens: int = SHARD_TOKENS, fan: int = FAN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row, over its whole text.

    Rows with crc32(doc_id as text) mod 10 = 0 are held out: the model never counts them. score is the model's log10 probability
    of the text with its end; a constant is the concentration of every context. A null text counts as empty: one token, its end. Null and repeated doc_ids keep their rows; without
    training rows all counts are 0. An empty table gives no rows; further columns are ignored.
    """
    rows, n, v, plan, concentration = _prepared(docs, shard_tokens, constant, fan)
    total = n + 0.1 * (v + 1)
    answers = _sent(rows, plan).groupBy("place").applyInArrow(_answer(total, plan, concentration), ANSWERED)
    # without ranges a chunk is a team of its own, and its answers have only to be gathered
    joined = answers.groupBy("team", "place").applyInArrow(_join, "chunk long, payload binary") if plan.two_levels else answers.select(F.col("team").alias("chunk"), "payload")
    sums = joined.groupBy("chunk").applyInArrow(_gather, "doc_id long, n_tokens long, n_known long, base double, model double")
    texts = rows.where("train").count()
    base = F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(total)))
    score = F.col("model") - F.lit(float(np.log10(texts + concentration.of(np.array([START], dtype=np.uint64))[0])))
    return sums.select("doc_id", (id_remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
