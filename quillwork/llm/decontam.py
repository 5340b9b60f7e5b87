"""Benchmark decontamination: windows of documents within a small edit distance of a benchmark item.

Words are the symbols. The CGK embedding walks a sequence: at step t it emits the current symbol and moves on if a random bit of
(t, symbol) says so, which maps a small edit distance to a small Hamming distance. A document window is embedded from its start
with the same bits as the items, and bit-sampling LSH buckets it by a few sampled steps. Repetitions with fresh bits are added
until the recall measured on edited copies of the items reaches the target. What shares a bucket is verified by exact edit
distance.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_rows, small

EDITS = 0.2
BITS = 2
RECALL = 0.98
#: Tables of a class after which a target that is still not reached is an error, not a reason to add more.
MOST_TABLES = 500
#: Edited copies of a class's items on which its recall is measured, at least.
TRIALS = 400
#: Items that one pass over the documents carries; more items take more passes, in blocks by a hash of the item.
BLOCK_ITEMS = 20_000
EDGES = re.compile(rb"^[^0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff]+$")


def normal_words(text: bytes | None) -> list[bytes]:
    """Words in lower case (A-Z) without punctuation at their ends; words of nothing else are left out."""
    return [w for x in (text or b"").lower().split() if (w := x if x.isalnum() else EDGES.sub(b"", x))]


def prefix_distance(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int] | None:
    """The least edit distance of item to a prefix of text, and that prefix's length (the shortest), if at most `most`."""
    columns = np.arange(len(text) + 1)
    row = columns.copy()
    for i, symbol in enumerate(item, 1):
        step = np.empty_like(row)
        step[0] = i
        np.minimum(row[1:] + 1, row[:-1] + (text != symbol), out=step[1:])
        # insertions: the running minimum of step[j] - j, plus j
        row = np.minimum.accumulate(step - columns) + columns
        if row.min() > most:
            return None
    end = int(row.argmin())
    return (int(row[end]), end) if row[end] <= most else None


class Vocabulary(dict):
    """Symbols of raw words: 0 for words that no item has, -1 for words of punctuation alone. New words are looked up once."""

    def __init__(self, normal: dict[bytes, int]):
        super().__init__()
        self.normal = normal

    def __missing__(self, raw: bytes) -> int:
        found = normal_words(raw)
        symbol = self.normal.get(found[0], 0) if found else -1
        if len(self) < 500_000:
            self[raw] = symbol
        return symbol


class Index:
    """LSH tables of a block of items, by classes of similar length.

    A table has the items' keys: their CGK walks at a few sampled steps. A window of a class's size is walked with the table's
    bits and looked up by its key; windows that share a key with an item in any of the class's tables are verified against it.
    Tables are added until the share of edited copies of items that some table finds reaches `recall`; `recalls` tells what each
    class got.

    With `spare`, windows are walked only where they can match some item of the class at all. Of an item's k + 1 equal pieces, k
    edits leave one whole, so a window within k edits starts at most k words from where a piece that the text contains says, and
    it must have enough words of items. Both tests lose no match and name no item. Without it every window is walked.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], edits: float = EDITS, bits: int = BITS, recall: float = RECALL, spare: bool = True, seed: int = 11):
        items = sorted((i, w) for i, w in items if w)
        self.edits, self.bits, self.spare, self.rng = edits, bits, spare, np.random.default_rng(seed)
        self.normal = {w: k for k, w in enumerate(sorted({w for _, words in items for w in words}), 1)}
        self.ids = [i for i, _ in items]
        self.items = [np.array([self.normal[w] for w in words], dtype=np.int32) for _, words in items]
        # 0 stands for any word that no item has, the last symbol for the end of a text
        self.end = len(self.normal) + 1
        self.symbols = self.rng.integers(1, 2**63, self.end + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        groups: list[list[int]] = []
        for k in sorted(range(len(items)), key=lambda k: (len(self.items[k]), k)):
            if not groups or len(self.items[k]) > 1.25 * len(self.items[groups[-1][0]]):
                groups.append([])
            groups[-1].append(k)
        self.classes, self.recalls = [], []
        #: By length of pieces: where pieces with a hash stand in a class's items, each place once however many items have it.
        places: dict[int, dict[int, set[tuple[int, int, int]]]] = defaultdict(lambda: defaultdict(set))
        for number, group in enumerate(groups):
            short = len(self.items[group[0]])
            needed = short - int(edits * short)
            # steps whose place in the text is, as a rule, before the end of every item of the class; where no edit is allowed a
            # copy has to get the item's key for sure, and a walk of fewer steps than words cannot pass the end
            c = {"items": group, "steps": max(bits, 2 * needed - 2) if needed < short else short, "tables": []}
            c["most"] = max(map(self._most, group))
            c["least"], c["size"] = min(len(self.items[k]) - self._most(k) for k in group), max(len(self.items[k]) + self._most(k) for k in group)
            self.recalls.append(self._fill(c, random.Random(seed + number), recall))
            self.classes.append(c)
            for k in group:
                item = self.items[k]
                cuts = np.linspace(0, len(item), self._most(k) + 2).astype(int)
                for o, e in zip(cuts[:-1], cuts[1:], strict=True):
                    places[int(e - o)][int(self._grams(item[o:e], int(e - o))[0])].add((number, int(o), self._most(k)))
        #: By length: sorted hashes of pieces, and for each hash its (class, offset, edits) rows from a start on.
        self.pieces = []
        for size, found in sorted(places.items()):
            keys = np.array(sorted(found), dtype=np.uint64)
            rows = [sorted(found[int(h)]) for h in keys]
            self.pieces.append((size, keys, np.cumsum([0] + [len(r) for r in rows]), np.array([x for r in rows for x in r], dtype=np.int64).reshape(-1, 3)))
        self.rng = None

    def _most(self, k: int) -> int:
        return int(self.edits * len(self.items[k]))

    def _grams(self, sequence: np.ndarray, size: int) -> np.ndarray:
        """A hash of each run of `size` symbols."""
        n = len(sequence) - size + 1
        out = np.zeros(max(0, n), dtype=np.uint64)
        for j in range(size if n > 0 else 0):
            out = (out ^ self.symbols[sequence[j : j + n]]) * np.uint64(0x9E3779B97F4A7C15)
        return out

    def _draw(self, c: dict) -> tuple[np.ndarray, np.ndarray]:
        """Multipliers of the random bits of each step, and the sampled steps."""
        steps = np.sort(self.rng.choice(c["steps"], min(self.bits, c["steps"]), replace=False))
        return self.rng.integers(1, 2**63, int(steps[-1]) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1), steps

    def walk(self, sequence: np.ndarray, starts: np.ndarray, multipliers: np.ndarray, steps: np.ndarray, known: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Keys after each sampled step (rows) of the walk from each start, and the numbers of the starts. With the known keys of
        each sampled step, sorted, starts whose key nobody has are dropped on the way. A walk stays at the end of its text."""
        at, key, sampled = starts.copy(), np.zeros(len(starts), dtype=np.uint64), 0
        left, keys = np.arange(len(starts)), []
        for t, m in enumerate(multipliers):
            here = sequence[at]
            symbol = self.symbols[here]
            if t == steps[sampled]:
                key = (key ^ symbol) * np.uint64(0x9E3779B97F4A7C15)
                if known is None:
                    keys.append(key)
                else:
                    own = known[sampled]
                    keep = own[np.minimum(np.searchsorted(own, key), len(own) - 1)] == key
                    left, at, key, symbol, here = left[keep], at[keep], key[keep], symbol[keep], here[keep]
                    if not len(left):
                        break
                sampled += 1
            at += ((symbol * m) >> np.uint64(63)).astype(at.dtype) * (here != self.end)
        return np.array(keys) if known is None else key, left

    def _sequence(self, words: np.ndarray) -> np.ndarray:
        return np.append(words, self.end).astype(np.int32)

    def _keys(self, sequences: list[np.ndarray], table: dict) -> np.ndarray:
        """The keys after each sampled step (rows) of whole sequences."""
        whole = np.concatenate([self._sequence(x) for x in sequences])
        sizes = np.array([len(x) + 1 for x in sequences])
        return self.walk(whole, np.cumsum(sizes) - sizes, table["multipliers"], table["steps"])[0]

    def _fill(self, c: dict, rng: random.Random, recall: float) -> float:
        """Adds tables to a class until they find the share `recall` of copies with the most edits allowed; returns the share.
        Raises ValueError with the share found if MOST_TABLES do not reach it."""
        originals, copies = [], []
        for n in range(max(TRIALS, len(c["items"]))):
            item = self.items[c["items"][n % len(c["items"])]]
            copy = list(item)
            for _ in range(int(self.edits * len(item))):
                k, kind = rng.randrange(len(copy)), rng.randrange(3)
                copy[k : k + 1] = [[0], [], [0, copy[k]]][kind]
                copy = copy or [0]
            originals.append(item)
            copies.append(np.array(copy))
        found = np.zeros(len(copies), dtype=bool)
        while not c["tables"] or found.mean() < recall:
            if len(c["tables"]) >= MOST_TABLES:
                raise ValueError(f"{MOST_TABLES} tables find {found.mean():.3f} of edited copies of items of {len(self.items[c['items'][0]])} words and more, not {recall}: lower bits, edits or recall")
            multipliers, steps = self._draw(c)
            table = {"multipliers": multipliers, "steps": steps}
            keys = self._keys([self.items[k] for k in c["items"]], table)
            order = np.argsort(keys[-1], kind="stable")
            table |= {"known": [np.unique(row) for row in keys], "keys": keys[-1][order], "items": np.array(c["items"])[order]}
            c["tables"].append(table)
            a, b = (self._keys(x, table)[-1] for x in (originals, copies))
            found |= a == b
        return float(found.mean())

    def _windows(self, words: np.ndarray, first: np.ndarray, last: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and classes of the windows to walk; first, last: the bounds of each position's text."""
        starts, classes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        if not self.spare:
            own = np.flatnonzero(np.arange(len(words)) < last)
            starts, classes = [np.tile(own, len(self.classes))], [np.repeat(np.arange(len(self.classes)), len(own))]
        for size, keys, begins, rows in self.pieces if self.spare else ():
            # only runs of words that items have
            at = np.flatnonzero(total[size:] - total[:-size] == size) if len(words) >= size else np.zeros(0, dtype=np.int64)
            if not len(at):
                continue
            h = self._grams(words, size)[at]
            found = np.searchsorted(keys, h)
            hit = keys[np.minimum(found, len(keys) - 1)] == h
            at, found = at[hit], found[hit]
            n = begins[found + 1] - begins[found]
            at, row = np.repeat(at, n), np.repeat(begins[found], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            number, offset, most = rows[row].T
            n = 2 * most + 1
            shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) - np.repeat(most, n)
            start, number, at = np.repeat(at - offset, n) + shift, np.repeat(number, n), np.repeat(at, n)
            keep = (start >= first[at]) & (start < last[at])
            starts.append(start[keep])
            classes.append(number[keep])
        start, number = np.divmod(np.unique(np.concatenate(starts) * len(self.classes) + np.concatenate(classes)), len(self.classes))
        if self.spare and len(start):
            size, least = (np.array([c[k] for c in self.classes])[number] for k in ("size", "least"))
            enough = total[np.minimum(start + size, last[start])] - total[start] >= least
            start, number = start[enough], number[enough]
        return start, number

    def match_many(self, texts: list[bytes | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item_id, first word, end word, distance): the best window of each item that the whole text contains."""
        # kept by the worker from one batch to the next
        known = self.__dict__.setdefault("known", Vocabulary(self.normal))
        out: list[list[tuple[int, int, int, int]]] = []
        held, size = [], 0
        for text in texts:
            words = np.fromiter(map(known.__getitem__, (text or b"").lower().split()), dtype=np.int32)
            held.append(words[words >= 0])
            size += len(words)
            if size > 1_000_000:
                out += self._match(held)
                held, size = [], 0
        return out + self._match(held)

    def _match(self, texts: list[np.ndarray]) -> list[list[tuple[int, int, int, int]]]:
        if not texts or not self.items:
            return [[] for _ in texts]
        # texts one after another, each with an end symbol
        sizes = np.array([len(t) + 1 for t in texts])
        begins = np.cumsum(sizes) - sizes
        sequence = np.concatenate([self._sequence(t) for t in texts])
        owner = np.repeat(np.arange(len(texts)), sizes)
        first, last = begins[owner], (begins + sizes - 1)[owner]
        total = np.concatenate([[0], np.cumsum((sequence > 0) & (sequence < self.end))])
        starts, numbers = self._windows(sequence, first, last, total)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for number, c in enumerate(self.classes):
            own, pairs = starts[numbers == number], [np.zeros(0, dtype=np.int64)]
            for t in c["tables"]:
                key, left = self.walk(sequence, own, t["multipliers"], t["steps"], t["known"])
                # all items of the window's bucket
                lo, hi = np.searchsorted(t["keys"], key), np.searchsorted(t["keys"], key, side="right")
                n = hi - lo
                item = t["items"][np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                pairs.append(np.unique(np.repeat(own[left], n) * len(self.items) + item))
            for s, k in zip(*(x.tolist() for x in np.divmod(np.unique(np.concatenate(pairs)), len(self.items))), strict=True):
                item, doc, most = self.items[k], int(owner[s]), self._most(k)
                if best.get((doc, k), (1,))[0] == 0:
                    continue
                window = sequence[s : min(s + len(item) + most, int(last[s]))]
                if int((window > 0).sum()) >= len(item) - most and (d := prefix_distance(item, window, most)) is not None:
                    found = (d[0], s - int(begins[doc]), s - int(begins[doc]) + d[1])
                    best[doc, k] = min(best.get((doc, k), found), found)
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        for (doc, k), (d, s, e) in sorted(best.items()):
            out[doc].append((self.ids[k], s, e, d))
        return out

    def matches(self, text: bytes | None) -> list[tuple[int, int, int, int]]:
        return self.match_many([text])[0]


def indexes(items: DataFrame, edits: float = EDITS, bits: int = BITS, recall: float = RECALL, block_items: int = BLOCK_ITEMS, spare: bool = True):
    """One index for each block of items (item_id, text): the number of items is counted first, a block is collected at a time."""
    named = items.where("item_id is not null").select(F.col("item_id").cast("long"), F.col("text"))
    blocks = max(1, -(-named.count() // block_items))
    for block in range(blocks):
        own = named.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        yield Index([(r.item_id, normal_words(r.text.encode()) if r.text else []) for r in own], edits, bits, recall, spare)


def find_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, first_word, end_word, distance: for each row of docs, each item with a window of the text within
    floor(edits * item words) word edits, with its best window (least distance, then first). Words are those of `normal_words`.

    Items without words and with a null id never match; equal items match alike. Null and empty texts have no match; repeated
    rows are reported each; null doc_ids are reported as null. Empty tables give no rows; further columns are ignored.
    """
    out = None
    for index in indexes(items, **options):

        def find(batches, index=index):
            for batch in small(batches, 2048):
                found = index.match_many(batch.column(1).cast(pa.binary()).to_pylist())
                rows = [(d, *m) for d, own in zip(batch.column(0).to_pylist(), found, strict=True) for m in own]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], ["doc_id", "item_id", "first_word", "end_word", "distance"])

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, "doc_id long, item_id long, first_word long, end_word long, distance long")
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs, whole, that contain no item in the sense of `find_leaks`. Rows with null or empty texts stay, as do all
    rows where items is empty; repeated rows and null doc_ids are each judged by their text; columns may have any name and type."""
    kept = as_rows(docs)
    for index in indexes(items, **options):

        def keep(batches, index=index):
            for batch in small(batches, 2048):
                yield batch.filter(pa.array([not m for m in index.match_many(batch.column(0).field("text").cast(pa.binary()).to_pylist())], pa.bool_()))

        kept = kept.mapInArrow(keep, kept.schema)
    return kept.select("row.*")
