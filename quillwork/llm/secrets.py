"""Secret scans: single-pattern spans, and multipart credentials linked by an interval join within scopes.

Positions are code points, ends exclusive. Besides the base patterns, weak parts (an account name, a secret-like word, an
endpoint) are found but reported only where complementary parts co-occur in a scope: a text's parts at most `scope` code points
apart, none of them inside another. An identifier needs a secret, a secret an identifier, an endpoint a secret that has an
identifier. What stands in an address is no secret, but for a user's part before its @.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

SCOPE = 200
KINDS = ("assign", "access", "hex", "link_id", "link_secret", "link_endpoint")
ASSIGN = r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
#: The runs of [0-9a-f]+ that are long enough.
HEX = r"[0-9a-f]{24,}"
#: Patterns take time in proportion to the text: what may start anywhere in a run is tied to its start or bounded.
#: Weak parts: kind, what a text must contain (one of these, or a match) for a part to be there, and the pattern; group 1 is the part.
WEAK = [
    ("link_id", (":", "="), r"(?ai:(?:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._@-]{3,})"),
    ("link_id", ("@",), r"(?<![A-Za-z0-9._+-])([A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"),
    ("link_secret", (":", "="), r"(?ai:(?:pwd|pass|private_?key|credential|auth))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]{6,})"),
    ("link_secret", (), r"([A-Za-z0-9+/_-]{16,})"),
    ("link_endpoint", ("://",), r"([A-Za-z][A-Za-z0-9+.-]{0,19}://[^\s\"'<>]+)"),
    ("link_endpoint", re.compile(r"[0-9]\.[0-9]"), r"(?<![0-9.])((?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?)(?![0-9.])"),
    ("link_endpoint", (":", "="), r"(?ai:(?:host|endpoint|server))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9.-]+\.[A-Za-z]{2,}(?::[0-9]{1,5})?)"),
]


def _may_hold(text: str, needed) -> bool:
    if isinstance(needed, re.Pattern):
        return needed.search(text) is not None
    return not needed or any(x in text for x in needed)


def _secret_like(word: str) -> bool:
    """A long run counts as a secret only with letters and digits."""
    return any(c.isdigit() for c in word) and any(c.isalpha() for c in word)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's rank, end, kind) sorted by start and kind: leftmost non-overlapping matches of each kind that are long enough."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in re.finditer(ACCESS, text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(HEX, text)]
    return sorted(out)


class Spans:
    """Spans that can tell whether one of them meets another span."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts, self.ends = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))

    def meet(self, start: int, end: int) -> bool:
        n = bisect_left(self.starts, end)
        return n > 0 and self.ends[n - 1] > start


def weak_parts(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak parts outside base spans, as (start, kind's rank, end), each once. A word in an identifier or in an address, but for
    its user's part, is no secret, and a user's part with its host no identifier."""
    found: dict[str, set[tuple[int, int]]] = {k: set() for k in KINDS[3:]}
    taken = Spans([(s, e) for s, _, e in base])
    for kind, needed, pattern in WEAK:
        if not _may_hold(text, needed):
            continue
        for m in re.finditer(pattern, text):
            if (needed != () or _secret_like(m[1])) and not taken.meet(*m.span(1)):
                found[kind].add(m.span(1))
    if found["link_id"] or found["link_secret"]:
        addresses = Spans([x for x in found["link_endpoint"] if text.find("://", *x) >= 0])
        found["link_id"] = {x for x in found["link_id"] if text.find("@", *x) < 0 or not addresses.meet(*x)}
        closed = []
        for s, e in found["link_endpoint"]:
            at = text.find("://", s, e)
            user = re.compile(r"[^/?#]*@").match(text, at + 3, e) if at >= 0 else None
            closed.append((user.end() if user else s, e))
        apart = Spans([*found["link_id"], *closed])
        found["link_secret"] = {x for x in found["link_secret"] if not apart.meet(*x)}
    return sorted((s, KINDS.index(k), e) for k, spans in found.items() for s, e in spans)


def _digest(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCAN = "doc_id long, text_key long, n_assign long, n_access long, n_hex long, base_sha256 string, base string, parts array<struct<start:int,kind:int,end:int>>"


def _scan(batches):
    for batch in batches:
        rows = []
        for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            base = base_spans(text or "")
            weak = weak_parts(text or "", base)
            digest = _digest(base)
            parts = [{"start": s, "kind": k, "end": e} for s, k, e in sorted(base + weak)] if base or weak else []
            n = [sum(k == i for _, k, _ in base) for i in range(3)]
            rows.append((doc_id, key, *n, hashlib.sha256(digest.encode()).hexdigest(), digest, parts))
        names = ["doc_id", "text_key", "n_assign", "n_access", "n_hex", "base_sha256", "base", "parts"]
        part = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        types = [pa.int64()] * 5 + [pa.string()] * 2 + [part]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def scan(docs: DataFrame) -> DataFrame:
    """Base spans and all parts of each row's whole text; text_key tells texts with equal doc_ids apart."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(_scan, SCAN)


def near(left: DataFrame, right: DataFrame, scope: int) -> DataFrame:
    """Rows of left with a row of right beside it in the same text, at most `scope` code points apart: an interval semi-join on bins of
    `scope` code points, which returns a left row once, however many partners it has."""
    r = right.select(F.col("doc_id").alias("r_doc"), F.col("text_key").alias("r_key"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    # a part covers the bins from its start to its end; the left side looks `scope` further on both sides
    r = r.withColumn("r_bin", F.explode(F.expr(f"sequence(r_start div {scope}, r_end div {scope})")))
    l = left.withColumn("bin", F.explode(F.expr(f"sequence(greatest(start - {scope}, 0) div {scope}, (end + {scope}) div {scope})")))  # noqa: E741
    on = F.col("doc_id").eqNullSafe(F.col("r_doc")) & (F.col("text_key") == F.col("r_key")) & (F.col("bin") == F.col("r_bin"))
    gap = F.greatest(F.col("r_start") - F.col("end"), F.col("start") - F.col("r_end"))
    # spans that share characters are no two parts
    close = gap.between(0, scope)
    return l.join(r, on & close, "left_semi").drop("bin").distinct()


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked of every row, over whole texts.

    A null text counts as empty: no spans, the sha256 of the empty text. Null and repeated doc_ids keep their rows (rows with
    equal doc_id and text get equal results); an empty table gives none; further columns are ignored.
    """
    seen = stash(scan(docs))
    parts = seen.where(F.size("parts") > 1).select("doc_id", "text_key", F.explode("parts").alias("p")).select("doc_id", "text_key", "p.start", "p.kind", "p.end").distinct()
    ids = parts.where(F.col("kind").isin(1, 3))
    secrets = parts.where(F.col("kind").isin(0, 2, 4))
    linked_ids, linked_secrets = near(ids, secrets, scope), stash(near(secrets, ids, scope))
    ends = near(parts.where("kind = 5"), linked_secrets, scope)
    added = linked_ids.unionByName(linked_secrets).unionByName(ends).where("kind > 2")
    added = added.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    added = added.select(F.col("doc_id").alias("a_doc"), F.col("text_key").alias("a_key"), "added")
    on = F.col("doc_id").eqNullSafe(F.col("a_doc")) & (F.col("text_key") == F.col("a_key"))
    all_parts = F.array_sort(F.concat(F.filter("parts", lambda p: p["kind"] < 3), F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_join(F.transform(all_parts, lambda p: F.concat_ws(":", F.element_at(names, p["kind"] + 1), p["start"].cast("string"), p["end"].cast("string"))), ",")
    return seen.join(added, on, "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_linked"))
