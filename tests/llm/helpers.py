"""Small tables with the awkward rows that every operator has to take, and brute-force versions."""

import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


#: More names of inside columns, and a type that has no order.
CLASHES = ("9 as _first", "10 as _offset", "11 as _share", "12 as _slot", "13 as _start", "14 as _phase", "15 as _o", "'z' as mix_source", "16 as mix_block", "17 as mix_position", "18 as row", "19 as key", "20 as id", "21 as cut", "22 as cuts", "map('a', 1) as odd", "23 as `a.b`", "24 as h", "25 as r")


def docs(spark, rows, extra=False):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src1", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        # names that operators use inside, and some that they give out
        df = df.selectExpr("*", "1 as shard", "2 as fp", "'x' as score", "3 as tile", "4 as _n", "5 as component_id", "'y' as rule", "6 as _slice", "7 as mix_slot", "8 as n", *CLASHES)
    return df


AWKWARD = [(1, "plain words of some text here"), (2, None), (3, ""), (4, "word " * 30000), (5, "same text here twice"), (5, "same text here twice"), (6, "same text here twice"), (None, "text without an id"), (None, None), (7, " \t\n ")]


def minimal_components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def simhash(text, shingle=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or [b" ".join(w)]
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))
