"""Tables for the corpus operators' edge cases, and a plain union-find."""

from __future__ import annotations

LONG = " ".join(f"word{i} stays{i % 977}" for i in range(20_000))
CLASH = ["uid", "name", "fp", "core", "shard", "place", "rate", "tile", "n", "_row", "_key", "block", "pos", "size"]
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          + ", ".join(f"`{c}` string" for c in CLASH))

#: (doc_id, text, lang, source)
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a"),
    (2, "the QUICK brown fox\njumps over the lazy dog again and again", "en", "a"),
    (3, "der schnelle braune Fuchs springt über den faulen Hund immer wieder", "de", None),
    (4, None, "en", "a"),
    (5, "", None, "b"),
    (6, " \t\r\n\x0b\x0c", "en", "b"),
    (7, "12 34 $$ %%", "en", "b"),
    (None, "a row without an id", "en", "c"),
    (None, None, None, None),
    (8, "a repeated row", "en", "a"),
    (8, "a repeated row", "en", "a"),
    (9, LONG, "en", "a"),
    (10, LONG + " end", "en", "b"),
    (11, "x", "en", "c"),
]


def edge_docs(spark, rows=None):
    rows = ROWS if rows is None else rows
    data = [(i, t, lang, src, None if t is None else len(t), *(["clash"] * len(CLASH))) for i, t, lang, src in rows]
    return spark.createDataFrame(data, SCHEMA)


def simple_docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)],
                                 "doc_id bigint, text string, lang string, source string")


def classes(n, linked):
    """The smallest index reachable from each of ``range(n)``."""
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return [root(i) for i in range(n)]
