from __future__ import annotations

import pytest

#: Names that operators use inside; a table may have columns of the same names.
CLASHES = ["_id", "_text", "_key", "_h", "h", "w", "hw", "doc", "item", "node", "pos", "set_key", "bands", "kept", "keep_id", "n_tokens", "score", "text_sha256", "class_id", "source_id", "k", "grams", "lang_pred"]


@pytest.fixture(scope="session")
def documents(spark):
    """A frame of documents from (doc_id, text) pairs, with a language and columns of clashing names."""
    from pyspark.sql import functions as F

    def make(rows, langs=None):
        data = [(d, t, (langs or {}).get(d), "src0", len(t or "")) for d, t in rows]
        df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
        return df.withColumns({c: F.lit("clash") for c in CLASHES})

    return make


#: Nulls, empty and odd texts, ties, repeated rows, a very long text.
EDGES = [
    (1, None), (2, ""), (3, "   "), (4, "!!! ... ---"), (5, "one"), (6, "one"), (6, "one"), (None, "no id here at all"), (7, "a b"),
    (8, "The quick brown fox jumps over the lazy dog again and again"), (9, "naïve café 東京 😀 ‘quoted’ it's we'll"), (10, "x" * 50_000), (11, "word " * 30_000), (12, "\n\n\t   end\n"),
]


@pytest.fixture(scope="session")
def edges():
    return EDGES
