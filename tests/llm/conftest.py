import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Make a table of documents from texts, or from (doc_id, text) or whole rows."""

    def make(*rows, extra=False):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            full.append(r if len(r) == 5 else (r[0], r[1], "en", f"s{i % 3}", len(r[1] or "")))
        df = spark.createDataFrame(full, DOCUMENTS)
        if extra:  # names that operators use themselves
            for name in ("size", "rank", "score", "key", "node", "bucket", "_row", "_bucket", "kept", "shard", "text_hash", "u", "v"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


@pytest.fixture
def rows():
    return lambda df, *cols: sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
