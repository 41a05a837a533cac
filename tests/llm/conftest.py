"""Small frames of documents."""

from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from texts, or from (doc_id, text, lang, source) tuples."""

    def build(rows, parts: int = 3):
        full = []
        for i, row in enumerate(rows):
            ident, text, lang, source = row if isinstance(row, tuple) else (i, row, "en", "a")
            full.append((ident, text, lang, source, len(text) if text is not None else None))
        return spark.createDataFrame(full, DOCS).repartition(parts) if full else spark.createDataFrame([], DOCS)

    return build


@pytest.fixture
def on_disk(spark, tmp_path):
    """A frame written as the documents of a folder; returns the folder."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
