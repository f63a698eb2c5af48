"""Rows keep all their columns where these carry the names that operators work with."""

import pytest
from pyspark.sql import functions as F

from episodica.llm import decontaminate, mixing, near_copies, pii, quality, resampling, simhash, suffix_dedup

NAMES = ["__row", "__id", "__no_id", "__hit", "__kept", "__text", "__cut", "__place", "__n", "place", "node", "root", "fp", "size", "spans2", "window", "item", "digest", "n_words", "failed", "score", "a.b", "u", "key"]


@pytest.fixture(scope="module")
def docs(spark):
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(k, f"{text} number{k % 3} {' '.join(f'own{k % 3}x{j}' for j in range(30))}", "en", f"s{k % 2}", 5) for k in range(6)] + [(None, text, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({n: F.lit(k) for k, n in enumerate(NAMES)})


@pytest.mark.parametrize(
    "operator",
    [
        near_copies.deduplicated,
        simhash.deduplicated,
        mixing.mixed_documents,
        suffix_dedup.with_spans,
        quality.filter_documents,
        pii.sanitised,
        lambda d: decontaminate.decontaminated(d, d.limit(0).select(F.col("doc_id").alias("item_id"), "text")),
        lambda d: resampling.resampled(d, d.select("text"), resampling.Resampling(percent=100)),
    ],
)
def test_columns_stay(docs, operator):
    out = operator(docs)
    assert [c for c in out.columns if c != "spans"] == docs.columns
    rows = out.collect()
    assert len(rows) >= 3
    assert all(r[n] == k for r in rows for k, n in enumerate(NAMES))
