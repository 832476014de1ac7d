"""Vectors that do not fit a code of 64 bits."""

from __future__ import annotations

import pytest

from dendrolith.llm import hamming_search


def test_wide_vectors_are_rejected(spark, tmp_path):
    rows = [(0, [1.0] * 64 + [-1.0]), (1, [1.0] * 65)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    with pytest.raises(Exception, match="over 64 components"):
        hamming_search.op4_multi_index_search(spark, str(tmp_path)).collect()
