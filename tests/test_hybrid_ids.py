"""The text side of the hybrid queries reads every document, whatever its id."""

import pytest

from skein.queries import catalog


@pytest.mark.parametrize("name", ["hybrid_linear", "hybrid_rrf"])
def test_large_doc_ids(name, spark, tmp_path):
    big = 10**12
    spark.createDataFrame([(i, [float(i + 1), 1.0], 0) for i in range(5)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(big, "of the of the"), (big + 1, "the other one")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert big in {r["id"] for r in catalog()[name][0](spark, str(tmp_path)).collect()}
