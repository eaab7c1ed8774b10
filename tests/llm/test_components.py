import pytest

from weirflow.llm.common import connected_components


def test_unfinished_components_are_an_error(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    assert {tuple(r) for r in connected_components(path, "a", "b").collect()} == {(k, 0) for k in range(41)}
    assert connected_components(path.limit(0), "a", "b").count() == 0
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        connected_components(path, "a", "b", max_rounds=1)
