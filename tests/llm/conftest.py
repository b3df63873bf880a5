import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, uid long, bucket string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents with nulls, repeated rows and further columns whose names operators use themselves."""

    def build(rows, partitions=3):
        full = [(i, t, None if (i or 0) % 3 == 0 else "en", "hot", None if t is None else len(t), "k", 1, "b") for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return build
