import pytest

from tests.llm import data


@pytest.fixture(scope="session")
def small(spark, tmp_path_factory):
    """Folder with the awkward documents."""
    return data.write(spark, tmp_path_factory.mktemp("small"), data.documents())


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return data.write(spark, tmp_path_factory.mktemp("empty"), [], [], parts=1)


@pytest.fixture(scope="session")
def table(spark, small):
    """The rows (doc_id, text, lang, source) in the order in which Spark numbers them."""
    from pyspark.sql import functions as F
    rows = spark.read.parquet(f"{small}/documents.parquet").withColumn("nr", F.monotonically_increasing_id())
    return [tuple(r) for r in rows.orderBy("nr").select("doc_id", "text", "lang", "source").collect()]
