import pytest
from pyspark.sql import types as T

from fleetscope.llm.common import prepare
from fleetscope.workspace import Workspace

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                          T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                          T.StructField("n_chars", T.LongType())])


@pytest.fixture
def run(spark):
    prepare(spark)
    folder = Workspace(spark, "test")
    yield folder
    folder.release()


@pytest.fixture
def documents(spark):
    """Builds documents from (doc_id, text) or (doc_id, text, lang) rows."""
    prepare(spark)

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return build


@pytest.fixture(scope="module")
def small(spark):
    """(doc_id, text, lang) of the smallest documents table, by doc_id."""
    prepare(spark)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    return sorted((tuple(r) for r in rows), key=lambda r: r[0])
