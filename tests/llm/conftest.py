import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    def go(rows, schema=DOCS):
        width = len(T._parse_datatype_string(schema).fields)
        return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)

    return go
