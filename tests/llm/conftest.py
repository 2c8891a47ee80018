import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents of the given texts, numbered from 0, or of (id, text) pairs."""

    def make(rows, extra: str = ""):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        schema = "doc_id long, text string" + (", " + extra if extra else "")
        width = len(T.StructType.fromDDL(schema)) - 2
        return spark.createDataFrame([r + (None,) * width for r in rows], schema)

    return make
