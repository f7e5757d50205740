import pytest
import pyarrow  # noqa: F401


@pytest.fixture()
def stored(spark, tmp_path_factory):
    """Writes rows as a table of several files and reads it back, as row keys need a stored table."""
    def store(rows, schema="doc_id long, text string, _row_key string, name string", files=3):
        path = str(tmp_path_factory.mktemp("tables") / "t")
        width = len(schema.split(","))
        full = [tuple(row) + ("x",) * (width - len(row)) for row in rows]
        spark.createDataFrame(full, schema).repartition(files).write.parquet(path)
        return spark.read.parquet(path)
    return store
