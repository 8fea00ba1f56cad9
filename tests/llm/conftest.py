import pyarrow as pa
import pyarrow.parquet as pq
import pytest

EXTRA = {
    "ids": pa.int32(),
    "hits": pa.string(),
    "score": pa.string(),
    "shard": pa.string(),
    "n": pa.int64(),
    "key": pa.string(),
    "label": pa.string(),
    "component": pa.string(),
}


@pytest.fixture
def documents(spark, tmp_path_factory):
    """Rows (doc_id, text) as a scanned table of two files, with clashing extra columns if asked."""

    def build(rows, extra=False):
        folder = tmp_path_factory.mktemp("documents")
        names = ["doc_id", "text", *(EXTRA if extra else ())]
        kinds = [pa.int64(), pa.string(), *(EXTRA.values() if extra else ())]
        half = len(rows) // 2
        for k, some in enumerate((rows[:half], rows[half:])):
            columns = [pa.array([r[c] for r in some], kinds[c]) for c in (0, 1)]
            columns += [pa.nulls(len(some), t) for t in kinds[2:]]
            table = pa.Table.from_arrays(columns, names=names)
            pq.write_table(table, folder / f"part-{k}.parquet")
        return spark.read.parquet(str(folder))

    return build


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"

