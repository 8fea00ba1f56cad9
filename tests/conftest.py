import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from patronage.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        {
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Build a frame from rows of text; `ts` columns are parsed, `money` is cents-exact."""

    def build(schema: str, rows):
        from pyspark.sql import functions as F

        names = [part.split()[0] for part in schema.split(",")]
        kinds = [part.split()[1] for part in schema.split(",")]
        text = spark.createDataFrame(
            [tuple(None if v is None else str(v) for v in row) for row in rows],
            ", ".join(f"{n} string" for n in names),
        )
        types = {"ts": "timestamp", "money": "decimal(18,2)"}
        return text.select(
            *(F.col(n).cast(types.get(k, k)).alias(n) for n, k in zip(names, kinds))
        )

    return build
