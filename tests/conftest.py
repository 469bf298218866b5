import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def data():
    return DATA


def rough(tmp: Path, rows: int | None = None) -> str:
    """The smallest tables with a row of nulls, every row's copies, and extra columns with clashing names."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    extra = ("key", "name", "id", "rep", "path_", "levels", "n_tokens", "seconds", "label", "k", "value", "t", "main", "items", "status", "at", "g", "s")
    for p in Path(DATA).glob("*.parquet"):
        t = pq.read_table(p)
        t = t.slice(0, rows) if rows is not None else t
        if rows != 0 and p.stem not in ("mix_targets", "pack_targets", "task_prompts"):
            t = pa.concat_tables([t, pa.table({f.name: pa.nulls(2, f.type) for f in t.schema}, schema=t.schema), t.slice(0, 3)])
        for c in extra:
            if c not in t.column_names:
                t = t.append_column(c, pa.array(["x"] * t.num_rows, pa.string()))
        pq.write_table(t, tmp / p.name)
    return str(tmp)
