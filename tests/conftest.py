import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    home = tmp_path_factory.mktemp("spark")
    made = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", f"{home}/warehouse")
        .config("spark.checkpoint.dir", f"file://{home}/shared")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    return int(v) if isinstance(v, float) and v.is_integer() else v


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Whether a query's rows are its SQL's rows, in any order."""

    def check(df, sql):
        cols = sorted(df.columns)
        ours = [tuple(_plain(r[c]) for c in cols) for r in df.select(*cols).collect()]
        relation = duck.sql(sql)
        assert sorted(relation.columns) == cols
        quoted = ", ".join(f'"{c}"' for c in cols)
        theirs = [tuple(_plain(v) for v in r) for r in duck.sql(f"SELECT {quoted} FROM ({sql})").fetchall()]
        assert sorted(map(repr, ours)) == sorted(map(repr, theirs))

    return check
