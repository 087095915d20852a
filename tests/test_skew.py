"""All ordered metrics with keys cut into many slices, against the SQL oracle.

The table is the test table with a third of its events given to one user.
"""

import inspect

import pytest

from tests.oracle_check import connect, differences
from workload.oracle import SQL
from workload.queries import METRICS, comparable, metric

SOURCE = "/root/testdata/sf0.001/events.parquet"
CUTTING = [
    name for name, (op, *_) in METRICS.items() if "max_rows" in inspect.signature(op).parameters
]


@pytest.fixture(scope="module")
def hot_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("hot")
    events = spark.read.parquet(SOURCE)
    user = "if(event_id % 3 = 0, bigint(7), user_id) as user_id"
    hot = events.selectExpr("event_id", "ts", user, "event_type", "value", "props")
    hot.write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", CUTTING)
def test_cut_keys_give_the_same_answer(spark, hot_dir, name):
    query = comparable(name, metric(name, max_rows=30))
    assert differences(query(spark, hot_dir), connect(hot_dir), SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(METRICS) - set(CUTTING)))
def test_other_metrics_on_the_hot_table(spark, hot_dir, name):
    query = comparable(name, metric(name))
    assert differences(query(spark, hot_dir), connect(hot_dir), SQL[name]) == []
