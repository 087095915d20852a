import pytest

import __spark_entry__ as contract
import corpus_pipeline
from playtrace.llm.oracle import SQL
from playtrace.llm.queries import QUERIES
from tests.oracle_check import connect, differences

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), connect(SF_DIR), SQL[name]) == []


def test_all_are_registered():
    names = {n.split("_")[0] for n in contract.queries() if n.startswith("op")}
    assert names == {f"op{i}" for i in range(1, 14)} and "pipeline" in contract.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "near_duplicates", "substring_dedup", "benchmark_decontamination", "source_mixing"
    ]


def test_pipeline_on_edges(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(60))
    item = " ".join(f"b{i}" for i in range(30))
    base = " ".join(f"u{i}" for i in range(100))
    other = " ".join(f"v{i}" for i in range(50))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [
        (1, base, "en", "s", 1), (2, base + " end", "en", "s", 1), (3, "one " + passage, "en", None, 1),
        (4, passage + " " + other, "en", "s", 1), (5, "x " + item + " y", "en", "t", 1), (6, "123 456", "en", "t", 1),
        (7, None, None, "t", None), (8, "", "en", "t", 0), (9, "plain words here", "en", "t", 1),
        (9, "plain words here", "en", "t", 1), (None, "no id at all", "en", "t", 1),
    ]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    bench = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, str(tmp_path)))
        seen[name] = docs.collect()
        if name != "source_mixing":
            assert docs.dtypes == spark.read.parquet(f"{tmp_path}/documents.parquet").dtypes

    def ids(name):
        return sorted((r.doc_id for r in seen[name]), key=str)

    assert ids("language_id") == [1, 2, 3, 4, 5, 9, 9, None]
    assert ids("near_duplicates") == [1, 3, 4, 5, 9, None]
    texts = {r.doc_id: r.text for r in seen["substring_dedup"]}
    assert texts[4] == other and texts[3] == "one " + passage
    assert ids("benchmark_decontamination") == [1, 3, 4, 9, None]
    assert ids("source_mixing") == [1, 3, 4, 9, None]


def test_pipeline_on_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
