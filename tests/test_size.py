"""What small tables on one machine do not show: executors with processes of their own, and buckets larger than a task should hold."""

import os
import re
import subprocess
import sys

import pytest
from conftest import ROOT, SF_DIR
from pyspark.sql import types as T

from mergelake.sources import bucketed
from mergelake.sources.datasource import TableSource
from mergelake.table import Table

APART = """
import os, sys
from pyspark.sql import SparkSession
import __spark_entry__
import mergelake.sources.scan as scan
scan.ROWS_AT_ONCE = 50
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "1g", "spark.ui.enabled": "false", "spark.checkpoint.dir": f"file://{os.getcwd()}/shared", "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "2"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
rows = {r["c_custkey"]: r["c_mktsegment"] for r in __spark_entry__.queries()["export_upserts"](spark, sys.argv[1]).collect()}
given = {r["c_custkey"]: r["c_mktsegment"] for r in spark.read.parquet(f"{sys.argv[1]}/customer.parquet").collect()}
assert rows == {-1: "theirs"} | {k: "moved" if k % 5 == 0 else v for k, v in given.items() if k % 7}
print("same rows")
"""


def test_embedded_databases_with_executors_apart(tmp_path):
    ran = subprocess.run([sys.executable, "-c", APART, SF_DIR], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=300)
    assert "same rows" in ran.stdout, ran.stderr[-3000:]


def _orders(spark, path, compacted: bool) -> Table:
    """Whole and partial upserts, or whole ones over a compacted base; keys are repeated within a commit."""
    rows = spark.range(0, 4000, 1, 4).selectExpr("id AS k", "string(id % 3) AS p", "id AS v", "'first' AS s")
    t = Table.create(spark, path, rows, ranges=["p"], keys=["k"], buckets=2)
    if compacted:
        t.compact()
    else:
        t.upsert(rows.where("k % 5 = 0").selectExpr("k", "p", "'part' AS s"))
    t.upsert(spark.range(0, 4000, 1, 4).selectExpr("id % 1000 AS k", "string(id % 1000 % 3) AS p", "-id AS v", "'last' AS s"))
    return t


def _want(compacted: bool) -> dict:
    return {k: (str(k % 3), -k - 3000, "last") if k < 1000 else (str(k % 3), k, "part" if k % 5 == 0 and not compacted else "first") for k in range(4000)}


@pytest.mark.parametrize("compacted", [False, True])
def test_large_buckets_are_merged_by_more_tasks(spark, tmp_path, monkeypatch, compacted):
    t = _orders(spark, str(tmp_path / "t"), compacted)
    found = lambda df: {r["k"]: (r["p"], r["v"], r["s"]) for r in df.collect()}
    assert found(t.read()) == _want(compacted) and bucketed.tasks_for([(0, 1), (1, 1)], 2) == 0
    monkeypatch.setattr(bucketed, "TASK_BYTES", 500)
    df = t.read()
    merging = [int(n) for n in re.findall(r"hashpartitioning\(k#\d+L?, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())]
    assert min(merging) > 2 and found(df) == _want(compacted)
    assert found(t.read("k = 7 AND p = '1'")) == {7: _want(compacted)[7]}
    t.compact()
    assert found(t.read()) == _want(compacted)


@pytest.mark.parametrize("compacted", [False, True])
def test_large_buckets_become_files_in_the_order_of_the_input(spark, tmp_path, monkeypatch, compacted):
    monkeypatch.setattr(bucketed, "PIECE_BYTES", 100)
    t = _orders(spark, str(tmp_path / "t"), compacted)
    assert max(r["files"] / r["commits"] for r in t.statistics().collect()) > 2
    spark.dataSource.register(TableSource)
    for df in (t.read(), spark.read.format("mergelake").load(t.path)):
        assert {r["k"]: (r["p"], r["v"], r["s"]) for r in df.collect()} == _want(compacted)
    monkeypatch.setattr(bucketed, "TASK_BYTES", 500)
    assert {r["k"]: (r["p"], r["v"], r["s"]) for r in t.read().collect()} == _want(compacted)
    assert sum(t.read(buckets=(i, 2)).count() for i in range(2)) == 4000


@pytest.mark.parametrize("how", ["tables", "key"])
def test_many_rows_are_not_dealt_to_the_few_buckets_of_a_table_joined_to_them(spark, tmp_path, monkeypatch, how):
    dim = Table.create(spark, str(tmp_path / "dim"), spark.range(10).selectExpr("id AS k", "string(id) AS s"), keys=["k"], buckets=2)
    rows = spark.range(0, 4000, 1, 4).selectExpr("id AS f", "id % 20 AS k")
    facts = Table.create(spark, str(tmp_path / "facts"), T.StructType([*rows.schema.fields, dim.schema["s"]]), keys=["f"], buckets=2)
    seen: list = []
    monkeypatch.setattr(Table, "upsert", lambda self, df: seen.append(df))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        facts.join_with_tables_and_upsert(rows, [dim]) if how == "tables" else dim.upsert_on_join_key(rows.selectExpr("k", "string(f) AS s"), ["k"])
        text = seen[0]._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and set(re.findall(r"hashpartitioning\(.*?, (\d+)\)", text)) == {spark.conf.get("spark.sql.shuffle.partitions")}
        assert seen[0].count() == (4000 if how == "tables" else 2000)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_bucket_of_forty_megabytes_is_written_by_more_than_one_task(spark, tmp_path):
    rows = spark.range(0, 1_000_000, 1, 8).selectExpr("xxhash64(id) AS k", "sha2(string(id), 256) AS s")
    t = Table.create(spark, str(tmp_path / "t"), rows, keys=["k"], buckets=1)
    assert t.statistics().first()["files"] > 1 and t.read().agg({"k": "count"}).first()[0] == 1_000_000


def test_dense_files_are_merged_by_their_rows(spark, tmp_path, monkeypatch):
    t = Table.create(spark, str(tmp_path / "t"), spark.range(0, 200_000, 1, 4).selectExpr("id AS k", "-1 AS v"), keys=["k"], buckets=2)
    t.upsert(spark.range(0, 200_000, 2, 4).selectExpr("id AS k", "-2 AS v"))
    monkeypatch.setattr(bucketed, "DENSE_BYTES", 1)
    assert "hashpartitioning" not in t.read()._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(bucketed, "TASK_ROWS", 25_000)
    df = t.read()
    (tasks,) = {int(n) for n in re.findall(r"hashpartitioning\(k#\d+L?, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())}
    assert 12 <= tasks <= 14 and {(r["v"], r["count"]) for r in df.groupBy("v").count().collect()} == {(-1, 100_000), (-2, 100_000)}


def test_a_bucket_is_cut_where_one_task_reads_all_its_rows(spark, tmp_path, monkeypatch):
    rows = spark.range(0, 200_000, 1, 1).selectExpr("id % 100000 AS k", "id AS v", "sha2(string(id), 256) AS s")
    rows.write.option("parquet.block.size", 1 << 20).parquet(str(tmp_path / "given"))
    given = spark.read.parquet(str(tmp_path / "given")).coalesce(1)
    monkeypatch.setattr(bucketed, "PIECE_BYTES", 1 << 20)
    monkeypatch.setattr(bucketed, "TASK_ROWS", 5_000)
    t = Table.create(spark, str(tmp_path / "t"), given, keys=["k"], buckets=2)
    assert t.statistics().first()["files"] > 2
    assert bucketed.rows_of_a_task(given) >= 50_000 and bucketed.parts_for(given, 2) >= 3
    monkeypatch.undo()
    assert bucketed.parts_for(given, 2) == 1 and bucketed.parts_for(rows, 2) == 1
    assert t.read().where("v = k + 100000 AND s = sha2(string(v), 256)").count() == 100_000 == t.read().count()
    assert sum(t.read(buckets=(i, 2)).count() for i in range(2)) == 100_000
    assert t.read("k = 7").first()["v"] == 100_007
