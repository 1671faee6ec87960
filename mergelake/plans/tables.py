"""The table layer: every query makes a table of a given one, changes it, and returns what it then holds."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergelake import functions as V
from mergelake import streaming as S
from mergelake.catalog import Catalog
from mergelake.operators import log as L
from mergelake.operators import merging
from mergelake.operators.vectors import VectorConfig, VectorIndex, exact_top_k, hamming_top_k, index_table
from mergelake.plans.registry import query, read, table, workspace
from mergelake.functions import generators
from mergelake.sources.scan import Scan, export_jdbc, read_jdbc, write_jdbc
from mergelake.table import Table, TableError

ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
TENTH = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice * 2 AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 10 = 0"


def _orders(spark: SparkSession, d: str, **how) -> Table:
    return table(spark, read(spark, d, "orders"), ranges=["o_orderpriority"], keys=["o_orderkey"], buckets=4, **how)


def _tenth(df: DataFrame) -> DataFrame:
    """Every tenth order at twice the price."""
    return df.where("o_orderkey % 10 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2)


def _parts(spark: SparkSession, d: str, **operators: str) -> Table:
    return table(spark, read(spark, d, "part").select("p_partkey", "p_size", "p_brand"), keys=["p_partkey"], buckets=4, properties={"merge_operators": json.dumps(operators)})


def _part_delta(spark: SparkSession, d: str) -> DataFrame:
    """Two rows for every seventh part, in order; brands are null for every fourteenth."""
    rows = read(spark, d, "part").where("p_partkey % 7 = 0").select("p_partkey", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("i"))
    return rows.select("p_partkey", F.col("i").cast("int").alias("p_size"), F.when(F.col("p_partkey") % 14 != 0, F.concat(F.lit("B"), F.col("i").cast("string"))).alias("p_brand"))


@query("SELECT * FROM lineitem")
def append_table_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem")
    t = table(spark, rows.where("l_orderkey % 2 = 0"), ranges=["l_returnflag"])
    t.append(rows.where("l_orderkey % 2 = 1"))
    return t.read()


@query(f"SELECT {ORDERS} FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL {TENTH}")
def upsert_use_last(spark: SparkSession, d: str) -> DataFrame:
    t = _orders(spark, d)
    t.upsert(_tenth(read(spark, d, "orders")))
    return t.read()


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def upsert_partial_columns(spark: SparkSession, d: str) -> DataFrame:
    t = _orders(spark, d)
    t.upsert(read(spark, d, "orders").where("o_orderkey % 7 = 0").select("o_orderkey", "o_orderpriority", F.lit("X").alias("o_orderstatus")))
    return t.read()


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 14 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def upsert_explicit_null(spark: SparkSession, d: str) -> DataFrame:
    t = _orders(spark, d)
    t.upsert(read(spark, d, "orders").where("o_orderkey % 7 = 0").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 14 != 0, "X").alias("o_orderstatus")))
    return t.read()


@query(f"SELECT {ORDERS} FROM orders UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 5 = 0")
def upsert_new_keys(spark: SparkSession, d: str) -> DataFrame:
    t = _orders(spark, d)
    t.upsert(read(spark, d, "orders").where("o_orderkey % 5 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000))
    return t.read()


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 2 ELSE p_size END AS p_size, CASE WHEN p_partkey % 7 = 0 AND p_partkey % 14 <> 0 THEN 'B2' ELSE p_brand END AS p_brand FROM part")
def merge_not_null(spark: SparkSession, d: str) -> DataFrame:
    t = _parts(spark, d, p_brand="use_last_not_null")
    t.upsert(_part_delta(spark, d))
    return t.read()


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_size + 3 ELSE p_size END AS p_size, CASE WHEN p_partkey % 14 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN p_brand || ',B1,B2' ELSE p_brand END AS p_brand FROM part")
def merge_sum_and_join_all(spark: SparkSession, d: str) -> DataFrame:
    t = _parts(spark, d, p_size="sum_all", p_brand="joined_all_by_comma")
    t.upsert(_part_delta(spark, d))
    return t.read()


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_size + 2 ELSE p_size END AS p_size, CASE WHEN p_partkey % 14 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN p_brand || ';B2' ELSE p_brand END AS p_brand FROM part")
def merge_sum_and_join_last(spark: SparkSession, d: str) -> DataFrame:
    t = _parts(spark, d, p_size="sum_last", p_brand="joined_last_by_semicolon")
    t.upsert(_part_delta(spark, d))
    return t.read()


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN greatest(p_size, 2) ELSE p_size END AS p_size, CASE WHEN p_partkey % 14 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 'B2' ELSE p_brand END AS p_brand FROM part")
def merge_user_operator(spark: SparkSession, d: str) -> DataFrame:
    merging.register("largest", F.array_max)
    t = _parts(spark, d)
    t.upsert(_part_delta(spark, d))
    return t.read(operators={"p_size": "largest"})


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_size + 6 ELSE p_size END AS p_size, CASE WHEN p_partkey % 14 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 'B2' ELSE p_brand END AS p_brand FROM part")
def compaction_with_operators(spark: SparkSession, d: str) -> DataFrame:
    t = _parts(spark, d)
    t.upsert(_part_delta(spark, d))
    t.compact(operators={"p_size": "sum_all"})
    t.upsert(_part_delta(spark, d))
    t.compact(operators={"p_size": "sum_all"}, buckets=2)
    return t.read()


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN 'C' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def compaction_levels(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    t = table(spark, rows, keys=["o_orderkey"], buckets=4)
    t.upsert(_tenth(rows))
    for s in "ABC":
        t.upsert(rows.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit(s).alias("o_orderstatus")))
    t.compact_levels(file_limit=2)
    return t.read()


def _changes(spark: SparkSession, d: str) -> Table:
    rows = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    t = table(spark, rows.withColumn("kind", F.lit("insert")), ranges=["o_orderpriority"], keys=["o_orderkey"], buckets=2, properties={"cdc_change_column": "kind"})
    t.upsert(rows.where("o_orderkey % 11 = 0").withColumn("kind", F.lit("delete")))
    t.upsert(rows.where("o_orderkey % 13 = 0 AND o_orderkey % 11 <> 0").withColumns({"o_custkey": F.lit(-1).cast("long"), "kind": F.lit("update")}))
    return t


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN -1 ELSE o_custkey END AS o_custkey, o_orderpriority, CASE WHEN o_orderkey % 13 = 0 THEN 'update' ELSE 'insert' END AS kind FROM orders WHERE o_orderkey % 11 <> 0")
def change_data_read(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).read()


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN -1 ELSE o_custkey END AS o_custkey, o_orderpriority, 'insert' AS kind FROM orders WHERE o_orderkey % 11 <> 0")
def change_data_compacted(spark: SparkSession, d: str) -> DataFrame:
    t = _changes(spark, d)
    t.compact()
    return t.read(keep_deleted=True)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN -1 ELSE o_custkey END AS o_custkey, o_orderpriority, CASE WHEN o_orderkey % 11 = 0 THEN 'delete' ELSE 'update' END AS kind FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0")
def change_data_incremental(spark: SparkSession, d: str) -> DataFrame:
    t = _changes(spark, d)
    starts = [t.log.version(p, 0).timestamp for p in t.log.partitions()]
    return t.incremental(max(starts) + 1)


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN 'new' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 3 = 1 THEN 'update' ELSE 'insert' END AS kind FROM customer WHERE c_custkey % 3 <> 0")
def row_kinds(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    t = table(spark, rows.withColumn("kind", F.lit("insert")), keys=["c_custkey"], properties={"cdc_change_column": "kind"})
    t.change(rows.where("c_custkey % 3 = 0").withColumn("op", F.lit("-D")), "op")
    t.change(rows.where("c_custkey % 3 = 1").withColumns({"c_mktsegment": F.lit("new"), "op": F.lit("+U")}), "op")
    return t.read()


@query(f"SELECT {ORDERS} FROM orders")
def snapshot_read(spark: SparkSession, d: str) -> DataFrame:
    t = _orders(spark, d)
    then = max(t.log.latest(p).timestamp for p in t.log.partitions())
    t.upsert(_tenth(read(spark, d, "orders")))
    return t.snapshot(then)


@query(f"SELECT {ORDERS} FROM orders WHERE o_orderpriority = '1-URGENT'")
def version_read(spark: SparkSession, d: str) -> DataFrame:
    t = _orders(spark, d)
    t.upsert(_tenth(read(spark, d, "orders")))
    return t.at_version("o_orderpriority=1-URGENT", 0)


@query(TENTH)
def incremental_read(spark: SparkSession, d: str) -> DataFrame:
    t = _orders(spark, d)
    then = max(t.log.latest(p).timestamp for p in t.log.partitions())
    t.upsert(_tenth(read(spark, d, "orders")))
    t.compact()
    return t.incremental(then + 1, max(t.log.version(p, 1).timestamp for p in t.log.partitions()))


@query(f"SELECT {ORDERS} FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderkey % 10 <> 0 UNION ALL {TENTH} AND o_orderpriority <> '1-URGENT'")
def rollback_partition(spark: SparkSession, d: str) -> DataFrame:
    t = _orders(spark, d)
    t.upsert(_tenth(read(spark, d, "orders")))
    t.call("rollback", partition_value={"o_orderpriority": "1-URGENT"}, version=0)
    return t.read()


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT c_custkey, -1, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0")
def overwrite_dynamic(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    t = table(spark, rows, ranges=["c_mktsegment"])
    t.overwrite(rows.where("c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0").withColumn("c_nationkey", F.lit(-1)))
    return t.read()


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') UNION ALL SELECT -c_custkey, 'MACHINERY' FROM customer WHERE c_mktsegment = 'BUILDING'")
def overwrite_replace_where(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    t = table(spark, rows, ranges=["c_mktsegment"])
    new = rows.where("c_mktsegment = 'BUILDING'").select((-F.col("c_custkey")).alias("c_custkey"), F.lit("MACHINERY").alias("c_mktsegment"))
    t.overwrite(new, replace_where="c_mktsegment IN ('BUILDING', 'MACHINERY')")
    return t.read()


@query(f"SELECT {ORDERS} FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL {TENTH}")
def upsert_copy_on_write(spark: SparkSession, d: str) -> DataFrame:
    t = _orders(spark, d)
    t.upsert(_tenth(read(spark, d, "orders")), delta=False, full_scan=True)
    return t.read()


@query("SELECT o_orderkey, o_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'moved' ELSE c_mktsegment END AS c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def upsert_on_join_key(spark: SparkSession, d: str) -> DataFrame:
    customers = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    wide = read(spark, d, "orders").select("o_orderkey", "o_custkey").join(customers, "o_custkey").select("o_orderkey", "o_custkey", "c_mktsegment")
    t = table(spark, wide, keys=["o_orderkey"], buckets=2)
    t.upsert_on_join_key(customers.where("o_custkey % 10 = 0").withColumn("c_mktsegment", F.lit("moved")), ["o_custkey"])
    return t.read()


@query("SELECT o_orderkey, o_custkey AS c_custkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def join_with_tables_and_upsert(spark: SparkSession, d: str) -> DataFrame:
    dim = table(spark, read(spark, d, "customer").select("c_custkey", "c_mktsegment"), keys=["c_custkey"], buckets=2)
    facts = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    t = Table.create(spark, f"{workspace(spark)}/t", T.StructType([*facts.schema.fields, dim.schema["c_mktsegment"]]), keys=["o_orderkey"], buckets=2)
    t.join_with_tables_and_upsert(facts, [dim])
    return t.read()


@query(f"SELECT {ORDERS} FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL {TENTH}")
def merge_into(spark: SparkSession, d: str) -> DataFrame:
    t = _orders(spark, d)
    t.merge_into(_tenth(read(spark, d, "orders")), "t.o_orderkey = s.o_orderkey AND t.o_orderpriority = s.o_orderpriority")
    return t.read()


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 100 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity, l_returnflag FROM lineitem")
def update_rows(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), ranges=["l_returnflag"])
    t.update({"l_quantity": "l_quantity + 1"}, "l_orderkey % 100 = 0")
    return t.read()


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_keyed(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), keys=["o_orderkey"])
    t.update({"o_orderstatus": F.lit("U")}, "o_orderkey % 4 = 0")
    return t.read()


@query("SELECT s_suppkey, s_nationkey + 100 AS nation, s_name AS name FROM supplier")
def update_nested(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, read(spark, d, "supplier").select("s_suppkey", F.struct("s_nationkey", "s_name").alias("s")))
    t.update({"s.s_nationkey": "s.s_nationkey + 100"})
    return t.read().select("s_suppkey", F.col("s.s_nationkey").alias("nation"), F.col("s.s_name").alias("name"))


@query("SELECT * FROM lineitem WHERE l_returnflag <> 'R' AND NOT (l_quantity > 25 AND l_linestatus = 'O')")
def delete_rows(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, read(spark, d, "lineitem"), ranges=["l_returnflag"])
    t.delete("l_returnflag = 'R'")
    t.delete("l_quantity > 25 AND l_linestatus = 'O'")
    return t.read()


@query(f"SELECT {ORDERS} FROM orders WHERE o_orderkey % 6 <> 0")
def delete_keyed(spark: SparkSession, d: str) -> DataFrame:
    t = _orders(spark, d)
    t.delete("o_orderkey % 6 = 0")
    return t.read()


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, upper(n_name), n_regionkey FROM nation")
def insert_by_position(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "nation")
    t = table(spark, rows)
    t.insert_by_position(rows.select((F.col("n_nationkey") + 100).cast("long").alias("a"), F.upper("n_name").alias("b"), F.col("n_regionkey").cast("string").alias("c")))
    return t.read()


@query("SELECT p_partkey, p_size, NULL AS p_brand FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, p_size, p_brand FROM part WHERE p_partkey % 2 = 1")
def schema_evolution(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part")
    t = table(spark, rows.where("p_partkey % 2 = 0").select("p_partkey", F.col("p_size").cast("short").alias("p_size")))
    t.append(rows.where("p_partkey % 2 = 1").select("p_partkey", "p_size", "p_brand"), merge_schema=True)
    return t.read()


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, NULL AS note FROM part")
def alter_columns(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, read(spark, d, "part").select("p_partkey", "p_size", "p_brand"))
    t.add_columns(T.StructField("note", T.StringType()))
    t.change_column("p_size", T.LongType())
    t.drop_columns("p_brand")
    return t.read()


@query(f"SELECT {ORDERS} FROM orders WHERE o_orderpriority = '2-HIGH' AND o_totalprice > 100000")
def partition_pruning(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).read("o_orderpriority = '2-HIGH' AND o_totalprice > 100000")


@query(f"SELECT {ORDERS} FROM orders WHERE o_orderkey IN (1, 2, 3, 64)")
def bucket_pruning(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).read("o_orderkey IN (1, 2, 3, 64)", skip_merge=True)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND NOT (o_orderstatus = 'F') AND o_custkey IS NOT NULL")
def filter_language(spark: SparkSession, d: str) -> DataFrame:
    return Scan(_orders(spark, d)).filter("and(and(gt(o_totalprice,100000),not(eq(o_orderstatus,'F'))),noteq(o_custkey,null))").select("o_orderkey", "o_totalprice").to_df()


@query(f"SELECT {ORDERS} FROM orders WHERE o_orderpriority <> '5-LOW'")
def drop_partition(spark: SparkSession, d: str) -> DataFrame:
    t = _orders(spark, d)
    t.drop_partition("o_orderpriority = '5-LOW'")
    return t.read()


@query("SELECT DISTINCT 'o_orderpriority=' || replace(o_orderpriority, ' ', ' ') AS partition FROM orders")
def show_partitions(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in _orders(spark, d).partitions()], "partition string")


@query("SELECT COUNT(*) AS n FROM orders")
def count_only(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).read().agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders")
def shard_reads(spark: SparkSession, d: str) -> DataFrame:
    scan = Scan(_orders(spark, d)).select("o_orderkey")
    return scan.shard(0, 3).to_df().union(scan.shard(1, 3).to_df()).union(scan.shard(2, 3).to_df())


@query("SELECT 5 AS partitions, TRUE AS small, COUNT(*) AS rows FROM orders")
def cleanup_and_vacuum(spark: SparkSession, d: str) -> DataFrame:
    t = _orders(spark, d)
    t.upsert(_tenth(read(spark, d, "orders")))
    t.compact()
    for p in t.log.partitions():
        t.cleanup(p, L.now_ms() + 1000)
    t.vacuum()
    stats = t.statistics()
    return stats.agg(F.count(F.lit(1)).cast("int").alias("partitions"), (F.sum("versions") <= 5).alias("small")).join(t.read().agg(F.count(F.lit(1)).alias("rows")))


def _drained(spark: SparkSession, d: str, start) -> None:
    """Runs a stream over the events table to its end."""
    events = read(spark, d, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    running = start(stream).option("checkpointLocation", f"{workspace(spark)}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()


@query("SELECT event_id, ts, user_id, event_type, value FROM events")
def stream_sink(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    t = Table.create(spark, f"{workspace(spark)}/t", rows.schema, keys=["event_id"], buckets=2)
    _drained(spark, d, lambda s: S.write_stream(s.select(rows.columns), t, "sink"))
    S.write_batch(t, rows.limit(0), 0, "sink")
    return t.read()


@query("SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type")
def stream_sink_complete(spark: SparkSession, d: str) -> DataFrame:
    struct = T.StructType([T.StructField("event_type", T.StringType()), T.StructField("n", T.LongType())])
    t = Table.create(spark, f"{workspace(spark)}/t", struct)
    _drained(spark, d, lambda s: S.write_stream(s.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), t, "totals", "complete"))
    return t.read()


@query("SELECT event_id, user_id FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, -1 FROM events WHERE event_id % 3 = 0")
def stream_source(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select("event_id", "user_id")
    source, target = (table(spark, rows.limit(0), keys=["event_id"], buckets=2) for _ in range(2))
    reader = S.ChangeReader(source)
    for part in (rows, rows.where("event_id % 3 = 0").withColumn("user_id", F.lit(-1).cast("long"))):
        source.upsert(part)
        S.copy_changes(source, target, "copy", reader)
    return target.read()


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2, 3")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    return S.windowed_counts(read(spark, d, "events"), "ts", "10 minutes", "1 hour", by=["event_type"])


@query("SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, COUNT(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) t GROUP BY w")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    return S.windowed_counts(read(spark, d, "events"), "ts", "10 minutes", "1 hour", "30 minutes")


@query("""SELECT user_id, MIN(ts) AS session_start, MAX(ts) + INTERVAL 30 MINUTE AS session_end, COUNT(*) AS n FROM
(SELECT user_id, ts, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
(SELECT *, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events) a) b GROUP BY user_id, s""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return S.sessions(read(spark, d, "events"), "ts", "30 minutes", ["user_id"])


@query("SELECT event_id, user_id, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey")
def lookup_join(spark: SparkSession, d: str) -> DataFrame:
    dim = table(spark, read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment"), keys=["user_id"])
    out = Table.create(spark, f"{workspace(spark)}/t", T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("c_mktsegment", T.StringType())]))
    _drained(spark, d, lambda s: S.lookup_join(s.select("event_id", "user_id"), dim.read, ["user_id"], lambda b, n: out.append(b)))
    return out.read()


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def topic_ingestion(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    batch = rows.select(F.lit("db.customer").alias("topic"), F.to_json(F.struct(*rows.columns)).cast("binary").alias("value"))
    catalog = Catalog(spark, workspace(spark))
    S.ingest_topics(catalog, batch, 0, {"db.customer": rows.schema}, "ingest", {"db.customer": ["c_custkey"]})
    return catalog.table("db_customer").read()


@query("SELECT CAST(bit_count(xor(o_orderkey, o_custkey)) AS INTEGER) AS d, COUNT(*) AS n FROM orders GROUP BY 1")
def hamming_distances(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(V.hamming_distance(F.array("o_orderkey"), F.array("o_custkey")).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))


_QUERY_VECTOR = "(SELECT embedding FROM embeddings WHERE vec_id = 7)"


def _vector(spark: SparkSession, d: str) -> list[float]:
    return list(read(spark, d, "embeddings").where("vec_id = 7").first()["embedding"])


@query(f"SELECT vec_id FROM embeddings ORDER BY list_distance(CAST(embedding AS DOUBLE[]), CAST({_QUERY_VECTOR} AS DOUBLE[])), vec_id LIMIT 10")
def vector_exact_top_k(spark: SparkSession, d: str) -> DataFrame:
    return exact_top_k(read(spark, d, "embeddings"), "embedding", _vector(spark, d), 10, "L2", "vec_id").select("vec_id")


@query(f"SELECT vec_id FROM embeddings ORDER BY list_inner_product(CAST(embedding AS DOUBLE[]), CAST({_QUERY_VECTOR} AS DOUBLE[])) DESC, vec_id LIMIT 10")
def vector_index_search(spark: SparkSession, d: str) -> DataFrame:
    rows, vector = read(spark, d, "embeddings"), _vector(spark, d)
    config = VectorConfig.parse(f"embedding:{len(vector)}:16:7:InnerProduct")[0]
    index = VectorIndex(spark, f"{workspace(spark)}/v", config, "vec_id")
    index.build(rows.where("vec_id % 4 <> 0"))
    index.insert(rows.where("vec_id % 4 = 0"))
    return index.search(vector, 10, nprobe=16).select("vec_id")


def _recall(spark: SparkSession, d: str, search, queries: int = 20, k: int = 10) -> DataFrame:
    """Over some rows as queries, whether a search finds 90 % of the exact neighbours and does not look at everything."""
    rows = read(spark, d, "embeddings")
    hits = 0
    for r in rows.where("vec_id % 7 = 3").orderBy("vec_id").limit(queries).collect():
        want = {x["vec_id"] for x in exact_top_k(rows, "embedding", list(r["embedding"]), k, "L2", "vec_id").collect()}
        hits += len(want & {x["vec_id"] for x in search(list(r["embedding"]), k).collect()})
    return spark.createDataFrame([(hits >= 0.9 * queries * k,)], "reached boolean")


@query("SELECT TRUE AS reached")
def vector_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """An index for each bucket of a keyed table, 12 of 16 lists, four bits a component: recall over ten queries."""
    t = table(spark, read(spark, d, "embeddings").select("vec_id", "embedding"), keys=["vec_id"], buckets=2)
    dim = len(_vector(spark, d))
    index = index_table(t, f"{workspace(spark)}/v", VectorConfig("embedding", dim, nlist=16, bits=4))
    return _recall(spark, d, lambda q, k: index.search(q, k, nprobe=12), 10)


@query(f"SELECT vec_id, CAST(round(1 - abs(list_inner_product(CAST(embedding AS DOUBLE[]), CAST({_QUERY_VECTOR} AS DOUBLE[]))) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * (SELECT list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) FROM embeddings WHERE vec_id = 7)), 6) AS DOUBLE) + 0 AS d FROM embeddings")
def cosine_distances(spark: SparkSession, d: str) -> DataFrame:
    """As a SQL function, over all vectors."""
    V.register(spark)
    rows = read(spark, d, "embeddings").selectExpr("vec_id", "cast(embedding AS array<double>) AS e")
    one = rows.where("vec_id = 7").select(F.col("e").alias("q"))
    return rows.join(F.broadcast(one.limit(1))).selectExpr("vec_id", "round(cosine_distance(e, q), 6) + 0 AS d")


@query("SELECT TRUE AS reached")
def vector_sign_prefilter(spark: SparkSession, d: str) -> DataFrame:
    """Sign bits choose 200 rows, ten of which are wanted: recall over ten queries."""
    rows = read(spark, d, "embeddings")
    return _recall(spark, d, lambda q, k: hamming_top_k(rows, "embedding", q, k, 200, "vec_id"), 10)


@query("SELECT o_orderkey, COUNT(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def bucketed_key_join(spark: SparkSession, d: str) -> DataFrame:
    names = [f"mergelake_bucketed_{n}" for n in ("orders", "lines")]
    table(spark, read(spark, d, "orders").select("o_orderkey"), keys=["o_orderkey"], buckets=8).publish_bucketed(names[0])
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    table(spark, lines, keys=["l_orderkey"], buckets=8).publish_bucketed(names[1])
    return spark.table(names[0]).join(spark.table(names[1]), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.sum("n").alias("n"))


@query("SELECT e.event_id, MAX(o.o_orderdate) AS last_order FROM events e JOIN orders o ON e.user_id = o.o_custkey AND o.o_orderdate <= e.ts GROUP BY e.event_id")
def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    """The last order before each event: both sides in one sorted window, so no pair is ever made."""
    from pyspark.sql import Window

    events = read(spark, d, "events").select("event_id", "user_id", F.col("ts").alias("at"), F.lit(None).cast("timestamp_ntz").alias("order_at"), F.lit(1).alias("side"))
    events = events.withColumn("order_at", F.lit(None).cast(events.schema["at"].dataType))
    orders = read(spark, d, "orders").select(F.lit(None).cast("long").alias("event_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("at"), F.col("o_orderdate").alias("order_at"), F.lit(0).alias("side"))
    order = Window.partitionBy("user_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    return events.unionByName(orders).withColumn("last_order", F.last("order_at", True).over(order)).where("side = 1 AND last_order IS NOT NULL").select("event_id", "last_order")


@query("SELECT 'o_orderpriority=' || o_orderpriority AS partition, CAST(2 AS BIGINT) AS versions, CAST(2 AS BIGINT) AS commits, CAST(8 AS BIGINT) AS files FROM orders GROUP BY o_orderpriority")
def table_statistics(spark: SparkSession, d: str) -> DataFrame:
    t = _orders(spark, d)
    t.upsert(_tenth(read(spark, d, "orders")))
    return t.statistics().select("partition", "versions", "commits", "files")


@query("SELECT n_regionkey, n_name FROM nation WHERE n_regionkey = 1")
def catalog_views(spark: SparkSession, d: str) -> DataFrame:
    catalog = Catalog(spark, workspace(spark))
    catalog.create_namespace("Sales")
    catalog.create_table("sales.lake_nation", read(spark, d, "nation"), ranges=["n_regionkey"])
    catalog.use("SALES")
    catalog.register_views()
    return spark.sql("SELECT n_regionkey, n_name FROM lake_nation WHERE n_regionkey = 1")


@query(f"SELECT {ORDERS} FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL {TENTH}")
def format_scan(spark: SparkSession, d: str) -> DataFrame:
    from mergelake.sources.datasource import TableSource

    spark.dataSource.register(TableSource)
    t = _orders(spark, d)
    t.upsert(_tenth(read(spark, d, "orders")))
    return spark.read.format("mergelake").load(t.path)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'M' WHEN o_custkey % 2 = 0 THEN 'E' ELSE o_orderstatus END AS o_orderstatus,
          CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderkey % 9 <> 0""")
def sql_statements(spark: SparkSession, d: str) -> DataFrame:
    """A keyed table made, updated, merged into, deleted from and read by SQL alone."""
    lake = Catalog(spark, workspace(spark))
    read(spark, d, "orders").createOrReplaceTempView("given_orders")
    lake.sql("CREATE NAMESPACE shop")
    lake.sql("USE shop")
    lake.sql("""CREATE TABLE bought PARTITIONED BY (o_orderpriority) TBLPROPERTIES ('hashPartitions' = 'o_orderkey', 'hashBucketNum' = '4')
                AS SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM given_orders""")
    lake.sql("UPDATE bought b SET b.o_orderstatus = 'E' WHERE b.o_custkey % 2 = 0")
    lake.sql("""MERGE INTO bought t USING (SELECT o_orderkey, o_orderpriority, 'M' AS o_orderstatus, o_totalprice * 2 AS o_totalprice FROM given_orders WHERE o_orderkey % 4 = 0) n
                ON t.o_orderkey = n.o_orderkey AND t.o_orderpriority = n.o_orderpriority
                WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *""")
    lake.sql("DELETE FROM bought WHERE o_orderkey % 9 = 0")
    lake.sql("ALTER TABLE bought DROP PARTITION (o_orderpriority = '5-LOW')")
    lake.sql("CALL compaction(table => 'shop.bought')")
    return lake.sql("SELECT bought.o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM bought")


_OR = "o_orderpriority = '2-HIGH' AND o_totalprice > 200000 OR o_custkey % 50 = 1"


@query(f"SELECT {ORDERS} FROM orders WHERE {_OR}")
def prune_with_or(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).read(_OR)


@query(f"SELECT * FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_quantity > 25 OR l_linenumber = 1)")
def delete_with_or(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, read(spark, d, "lineitem"), ranges=["l_returnflag"])
    t.delete("l_returnflag = 'R' AND l_quantity > 25 OR l_linenumber = 1")
    return t.read()


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' AND l_quantity > 25 OR l_linenumber = 1 THEN -1 ELSE l_quantity END AS l_quantity, l_returnflag FROM lineitem")
def update_with_or(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), ranges=["l_returnflag"])
    t.update({"l_quantity": "-1"}, "l_returnflag = 'R' AND l_quantity > 25 OR l_linenumber = 1")
    return t.read()


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE NOT (l_returnflag = 'A' AND l_linenumber > 3 OR l_orderkey % 5 = 0)")
def sql_delete_with_or(spark: SparkSession, d: str) -> DataFrame:
    lake = Catalog(spark, workspace(spark))
    lake.create_table("lines", read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), ranges=["l_returnflag"])
    lake.sql("DELETE FROM lines WHERE l_returnflag = 'A' AND l_linenumber > 3 OR l_orderkey % 5 = 0")
    return lake.sql("SELECT * FROM lines")


def _levelled(spark: SparkSession, d: str, rounds: int) -> Table:
    """A compacted base, then upserts of one column at a time, levelled after each round."""
    rows = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    t = table(spark, rows, keys=["o_orderkey"], buckets=2)
    t.compact()
    for i in range(rounds):
        for j in range(2):
            t.upsert(rows.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit(f"{i}{j}").alias("o_orderstatus")))
        t.upsert(rows.where("o_orderkey % 4 = 0").select("o_orderkey", F.lit(i).cast("long").alias("o_custkey")))
        t.compact_levels(file_limit=2)
    return t


def _levelled_sql(rounds: int) -> str:
    return f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN {rounds - 1} ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN '{rounds - 1}1' ELSE o_orderstatus END AS o_orderstatus FROM orders"


@query(_levelled_sql(1))
def compaction_levels_partial(spark: SparkSession, d: str) -> DataFrame:
    return _levelled(spark, d, 1).read()


@query(_levelled_sql(3))
def compaction_levels_twice(spark: SparkSession, d: str) -> DataFrame:
    return _levelled(spark, d, 3).read()


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN 6 ELSE o_orderkey % 7 END AS o_custkey FROM orders WHERE o_orderkey % 7 > 0")
def incremental_after_levels(spark: SparkSession, d: str) -> DataFrame:
    """Each key is upserted once after the start; compactions in between are nothing new."""
    rows = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    t = table(spark, rows.where("o_orderkey % 7 = 0"), keys=["o_orderkey"], buckets=2)
    then = t.log.latest(L.WHOLE).timestamp
    for i in range(1, 7):
        t.upsert(rows.where(f"o_orderkey % 7 = {i}").withColumn("o_custkey", F.lit(i).cast("long")))
        t.compact_levels(file_limit=2)
    return t.incremental(then + 1)


@query("SELECT o_orderkey, COUNT(*) AS times FROM orders GROUP BY o_orderkey")
def stream_after_levels(spark: SparkSession, d: str) -> DataFrame:
    """A reader that polls between upserts and compactions gets every row once."""
    rows = read(spark, d, "orders").select("o_orderkey")
    t = table(spark, rows.where("o_orderkey % 5 = 0"), keys=["o_orderkey"], buckets=2)
    out = Table.create(spark, f"{workspace(spark)}/t", rows.schema)
    reader = S.ChangeReader(t)
    S.copy_changes(t, out, "levels", reader)
    for i in range(1, 5):
        t.upsert(rows.where(f"o_orderkey % 5 = {i}"))
        t.compact_levels(file_limit=2)
        if i % 2:
            S.copy_changes(t, out, "levels", reader)
    S.copy_changes(t, out, "levels", reader)
    return out.read().groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("times"))


@query("SELECT 'aggregate' AS condition, TRUE AS refused UNION ALL SELECT 'random', TRUE UNION ALL SELECT 'subquery', TRUE UNION ALL SELECT 'plain', FALSE UNION ALL SELECT 'operator without keys', TRUE UNION ALL SELECT 'append with keys', TRUE")
def refusals(spark: SparkSession, d: str) -> DataFrame:
    """Conditions of upserts are deterministic and plain; merge operators and upserts are for tables with keys, appends for others."""
    rows = read(spark, d, "nation").select("n_nationkey", "n_regionkey")
    keyed, plain = table(spark, rows, keys=["n_nationkey"]), table(spark, rows)
    tries = {
        "aggregate": lambda: keyed.upsert(rows, "sum(n_regionkey) > 1"), "random": lambda: keyed.upsert(rows, "rand() < 0.5"), "subquery": lambda: keyed.upsert(rows, "n_nationkey IN (SELECT 1)"), "plain": lambda: keyed.upsert(rows, "n_nationkey > 3"),
        "operator without keys": lambda: plain.read(operators={"n_regionkey": "sum_all"}), "append with keys": lambda: keyed.append(rows),
    }
    found = []
    for name, run in tries.items():
        try:
            run()
            found.append((name, False))
        except TableError:
            found.append((name, True))
    return spark.createDataFrame(found, "condition string, refused boolean")


@query("SELECT o_custkey, MAX(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def upsert_sorted_within_keys(spark: SparkSession, d: str) -> DataFrame:
    """Of the many rows of a key in one batch the last in the order of a further column wins."""
    rows = read(spark, d, "orders").select("o_custkey", "o_orderkey")
    t = Table.create(spark, f"{workspace(spark)}/t", rows.schema, keys=["o_custkey"], buckets=2)
    t.upsert(rows, sort_also=["o_orderkey"])
    return t.read()


@query("SELECT 'o_orderpriority=' || o_orderpriority AS partition FROM orders GROUP BY o_orderpriority HAVING o_orderpriority <> '5-LOW'")
def compaction_trigger(spark: SparkSession, d: str) -> DataFrame:
    """Partitions with three versions since their last compaction."""
    t = _orders(spark, d)
    for _ in range(2):
        t.upsert(_tenth(read(spark, d, "orders")))
    t.compact("o_orderpriority = '5-LOW'")
    return spark.createDataFrame([(p,) for p in t.needs_compaction(3)], "partition string")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE FALSE UNION ALL SELECT c_custkey, 'kept' FROM customer WHERE c_custkey % 2 = 0")
def expired_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Two days on, partitions with a time-to-live of a day are gone, but for the one written since."""
    rows = read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    t = table(spark, rows, ranges=["c_mktsegment"], properties={"partition.ttl": "1"})
    late = max(t.log.now(p).timestamp for p in t.log.partitions()) + 86_400_000
    while L.now_ms() <= late - 86_400_000:
        pass
    t.append(rows.where("c_custkey % 2 = 0").withColumn("c_mktsegment", F.lit("kept")))
    t.expire(late + 1)
    return t.read()


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'moved' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT -1, 'theirs'")
def export_upserts(spark: SparkSession, d: str) -> DataFrame:
    """A table with changes goes to an embedded database, twice: rows of its keys are replaced or deleted, others stay."""
    folder = tempfile.mkdtemp(prefix="mergelake-")  # the driver's own: nobody else opens an embedded database
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    url = f"jdbc:derby:{folder}/shop;create=true"
    rows = read(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("c_custkey"), "c_mktsegment")
    t = table(spark, rows.withColumn("kind", F.lit("insert")), keys=["c_custkey"], properties={"cdc_change_column": "kind"})
    write_jdbc(rows.limit(0).unionAll(spark.createDataFrame([(-1, "theirs")], rows.schema)), url, "shop")
    export_jdbc(t, url, "shop", "upsert")
    t.upsert(rows.where("c_custkey % 5 = 0").withColumns({"c_mktsegment": F.lit("moved"), "kind": F.lit("update")}))
    t.upsert(rows.where("c_custkey % 7 = 0").withColumn("kind", F.lit("delete")))
    export_jdbc(t, url, "shop", "upsert")
    found = read_jdbc(spark, url, "shop")
    return found.toDF(*[c.lower() for c in found.columns])


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, COUNT(*) AS n, MAX(value) AS most FROM events GROUP BY 1")
def json_properties(spark: SparkSession, d: str) -> DataFrame:
    parsed = F.from_json("props", T.StructType([T.StructField("k", T.LongType())]))
    return read(spark, d, "events").groupBy(parsed["k"].alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))


@query("SELECT user_id, CAST(COUNT(DISTINCT event_type) AS INTEGER) AS kinds, SUM(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS clicks, COUNT(*) AS n FROM events GROUP BY user_id")
def arrays_and_maps(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as an array, counted by kind in a map."""
    lists = read(spark, d, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("all"))
    kinds = F.array_distinct("all")
    counted = F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter("all", lambda x: x == k))))
    return lists.select("user_id", F.size(kinds).alias("kinds"), F.coalesce(F.try_element_at(counted, F.lit("click")), F.lit(0)).cast("decimal(38,0)").alias("clicks"), F.size("all").cast("long").alias("n"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, CAST(p_retailprice AS DOUBLE) AS p_retailprice, CAST(p_partkey AS VARCHAR) AS code FROM part UNION ALL SELECT p_partkey + 1000000, p_size, CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE), p_brand FROM part")
def cast_rules(spark: SparkSession, d: str) -> DataFrame:
    """Columns widen to the table's types as rows come in; what would lose something is refused, and the table stays."""
    rows = read(spark, d, "part")
    t = Table.create(spark, f"{workspace(spark)}/t", T.StructType.fromDDL("p_partkey bigint, p_size bigint, p_retailprice double, code string"))
    t.append(rows.select("p_partkey", F.col("p_size").cast("short").alias("p_size"), "p_retailprice", F.col("p_partkey").alias("code")))
    t.append(rows.select((F.col("p_partkey") + 1_000_000).alias("p_partkey"), F.col("p_size").cast("byte").alias("p_size"), F.col("p_retailprice").cast("float").alias("p_retailprice"), F.col("p_brand").alias("code")))
    try:
        t.append(rows.select("p_partkey", F.col("p_brand").alias("p_size"), "p_retailprice", F.col("p_brand").alias("code")))
    except Exception:  # noqa: BLE001  a brand is no number, whoever finds out
        return t.read()
    raise AssertionError("a string became a number")


@query(f"{TENTH} AND o_orderpriority = '1-URGENT'")
def incremental_of_a_partition(spark: SparkSession, d: str) -> DataFrame:
    t = _orders(spark, d)
    then = max(t.log.now(p).timestamp for p in t.log.partitions())
    t.upsert(_tenth(read(spark, d, "orders")))
    return t.incremental(then + 1, 0, "o_orderpriority=1-URGENT")


@query("SELECT 'embedding' AS name, 64 AS dim, 8 AS nlist, 1 AS bits, 'InnerProduct' AS metric UNION ALL SELECT 'w', 4, 256, 7, 'L2'")
def index_configuration(spark: SparkSession, d: str) -> DataFrame:
    found = VectorConfig.parse("embedding:64:8:1:InnerProduct:Matrix:5:true, w:4")
    return spark.createDataFrame([(c.column, c.dim, c.nlist, c.bits, c.metric) for c in found], "name string, dim int, nlist int, bits int, metric string")


@query("SELECT range + 1 AS o_orderkey, range * 15485863 % 500 + 1 AS o_custkey, ['F', 'O', 'P'][range * 31 % 3 + 1] AS o_orderstatus, (range * 32452843 % 50000000) / 100.0 AS o_totalprice FROM range(5000) WHERE range % 5 = 1 UNION ALL SELECT range // 4 + 1, range % 4 + 1, ['A', 'N', 'R'][range * 13 % 3 + 1], CAST(range * 6151 % 50 + 1 AS DOUBLE) FROM range(800)")
def generator_functions(spark: SparkSession, d: str) -> DataFrame:
    """Table functions called in SQL, beside one as a DataFrame."""
    generators.register(spark)
    orders = spark.sql("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM make_orders(5000) WHERE (o_orderkey - 1) % 5 = 1")
    lines = generators.generated(spark, "make_lines", 800)
    return orders.unionAll(lines.select("l_orderkey", F.col("l_linenumber").cast("long"), "l_returnflag", F.col("l_quantity").cast("double")))


@query("SELECT event_id, user_id, CASE WHEN user_id % 2 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM events JOIN customer ON user_id = c_custkey WHERE event_id % 2 = 1 UNION ALL SELECT event_id, user_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey WHERE event_id % 2 = 0")
def cached_lookup_join(spark: SparkSession, d: str) -> DataFrame:
    """The dimension changes after the first batch and is seen once its time to live has passed; batches are committed once."""
    now = [0.0]
    people = read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    dim = table(spark, people, keys=["user_id"])
    cache = S.LookupCache(dim, ttl=60.0, clock=lambda: now[0])
    events = read(spark, d, "events").select("event_id", "user_id")
    out = Table.create(spark, f"{workspace(spark)}/t", T.StructType([*events.schema.fields, T.StructField("c_mktsegment", T.StringType())]))

    def batch(n: int, rows: DataFrame) -> None:
        for _ in range(2):  # the second is a replay
            S.write_batch(out, rows.join(cache(), ["user_id"], "inner").select("event_id", "user_id", "c_mktsegment"), n, "lookup")

    batch(0, events.where("event_id % 4 = 0"))
    dim.upsert(people.where("user_id % 2 = 0").withColumn("c_mktsegment", F.lit("new")))
    batch(1, events.where("event_id % 4 = 2"))
    now[0] = 61.0
    batch(2, events.where("event_id % 2 = 1"))
    if cache.loads != 2:
        raise AssertionError(f"the dimension was read {cache.loads} times")
    return out.read()


@query(f"SELECT {ORDERS} FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL {TENTH}")
def premerged_read(spark: SparkSession, d: str) -> DataFrame:
    """Many small commits are merged before they are read."""
    rows, t = _tenth(read(spark, d, "orders")), _orders(spark, d)
    for i in range(6):
        t.upsert(rows.where(f"o_orderkey % 60 = {10 * i}"))
    out = t.read(premerge=4)
    if max(len(t.log.now(p).snapshot) for p in t.log.partitions()) > 4:
        raise AssertionError("nothing was merged")
    return out


@query("SELECT event_type, w AS window_start, COUNT(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM events) t WHERE w < (SELECT time_bucket(INTERVAL 1 HOUR, MAX(ts)) FROM events) - INTERVAL 10 MINUTE GROUP BY event_type, w HAVING w + INTERVAL 1 HOUR <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE")
def streamed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of a stream, emitted once the watermark has passed them, in a keyed table."""
    struct = T.StructType([T.StructField("event_type", T.StringType()), T.StructField("window_start", read(spark, d, "events").schema["ts"].dataType), T.StructField("n", T.LongType())])
    t = Table.create(spark, f"{workspace(spark)}/t", struct)
    _drained(spark, d, lambda s: S.write_stream(S.windowed_counts(s, "ts", "10 minutes", "1 hour", by=["event_type"]).select("event_type", "window_start", "n"), t, "windows"))
    return t.read()
