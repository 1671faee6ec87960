"""Table behaviour on small fixtures, and what is refused."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergelake import functions, streaming
from mergelake.catalog import Catalog
from mergelake.operators import log as L
from mergelake.operators import merging
from mergelake.operators.filters import conjuncts, parse_filter
from mergelake.operators.schema import SchemaError, merge
from mergelake.operators.vectors import VectorConfig, sign_bits
from mergelake.sources.scan import Scan
from mergelake.table import Table, TableError

SCHEMA = "range int, hash int, value int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def make(spark, tmp_path):
    n = iter(range(100))
    return lambda data, struct, **how: Table.create(spark, str(tmp_path / f"t{next(n)}"), spark.createDataFrame(data, struct), **how)


@pytest.fixture
def keyed(make):
    return make([(20201101, 1, 1), (20201101, 2, 2), (20201101, 3, 3), (20201102, 4, 4)], SCHEMA, ranges=["range"], keys=["hash"], buckets=2)


def test_upsert_same_columns(spark, keyed):
    keyed.upsert(spark.createDataFrame([(20201101, 1, 11), (20201101, 3, 33), (20201101, 4, 44)], SCHEMA))
    assert rows(keyed.read()) == [(20201101, 1, 11), (20201101, 2, 2), (20201101, 3, 33), (20201101, 4, 44), (20201102, 4, 4)]


def test_later_rows_of_one_batch_win(spark, keyed):
    keyed.upsert(spark.createDataFrame([(20201101, 1, i) for i in range(50)], SCHEMA).coalesce(1))
    assert rows(keyed.read("range = 20201101 AND hash = 1")) == [(20201101, 1, 49)]


def test_non_key_filter_does_not_change_the_winner(spark, keyed):
    keyed.upsert(spark.createDataFrame([(20201101, 1, 100)], SCHEMA))
    assert rows(keyed.read("value < 50 AND hash = 1")) == []


def test_upsert_other_columns_evolves(spark, keyed):
    more = spark.createDataFrame([(20201101, 2, "x")], "range int, hash int, note string")
    with pytest.raises(SchemaError):
        keyed.upsert(more)
    keyed.upsert(more, merge_schema=True)
    assert (20201101, 2, 2, "x") in rows(keyed.read())
    assert (20201102, 4, 4, None) in rows(keyed.read())


@pytest.mark.parametrize(("op", "want"), [("sum_all", 6), ("sum_last", 5), ("use_last", 3), ("use_last_not_null", 3)])
def test_merge_operators(spark, make, op, want):
    t = make([("a", 1), ("a", 2)], "k string, v int", keys=["k"], buckets=1, properties={"merge_operators": json.dumps({"v": op})})
    t.upsert(spark.createDataFrame([("a", 3)], "k string, v int"))
    assert rows(t.read()) == [("a", want)]


@pytest.mark.parametrize(("op", "want"), [("joined_all_by_comma", "a,b,c"), ("joined_last_by_semicolon", "b;c")])
def test_joined_operators(spark, make, op, want):
    t = make([(1, "a"), (1, "b")], "k int, v string", keys=["k"], buckets=1)
    t.upsert(spark.createDataFrame([(1, "c")], "k int, v string"))
    assert rows(t.read(operators={"v": op})) == [(1, want)]


def test_poison_and_missing_columns(spark, make):
    t = make([(1, 5, "x"), (2, None, "y")], "k int, v int, s string", keys=["k"], properties={"merge_operators": json.dumps({"v": "sum_all"})})
    t.upsert(spark.createDataFrame([(1, "z"), (2, "w")], "k int, s string"))  # lacks v: takes no part in the sum
    assert rows(t.read()) == [(1, 5, "z"), (2, None, "w")]
    t.upsert(spark.createDataFrame([(1, None)], "k int, v int"))
    assert rows(t.read()) == [(1, None, "z"), (2, None, "w")]


def test_user_operator_and_refusals(spark, make):
    merging.register("first_value", lambda values: F.element_at(values, 1))
    t = make([(1, 5)], "k int, v int", keys=["k"])
    t.upsert(spark.createDataFrame([(1, 6)], "k int, v int"))
    assert rows(t.read(operators={"v": "first_value"})) == [(1, 5)]
    with pytest.raises(ValueError):
        t.read(operators={"v": "none_such"})
    with pytest.raises(TableError):
        t.read(operators={"k": "sum_all"})
    with pytest.raises(TableError):
        make([(1,)], "v int").read(operators={"v": "sum_all"})


def test_partition_values_round_trip(spark, make):
    data = [("x,=/ y%", 1), ("", 2), (None, 3), ("ü", 4)]
    t = make(data, "r string, v int", ranges=["r"])
    assert rows(t.read()) == sorted(data, key=str)
    t.delete("v = 2")
    assert rows(t.read()) == sorted([d for d in data if d[1] != 2], key=str)


def test_partition_names():
    for values in ({"a": "1,2=3"}, {"a": None, "b": ""}, {}):
        assert L.partition_values(L.partition_name(values)) == values


def test_append_refused_with_keys(spark, keyed):
    with pytest.raises(TableError):
        keyed.append(spark.createDataFrame([(1, 1, 1)], SCHEMA))


def test_null_key_refused(spark, keyed):
    with pytest.raises(Exception, match="key is null"):
        keyed.upsert(spark.createDataFrame([(1, None, 1)], SCHEMA))


def test_invariant(spark, make):
    t = make([(1,)], "v int", properties={"invariant.v": "v > 0"})
    with pytest.raises(Exception, match="invariant"):
        t.append(spark.createDataFrame([(-1,)], "v int"))
    assert rows(t.read()) == [(1,)]


@pytest.mark.parametrize("condition", ["rand() > 0.5", "sum(value) > 1", "value IN (SELECT 1)"])
def test_bad_upsert_conditions(spark, keyed, condition):
    with pytest.raises(Exception):
        keyed.upsert(spark.createDataFrame([(1, 1, 1)], SCHEMA), condition)


def test_copy_on_write(spark, keyed):
    new = spark.createDataFrame([(20201101, 1, 10), (20201101, 9, 9)], SCHEMA)
    with pytest.raises(TableError):
        keyed.upsert(new, delta=False)
    keyed.upsert(new, "range = 20201101", delta=False)
    assert rows(keyed.read()) == [(20201101, 1, 10), (20201101, 2, 2), (20201101, 3, 3), (20201101, 9, 9), (20201102, 4, 4)]
    assert keyed.log.latest("range=20201101").op == L.UPDATE


@pytest.mark.parametrize("on", ["t.hash = s.hash AND t.value = s.value", "t.range = s.range", "t.hash > s.hash"])
def test_merge_into_refusals(spark, keyed, on):
    with pytest.raises(TableError):
        keyed.merge_into(spark.createDataFrame([(1, 1, 1)], SCHEMA), on)


def test_merge_into_clauses(spark, keyed):
    source = spark.createDataFrame([(20201101, 1, 7)], SCHEMA)
    with pytest.raises(TableError):
        keyed.merge_into(source, "t.hash = s.hash", update={"value": "s.value + 1"})
    keyed.merge_into(source, "t.hash = s.hash")
    assert (20201101, 1, 7) in rows(keyed.read())


def test_update_refusals(keyed):
    with pytest.raises(TableError):
        keyed.update({"hash": "1"})
    with pytest.raises(SchemaError):
        keyed.update({"none": "1"})


def test_delete_keeps_nulls(make):
    t = make([(1, None), (2, 5)], "k int, v int")
    t.delete("v > 1")
    assert rows(t.read()) == [(1, None)]


def test_delta_join_stays_equal(spark, make, tmp_path):
    right = make([("r1", "a"), ("r2", "b")], "hash_right string, v2 string", keys=["hash_right"], buckets=2)
    joined = Table.create(spark, str(tmp_path / "j"), T.StructType.fromDDL("hash_left int, hash_right string, v1 string, v2 string"), keys=["hash_left"], buckets=2)
    joined.join_with_tables_and_upsert(spark.createDataFrame([(1, "r1", "x"), (2, "r2", "y"), (3, "none", "z")], "hash_left int, hash_right string, v1 string"), [right])
    change = spark.createDataFrame([("r1", "A")], "hash_right string, v2 string")
    right.upsert(change)
    joined.upsert_on_join_key(change, ["hash_right"])
    assert rows(joined.read()) == [(1, "r1", "x", "A"), (2, "r2", "y", "b"), (3, "none", "z", None)]


def test_time_travel_and_rollback(spark, keyed):
    p = "range=20201101"
    first = keyed.log.latest(p).timestamp
    keyed.upsert(spark.createDataFrame([(20201101, 1, 11)], SCHEMA))
    assert (20201101, 1, 1) in rows(keyed.snapshot(first))
    assert rows(keyed.snapshot(first - 1)) == []
    assert rows(keyed.incremental(first + 1)) == [(20201101, 1, 11)] or (20201102, 4, 4) in rows(keyed.incremental(first + 1))
    assert rows(keyed.incremental(first + 1, 0, p)) == [(20201101, 1, 11)]
    keyed.rollback(p, 0)
    assert (20201101, 1, 1) in rows(keyed.read())
    assert [v.number for v in keyed.log.history(p)] == [0, 1, 2]
    with pytest.raises(TableError):
        keyed.rollback(p, 77)


def test_update_empties_incremental(spark, make):
    t = make([(1, 1)], "k int, v int")
    start = t.log.latest("-5").timestamp
    t.append(spark.createDataFrame([(2, 2)], "k int, v int"))
    t.update({"v": "v + 1"}, "k = 1")
    assert rows(t.incremental(start + 1)) == []


def test_conflicts(spark, make):
    t = make([(1, 1)], "k int, v int", keys=["k"])
    read = t.log.latest("-5").number
    t.upsert(spark.createDataFrame([(2, 2)], "k int, v int"))
    with pytest.raises(L.CommitConflict):  # an update that read before the upsert
        t.log.replace({"-5": L.Commit(L.new_id(), L.UPDATE, [], L.now_ms())}, {"-5": read}, keep_unread=False)
    assert t.log.replace({"-5": L.Commit(L.new_id(), L.COMPACTION, [], L.now_ms())}, {"-5": read}, keep_unread=True) == {"-5"}
    kept = t.log.latest("-5")
    assert len(kept.snapshot) == 2  # what came in between stays
    assert t.log.replace({"-5": L.Commit(L.new_id(), L.COMPACTION, [], L.now_ms())}, {"-5": read}, keep_unread=True) == set()
    assert t.log.latest("-5").number == kept.number  # a second compaction gives way


def test_create_only_once(tmp_path, spark):
    from mergelake.sources.store import Store

    store = Store(spark, str(tmp_path))
    assert store.create({"a": 1}, "x", "y.json")
    assert not store.create({"a": 2}, "x", "y.json")
    assert store.read("x", "y.json") == {"a": 1}


def test_levelled_compaction_keeps_order(spark, make):
    t = make([(1, 0), (2, 0)], "k int, v int", keys=["k"], buckets=1)
    for i in range(1, 6):
        t.upsert(spark.createDataFrame([(1, i)], "k int, v int"))
        t.compact_levels(file_limit=3)
    assert rows(t.read()) == [(1, 5), (2, 0)]
    assert len(t.log.latest("-5").snapshot) < 6


def test_compaction_trigger_and_ttl(spark, make):
    t = make([(1, 1)], "k int, v int", properties={"partition.ttl": "1"})
    assert t.needs_compaction(2) == []
    t.append(spark.createDataFrame([(2, 2)], "k int, v int"))
    assert t.needs_compaction(2) == ["-5"]
    assert t.expire() == []
    assert t.expire(L.now_ms() + 2 * 86_400_000) == ["-5"]
    assert rows(t.read()) == []


def test_schema_rules(spark, make):
    a, b = T.StructType.fromDDL("x int, s struct<a:int>"), T.StructType.fromDDL("x smallint, s struct<a:int,b:string>, y string")
    assert merge(a, b).simpleString() == "struct<x:int,s:struct<a:int,b:string>,y:string>"
    with pytest.raises(SchemaError):
        merge(a, T.StructType.fromDDL("x string"))
    t = make([(1, "a")], "k int, v string", keys=["k"])
    for bad in (lambda: t.change_column("k", T.LongType()), lambda: t.change_column("v", T.IntegerType()), lambda: t.drop_columns("k"), lambda: t.add_columns(T.StructField("V", T.StringType()))):
        with pytest.raises(SchemaError):
            bad()
    assert not t.schema["k"].nullable and t.schema["v"].nullable


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    c.create_namespace("s")
    t = c.create_table("s.T", spark.createDataFrame([(1,)], "a int"))
    assert c.exists("S.t") and rows(c.table("s.t").read()) == [(1,)] and rows(c.for_path(t.path).read()) == [(1,)]
    with pytest.raises(TableError):
        c.create_table("s.t", t.schema)
    with pytest.raises(TableError):
        c.drop_namespace("s")
    c.replace_table("s.t", spark.createDataFrame([("x",)], "b string"))
    assert rows(c.table("s.t").read()) == [("x",)]
    assert c.statistics().count() == 1
    c.drop_namespace("s", cascade=True)
    assert c.list_namespaces() == ["default"]


def test_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    assert rows(df.where(parse_filter("eq(s,null)"))) == [(2, None)]
    assert rows(df.where(parse_filter("or(gteq(n,2),eq(s,'a'))"))) == [(1, "a"), (2, None)]
    assert df.where(parse_filter("unknown(n,1)")).count() == 2
    assert conjuncts("a between 1 and 2 and b = ' and ' and (c or d and e)") == ["a between 1 and 2", "b = ' and '", "(c or d and e)"]


def test_scan(spark, keyed):
    s = Scan(keyed).select("hash")
    assert rows(s.with_partitions(range=20201102).to_df()) == [(4,)]
    assert sum(s.shard(i, 2).count_rows() for i in range(2)) == 4
    assert s.head(2).num_rows == 2 and sum(b.num_rows for b in s.to_batches(3)) == 4


def test_sink_is_idempotent(spark, make):
    t = make([(1, 1)], "k int, v int", keys=["k"])
    batch = spark.createDataFrame([(2, 2)], "k int, v int")
    assert streaming.write_batch(t, batch, 0, "q") and not streaming.write_batch(t, batch, 0, "q")
    assert streaming.write_batch(t, batch, 0, "other")
    with pytest.raises(TableError):
        streaming.write_batch(make([(1,)], "v int"), batch, 0, "q", "update")


def test_watermark_windows(spark):
    data = spark.createDataFrame([(100,), (104,), (123,), (140,)], "time long").select(F.timestamp_seconds("time").alias("ts"))
    found = streaming.windowed_counts(data, "ts", "10 seconds", "5 seconds").select(F.unix_seconds(F.col("window_start")), "n")
    assert rows(found) == [(100, 2), (120, 1), (140, 1)]


def test_functions(spark):
    functions.register(spark)
    r = spark.sql("SELECT hamming_distance(array(5L, 1L), array(1L, 2L)) h, cosine_distance(array(1D, 0D), array(-1D, 0D)) c, squared_distance(array(1D), array(3D)) q").first()
    assert (r["h"], r["c"], r["q"]) == (3, 0.0, 4.0)
    with pytest.raises(Exception, match="different lengths"):
        spark.range(1).select(functions.hamming_distance(F.array(F.lit(1).cast("long")), F.array(F.lit(1).cast("long"), F.lit(1).cast("long")))).collect()
    assert spark.range(1).select(sign_bits(F.array(F.lit(1.0), F.lit(-1.0), F.lit(2.0)), 3)[0]).first()[0] == 5
    assert VectorConfig.parse("v:8:16, w:4")[0].nlist == 16
    with pytest.raises(ValueError):
        VectorConfig.parse("v")


def test_upserts_over_a_compacted_base(spark, keyed):
    keyed.compact()
    keyed.upsert(spark.createDataFrame([(20201101, 1, 10), (20201101, 1, 11), (20201103, 7, 7)], SCHEMA).coalesce(1))
    df = keyed.read()
    assert "LeftAnti" not in df._jdf.queryExecution().toString()  # a partition without a base: merged as a whole
    assert rows(df) == [(20201101, 1, 11), (20201101, 2, 2), (20201101, 3, 3), (20201102, 4, 4), (20201103, 7, 7)]
    keyed.compact()
    keyed.upsert(spark.createDataFrame([(20201101, 1, 12), (20201102, 9, 9)], SCHEMA))
    df = keyed.read()
    assert "LeftAnti" in df._jdf.queryExecution().toString()
    assert rows(df) == [(20201101, 1, 12), (20201101, 2, 2), (20201101, 3, 3), (20201102, 4, 4), (20201102, 9, 9), (20201103, 7, 7)]
    keyed.upsert(spark.createDataFrame([(20201101, 2)], "range int, hash int"))  # lacks a column
    assert (20201101, 2, 2) in rows(keyed.read())


def test_format_by_path(spark, keyed, tmp_path):
    from mergelake.sources.datasource import TableSource

    spark.dataSource.register(TableSource)
    keyed.upsert(spark.createDataFrame([(20201101, 1, 11), (20201101, 9, 9)], SCHEMA))
    keyed.upsert(spark.createDataFrame([(20201101, 2)], "range int, hash int"))  # lacks value
    assert rows(spark.read.format("mergelake").load(keyed.path)) == rows(keyed.read())

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for text in ("range = 20201102", "hash IN (1, 9)", "hash = 2 AND value > 0", "value = 11", "range = 1"):
        assert rows(spark.read.format("mergelake").option("push_filters", "true").load(keyed.path).where(text)) == rows(keyed.read(text)), text
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")

    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def drain():
        stream = spark.readStream.format("mergelake").load(keyed.path)
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
        return spark.read.parquet(out)

    assert rows(drain()) == rows(keyed.read())
    keyed.upsert(spark.createDataFrame([(20201102, 4, 44)], SCHEMA))
    keyed.compact()
    assert rows(drain().subtract(spark.createDataFrame([(20201102, 4, 4)], SCHEMA)).where("hash = 4")) == [(20201102, 4, 44)]


@pytest.mark.parametrize(("bits", "metric", "rotator"), [(1, "L2", "FhtKac"), (4, "InnerProduct", "FhtKac"), (7, "L2", "Matrix")])
def test_vector_codes_and_lists(spark, tmp_path, bits, metric, rotator):
    """Every place has lists of its own; a partition can be searched alone; estimates choose what exact distances then rank."""
    import numpy as np

    from mergelake.operators.vectors import Quantiser, VectorIndex

    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 24))
    config = VectorConfig("v", 24, nlist=8, bits=bits, metric=metric, rotator=rotator)
    q = Quantiser(config)
    codes, length, inverse, offset = q.encode(x, q.rotate(np.zeros((1, 24))).repeat(600, 0))
    estimated = length * inverse * (q.vectors(codes) @ q.rotate(x[:1])[0])
    error = np.abs(estimated - x @ x[0]).std() / (x @ x[0]).std()
    assert error < {1: 0.9, 4: 0.15, 7: 0.02}[bits]
    assert (q.unpack(q.pack(codes)) == codes).all()
    df = spark.createDataFrame([(i, v.tolist(), f"p{i % 2}", i % 3) for i, v in enumerate(x)] + [(900, None, "p0", 0), (901, [1.0], "p0", 0)], "k long, v array<double>, part string, bucket int")
    index = VectorIndex(spark, f"file://{tmp_path}/v", config, "k")
    index.build(df.where("k < 500 OR k >= 900"))
    index.insert(df.where("k >= 500 AND k < 900").withColumn("bucket", F.col("bucket") + F.when(F.col("k") > 580, 3).otherwise(0)))  # also places that are new
    near = x @ x[3] if metric == "InnerProduct" else -((x - x[3]) ** 2).sum(1)
    want = [int(i) for i in np.argsort(-near)[:10]]
    assert [r["k"] for r in index.search(x[3].tolist(), 10, nprobe=8, rerank=60).collect()] == want
    half = [int(i) for i in np.argsort(-near) if i % 2][:10]
    assert [r["k"] for r in index.search(x[3].tolist(), 10, nprobe=8, part="p1", rerank=60).collect()] == half
    some = {r["k"] for r in index.search(x[3].tolist(), 10, nprobe=4).collect()}
    assert len(some) == 10 and len(some & set(want)) >= 4


def test_unknown_vector_metrics_are_rejected(spark):
    """Cosine would rank by the raw product, which is wrong for vectors of unequal length."""
    from mergelake.operators.vectors import exact_top_k

    for made in (lambda: VectorConfig.parse("v:2:4:7:Cosine"), lambda: VectorConfig("v", 2, metric="Cosine")):
        with pytest.raises(ValueError, match="Cosine"):
            made()
    with pytest.raises(ValueError, match="Cosine"):
        exact_top_k(spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>"), "v", [1.0, 0.0], 1, "Cosine")
    assert [c.metric for c in VectorConfig.parse("v:2:4:7:L2,w:2:4:7:InnerProduct")] == ["L2", "InnerProduct"]
