"""The log under crashes and races, predicates under pruning, levels, and the plans of reads."""

import random
import re

import pytest
from pyspark.sql import functions as F

from mergelake import streaming
from mergelake.operators import log as L
from mergelake.operators.filters import conjuncts, prune
from mergelake.sources.scan import Scan
from mergelake.sources.store import Store
from mergelake.table import Table


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def make(spark, tmp_path):
    n = iter(range(100))
    return lambda data, struct, **how: Table.create(spark, str(tmp_path / f"t{next(n)}"), spark.createDataFrame(data, struct), **how)


# predicates


def test_conjuncts_are_not_cut_beside_or():
    for text in ("p = 'a' AND v > 5 OR v < 2", "a = 1 or b = 2 and c = 3", "x between 1 and 2 or y = 3 and z = 4"):
        assert conjuncts(text) == [text]
    quoted = ["p = \"a or b\"", "`x and y` = 1", "q = 'it\\'s and'", "q = 'it''s or'", "r = 2"]
    assert conjuncts(" and ".join(quoted)) == quoted
    assert conjuncts("case when a and b then 1 else 2 end = 1 and c = 1") == ["case when a and b then 1 else 2 end = 1", "c = 1"]


def conditions(seed):
    r = random.Random(seed)

    def atom():
        return r.choice([
            lambda: f"p {r.choice(['=', '<>', '<', '>='])} '{r.choice('abc')}'", lambda: f"q = {r.choice(['1', '01', '2', '-3'])}", lambda: f"v {r.choice(['>', '<='])} {r.randint(0, 9)}", lambda: f"v BETWEEN {r.randint(0, 4)} AND {r.randint(4, 9)}",
            lambda: f"p IN ('{r.choice('abc')}', 'b')", lambda: "p IS NULL", lambda: f"k % {r.randint(2, 4)} = 1", lambda: f"q = {r.randint(1, 3)} AND p = '{r.choice('abc')}'", lambda: "CASE WHEN p = 'a' AND v > 3 THEN true ELSE q = 2 END",
        ])()

    def tree(depth):
        if not depth or r.random() < 0.3:
            return atom()
        kind = r.choice(["and", "or", "AND", "not", "brackets"])
        if kind == "not":
            return f"NOT ({tree(depth - 1)})"
        if kind == "brackets":
            return f"({tree(depth - 1)})"
        return f"{tree(depth - 1)} {kind} {tree(depth - 1)}"

    return [tree(3) for _ in range(25)]


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_pruned_reads_are_unpruned_reads(spark, make, keys):
    """Random conditions: read gives what where gives, and delete leaves the rest."""
    data = [(p, q, 10 * i + j, (7 * i + 3 * j) % 10) for i, (p, q) in enumerate([("a", 1), ("a", 2), ("b", 1), ("c", -3), (None, 2)]) for j in range(4)]
    t = make(data, "p string, q int, k int, v int", ranges=["p", "q"], keys=keys)
    whole = t.read().cache()
    for text in conditions(len(keys) + 3):
        assert rows(t.read(text)) == rows(whole.where(text)), text
        may = set(prune(spark, t.schema, ["p", "q"], t.log.partitions(), text))
        assert {L.partition_name({"p": r["p"], "q": str(r["q"])}) for r in whole.where(text).collect()} <= may, text
    text = "p = 'a' AND v > 5 OR v < 2"
    want = rows(whole.where(f"NOT coalesce({text}, false)"))
    t.update({"v": "v + 100"}, text)
    assert rows(t.read("v >= 100").select("p", "q", "k", F.col("v") - 100)) == rows(whole.where(text))
    t.delete("v >= 100")
    assert rows(t.read()) == want


def test_integer_partitions_by_any_spelling(make):
    t = make([(1, 10), (2, 20)], "p int, v int", ranges=["p"])
    assert rows(t.read("p = 01")) == [(1, 10)] and rows(t.read("p = '1'")) == [(1, 10)]


# one commit for all partitions


class Crash(Exception):
    pass


@pytest.fixture
def crash(monkeypatch):
    """The next record is not written, or is written and its writer dies."""
    plain = Store.create

    def arm(after):
        def create(self, value, *parts):
            if parts[0] == "_log":
                monkeypatch.setattr(Store, "create", plain)
                if after:
                    plain(self, value, *parts)
                raise Crash
            return plain(self, value, *parts)

        monkeypatch.setattr(Store, "create", create)

    return arm


OPERATIONS = {
    "append": (False, lambda t, df: t.append(df)), "overwrite": (False, lambda t, df: t.overwrite(df)), "whole": (False, lambda t, df: t.overwrite(df, whole=True)), "upsert": (True, lambda t, df: t.upsert(df)), "copy": (True, lambda t, df: t.upsert(df, delta=False, full_scan=True)),
    "update": (False, lambda t, df: t.update({"v": "-1"}, "v > 1")), "delete": (False, lambda t, df: t.delete("v > 1")), "delete_partitions": (False, lambda t, df: t.delete("p IN ('a', 'b')")), "compact": (True, lambda t, df: t.compact()), "truncate": (False, lambda t, df: t.truncate()),
}


@pytest.mark.parametrize("name", sorted(OPERATIONS))
def test_crashes_leave_all_or_nothing(spark, make, crash, name):
    keyed, run = OPERATIONS[name]
    struct, news = "p string, k int, v int", [("a", 1, 5), ("b", 2, 6), ("c", 9, 9)]
    pair = [make([("a", 1, 1), ("b", 2, 2), ("c", 3, 3)], struct, ranges=["p"], keys=["k"] if keyed else []) for _ in range(2)]
    for t in pair:
        (t.upsert if keyed else t.append)(spark.createDataFrame([("a", 4, 4), ("b", 5, 5)], struct))
    run(pair[1], spark.createDataFrame(news, struct))
    before, after = rows(pair[0].read()), rows(pair[1].read())
    crash(False)
    with pytest.raises(Crash):
        run(pair[0], spark.createDataFrame(news, struct))
    assert rows(Table(spark, pair[0].path).read()) == before
    crash(True)
    with pytest.raises(Crash):
        run(pair[0], spark.createDataFrame(news, struct))
    assert rows(Table(spark, pair[0].path).read()) == after


@pytest.mark.parametrize("after", [False, True])
def test_sink_batch_survives_a_crash(spark, make, crash, after):
    """A replayed batch is there once, whole, over several partitions; an empty one counts as committed."""
    t = make([("a", 1, 1)], "p string, k int, v int", ranges=["p"], keys=["k"])
    batch = spark.createDataFrame([("a", 1, 2), ("b", 2, 2), ("c", 3, 3)], t.schema)
    crash(after)
    with pytest.raises(Crash):
        streaming.write_batch(t, batch, 0, "q")
    t = Table(spark, t.path)
    assert streaming.write_batch(t, batch, 0, "q") is not after
    assert rows(t.read()) == [("a", 1, 2), ("b", 2, 2), ("c", 3, 3)]
    assert streaming.write_batch(t, batch.limit(0), 1, "q") and not streaming.write_batch(t, batch, 1, "q")
    for p in t.log.partitions():
        t.cleanup(p, L.now_ms() + 1000)
    assert not streaming.write_batch(Table(spark, t.path), batch, 1, "q")  # batches outlive versions


def test_failed_target_is_polled_again(spark, make):
    source = make([(1, 1)], "k int, v int", keys=["k"])
    reader = streaming.ChangeReader(source)
    assert rows(reader.poll()) == rows(reader.poll()) == [(1, 1)]
    reader.done()
    assert reader.poll() is None


def test_checkpoints_hold_the_state(spark, make, monkeypatch):
    monkeypatch.setattr(L, "CHECKPOINT_AFTER", 3)
    t = make([("a", 0, 0)], "p string, k int, v int", ranges=["p"], keys=["k"])
    for i in range(8):
        t.upsert(spark.createDataFrame([("ab"[i % 2], i % 3, i)], t.schema))
        if i == 4:
            t.compact()
    points = [n for n in t.store.names("_log") if "checkpoint" in n]
    fresh = Table(spark, t.path)
    assert points and rows(fresh.read()) == rows(t.read())
    for p in t.log.partitions():
        assert fresh.log.history(p) == t.log.history(p)
        assert all(fresh.log.commit(p, c) == t.log.commit(p, c) for v in t.log.history(p) for c in v.snapshot)


def test_two_writers(spark, make):
    """Upserts of two writers that looked at the same time are both there; numbers never fork."""
    t = make([("a", 0, 0)], "p string, k int, v int", ranges=["p"], keys=["k"])
    other = Table(spark, t.path)
    other.log.partitions()
    t.upsert(spark.createDataFrame([("a", 1, 1)], t.schema))
    other.upsert(spark.createDataFrame([("a", 2, 2), ("b", 3, 3)], t.schema))
    assert rows(t.read()) == rows(other.read()) == [("a", 0, 0), ("a", 1, 1), ("a", 2, 2), ("b", 3, 3)]


# compaction


def test_clean_old_beside_a_concurrent_update(spark, make, monkeypatch):
    """A compaction that lost deletes nothing."""
    t = make([(1, 1)], "k int, v int")
    t.append(spark.createDataFrame([(2, 2)], t.schema))
    plain = Table._rewrite

    def slow(self, *args, **how):
        monkeypatch.setattr(Table, "_rewrite", plain)
        Table(spark, t.path).update({"v": "9"}, "k = 2")
        return plain(self, *args, **how)

    monkeypatch.setattr(Table, "_rewrite", slow)
    assert t.compact(clean_old=True) == 0
    assert rows(t.read()) == [(1, 1), (2, 9)]
    assert t.compact(clean_old=True) == 1
    assert rows(t.read()) == [(1, 1), (2, 9)]
    assert t.log.numbers("-5") == [3] and {f.path for _, f in t.log.active("-5", t.log.latest("-5").snapshot)} <= {f for f, _ in t.store.files("data")}


def test_levels_keep_absent_columns(spark, make):
    t = make([(1, 10, 100), (2, 20, 200)], "k int, a int, b int", keys=["k"], buckets=2)
    t.compact()
    for round_ in range(3):
        for i in range(3):
            t.upsert(spark.createDataFrame([(1, 10 * round_ + i)], "k int, a int"))
        t.upsert(spark.createDataFrame([(2, 7)], "k int, b int"))
        t.compact_levels(file_limit=2)
        assert rows(t.read()) == [(1, 10 * round_ + 2, 100), (2, 20, 7)]


def test_levels_rise(spark, make):
    t = make([(0, 0)], "k int, v int", keys=["k"], buckets=1)
    reached = set()
    for i in range(20):
        t.upsert(spark.createDataFrame([(i, i)], "k int, v int"))
        reached |= set(t.compact_levels(file_limit=2).values())
    assert {1, 2, 3} <= reached
    assert rows(t.read()) == sorted([(i, i) for i in range(20)], key=str)


def test_incremental_and_streams_after_levels(spark, make):
    t = make([(0, 0)], "k int, v int", keys=["k"], buckets=1)
    reader = streaming.ChangeReader(t)
    assert rows(reader.poll()) == [(0, 0)]
    reader.done()
    seen, start = [], t.log.latest("-5").timestamp + 1
    for i in range(1, 8):
        t.upsert(spark.createDataFrame([(i, i)], "k int, v int"))
        if i % 2:
            t.compact_levels(file_limit=3)
        if i % 3 == 0:
            seen += rows(reader.poll())
            reader.done()
    seen += rows(reader.poll())
    reader.done()
    assert seen == [(i, i) for i in range(1, 8)] and reader.poll() is None
    assert rows(t.incremental(start)) == [(i, i) for i in range(1, 8)]


# plans


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def big(spark, tmp_path):
    return Table.create(spark, str(tmp_path / "big"), spark.range(2000).selectExpr("id AS k", "id % 3 AS p", "id AS v", "string(id) AS s"), ranges=["p"], keys=["k"], buckets=4)


def test_merge_on_read_without_exchange(spark, big):
    big.upsert(spark.range(0, 2000, 7).selectExpr("id AS k", "id % 3 AS p", "-id AS v", "'x' AS s"))
    df = big.read().select("k", "v")
    assert "Exchange" not in (text := plan(df)) and re.search(r"ReadSchema: struct<(?=[^>]*k:bigint)(?=[^>]*v:bigint)(?![^>]*s:string)", text)
    assert df.where("v < 0").count() == 285
    big.upsert(spark.range(0, 2000, 11).selectExpr("id AS k", "id % 3 AS p", "'y' AS s"))  # another operator path: absent columns
    assert "Exchange" not in plan(big.read())
    big.compact()
    big.upsert(spark.range(0, 2000, 13).selectExpr("id AS k", "id % 3 AS p", "0L AS v", "'z' AS s"))
    assert "Exchange hash" not in plan(big.read())
    assert big.read().count() == 2000


def test_key_joins_and_aggregates_without_exchange(spark, big):
    other = big.read().groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(big.read().join(other, "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in text and "SortMergeJoin" in text


def test_bucket_pruning_by_the_scan(big):
    assert "SelectedBucketsCount: 1 out of 4" in plan(big.read("k = 5"))
    assert rows(big.read("k IN (5, 6)").select("k")) == [(5,), (6,)]


def test_writers_sort_once(spark, big):
    """The writer finds the rows in its order, so no second sort can disturb rows of equal keys."""
    big.upsert(spark.range(10).selectExpr("id AS k", "id % 3 AS p", "id AS v", "'x' AS s"))
    store = spark._jsparkSession.sharedState().statusStore()
    runs = [store.execution(i).get() for i in range(store.executionsCount() - 1, max(-1, store.executionsCount() - 40), -1) if store.execution(i).isDefined()]
    text = next(r.physicalPlanDescription() for r in runs if "InsertIntoHadoopFsRelationCommand" in r.physicalPlanDescription())
    assert text.count("Sort [") == 1 or len(re.findall(r"\(\d+\) Sort", text)) == 1, text


def test_shards_read_their_buckets_alone(big):
    world, seen = 3, []
    for rank in range(world):
        df = Scan(big).shard(rank, world).to_df()
        own = [f for f in df.inputFiles()]
        assert len(own) < 12 and "Exchange" not in plan(df)
        seen += own
    assert len(seen) == len(set(seen)) == 12
    assert sum(Scan(big).shard(i, world).count_rows() for i in range(world)) == 2000


def test_update_looks_once(spark, make):
    t = make([(i, i % 5) for i in range(50)], "k int, v int")
    for i in range(3):
        t.append(spark.createDataFrame([(100 + i, i)], t.schema))
    before = {f.path for _, f in t.log.active("-5", t.log.latest("-5").snapshot)}
    t.update({"v": "v + 1"}, "k = 101")
    after = {f.path for _, f in t.log.active("-5", t.log.latest("-5").snapshot)}
    assert len(before - after) == 1 and rows(t.read("k >= 100")) == [(100, 0), (101, 2), (102, 2)]


# stores


def test_hadoop_store(spark, tmp_path, monkeypatch):
    """Tables on a store that is reached through Hadoop alone, as any remote one is."""
    plain = Store.__init__

    def remote(self, spark, root):
        monkeypatch.setattr("mergelake.sources.store.urlsplit", lambda p: type("S", (), {"scheme": "far", "path": p})())
        plain(self, spark, root)
        monkeypatch.undo()

    store = Store.__new__(Store)
    remote(store, spark, f"file://{tmp_path}/s")
    assert not store.local and store.names("x") == []
    assert store.create({"a": 1}, "x", "y.json") and not store.create({"a": 2}, "x", "y.json")
    assert store.read("x", "y.json") == {"a": 1} and store.names("x") == ["y.json"] and store.exists("x", "y.json")
    spark.range(3).write.parquet(f"file://{tmp_path}/s/data/commit=1")
    assert [p.startswith("data/commit=1/part-") and n > 0 for p, n in store.files("data")].count(True) == len(store.files("data")) > 0
    store.move("x/y.json", "z/w.json")
    store.delete("z", "w.json")
    assert not store.exists("z", "w.json") and store.names("x") == []
