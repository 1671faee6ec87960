"""SQL statements over a catalog."""

import pytest

from mergelake.catalog import Catalog
from mergelake.table import TableError


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def lake(spark, tmp_path):
    made = Catalog(spark, str(tmp_path / "lake"))
    made.sql("CREATE TABLE people (id INT NOT NULL, name STRING, age INT, city STRING) USING lake PARTITIONED BY (city) TBLPROPERTIES ('hashPartitions' = 'id', 'hashBucketNum' = '2', 'note' = 'it''s; a (note)')")
    made.sql("INSERT INTO people VALUES (1, 'ann', 30, 'x'), (2, 'bob', 40, 'y'), (3, 'cy', NULL, 'x');")
    return made


def test_create_and_describe(lake):
    info = lake.table("people").info
    assert (info.ranges, info.keys, info.buckets, info.properties["note"]) == (["city"], ["id"], 2, "it's; a (note)")
    assert rows(lake.sql("DESCRIBE TABLE people")) == [("age", "int", True, ""), ("city", "string", True, "range"), ("id", "int", False, "key"), ("name", "string", True, "")]
    assert rows(lake.sql("SHOW PARTITIONS people")) == [("city=x",), ("city=y",)]
    lake.sql("CREATE TABLE IF NOT EXISTS people (a INT)")
    with pytest.raises(TableError):
        lake.sql("CREATE TABLE people (a INT)")
    with pytest.raises(TableError):
        lake.sql("CREATE TABLE other (a INT) AS SELECT 1 AS a")


def test_queries_name_tables(spark, lake):
    spark.range(2).createOrReplaceTempView("plain_view")
    assert rows(lake.sql("SELECT people.id, p.name FROM people, default.people p WHERE people.id = p.id AND people.age > 35")) == [(2, "bob")]
    assert rows(lake.sql("WITH people AS (SELECT 7 AS id) SELECT id FROM people")) == [(7,)]
    assert rows(lake.sql("SELECT v.id, 'FROM people' AS s FROM plain_view v LEFT JOIN people ON v.id = people.id -- FROM people")) == [(0, "FROM people"), (1, "FROM people")]
    assert rows(lake.sql("SELECT id FROM (SELECT id, age FROM people WHERE age IS DISTINCT FROM 30) q")) == [(2,), (3,)]


def test_insert_forms(lake):
    lake.sql("INSERT INTO people (city, id) SELECT 'z', 9")
    lake.sql("INSERT INTO people BY NAME SELECT 'y' AS city, 2 AS id, 'bo' AS name, 41 AS age")
    assert rows(lake.sql("SELECT * FROM people WHERE id IN (2, 9)")) == [(2, "bo", 41, "y"), (9, None, None, "z")]
    with pytest.raises(TableError):
        lake.sql("INSERT INTO people (city, id) SELECT 'z'")
    lake.sql("INSERT OVERWRITE people (SELECT 5, 'eve', 1, 'x')")
    assert rows(lake.sql("SELECT id FROM people WHERE city = 'x'")) == [(5,)]


def test_update_and_delete(lake):
    lake.sql("UPDATE people AS p SET p.age = coalesce(p.age, 0) + 1, name = upper(name) WHERE p.city = 'x'")
    assert rows(lake.sql("SELECT id, name, age FROM people")) == [(1, "ANN", 31), (2, "bob", 40), (3, "CY", 1)]
    lake.sql("DELETE FROM people WHERE people.age < 31")
    assert rows(lake.sql("SELECT id FROM people")) == [(1,), (2,)]
    lake.sql("DELETE FROM people")
    assert rows(lake.sql("SELECT id FROM people")) == []


def test_merge(spark, lake):
    spark.createDataFrame([(1, "anna", 31, "x"), (4, "di", 20, "y")], "id int, name string, age int, city string").createOrReplaceTempView("news")
    lake.sql("MERGE INTO people t USING news n ON t.id = n.id AND t.city = n.city WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *")
    assert rows(lake.sql("SELECT id, name FROM people")) == [(1, "anna"), (2, "bob"), (3, "cy"), (4, "di")]
    lake.sql("""MERGE INTO people USING (SELECT id, city, 'q' AS name FROM news) AS s ON people.id = s.id AND people.city = s.city
                WHEN MATCHED THEN UPDATE SET people.name = s.name WHEN NOT MATCHED THEN INSERT (id, city, name) VALUES (s.id, s.city, s.name)""")
    assert rows(lake.sql("SELECT id, name, age FROM people WHERE id IN (1, 4)")) == [(1, "q", 31), (4, "q", 20)]
    for clauses in ("WHEN MATCHED THEN UPDATE SET *", "WHEN MATCHED THEN DELETE", "WHEN MATCHED AND t.age > 3 THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *"):
        with pytest.raises(TableError):
            lake.sql(f"MERGE INTO people t USING news n ON t.id = n.id AND t.city = n.city {clauses}")


def test_alter_and_partitions(lake):
    lake.sql("ALTER TABLE people ADD COLUMNS (zip STRING, score FLOAT)")
    lake.sql("ALTER TABLE people ALTER COLUMN score TYPE DOUBLE")
    lake.sql("ALTER TABLE people DROP COLUMN name")
    assert lake.sql("SELECT * FROM people").columns == ["id", "age", "city", "zip", "score"]
    assert dict(lake.sql("SELECT * FROM people").dtypes)["score"] == "double"
    lake.sql("ALTER TABLE people SET TBLPROPERTIES ('a' = '1', 'b' = '2')")
    lake.sql("ALTER TABLE people UNSET TBLPROPERTIES ('a')")
    assert ("b", "2") in rows(lake.sql("SHOW TBLPROPERTIES people")) and lake.table("people").info.properties.get("a") is None
    lake.sql("ALTER TABLE people DROP PARTITION (city = 'x')")
    assert rows(lake.sql("SELECT id FROM people")) == [(2,)]
    for refused in ("ADD PARTITION (city = 'w')", "SET LOCATION '/tmp'", "RENAME TO folk"):
        with pytest.raises(TableError):
            lake.sql(f"ALTER TABLE people {refused}")
    lake.sql("TRUNCATE TABLE people")
    assert rows(lake.sql("SELECT id FROM people")) == []


def test_namespaces(lake):
    lake.sql("CREATE NAMESPACE sales")
    lake.sql("CREATE DATABASE IF NOT EXISTS sales")
    lake.sql("CREATE TABLE sales.copy PARTITIONED BY (city) AS SELECT id, city FROM people")
    lake.sql("USE sales")
    assert rows(lake.sql("SHOW NAMESPACES")) == [("default",), ("sales",)] and rows(lake.sql("SHOW TABLES IN sales")) == [("copy",)]
    assert rows(lake.sql("SELECT copy.id, p.name FROM copy JOIN default.people AS p USING (id) WHERE p.city = 'y'")) == [(2, "bob")]
    lake.sql("CREATE OR REPLACE TABLE copy AS SELECT 1 AS one")
    assert rows(lake.sql("TABLE copy")) == [(1,)]
    with pytest.raises(TableError):
        lake.sql("DROP NAMESPACE sales")
    lake.sql("DROP TABLE copy")
    lake.sql("DROP TABLE IF EXISTS copy")
    lake.sql("USE default")
    lake.sql("DROP NAMESPACE sales CASCADE")
    assert rows(lake.sql("SHOW DATABASES")) == [("default",)]


def test_procedures(lake):
    lake.sql("UPDATE people SET age = 99 WHERE city = 'x'")
    lake.sql("CALL rollback(table => 'people', partition_value => map('city', 'x'), version => 0)")
    assert rows(lake.sql("SELECT id, age FROM people")) == [(1, 30), (2, 40), (3, None)]
    lake.sql("CALL compaction(table => 'default.people')")
    assert rows(lake.sql("SELECT id FROM people")) == [(1,), (2,), (3,)]
    for wrong in ("CALL compaction()", "CALL nothing(table => 'people')", "INSERT people", "UPDATE people", ""):
        with pytest.raises(Exception):
            lake.sql(wrong)
