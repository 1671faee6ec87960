"""Table functions that make test data by rule: the same rows for the same arguments on any cluster, in SQL and as DataFrames.

Each is a SQL table function of Spark's own, so rows are made where they are used, in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The lists that generated columns take their values from.
STATUSES, PRIORITIES, FLAGS = ("F", "O", "P"), ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), ("A", "N", "R")


def _pick(values: tuple[str, ...], seed: str) -> str:
    return f"element_at(array({', '.join(repr(v) for v in values)}), cast({seed} % {len(values)} AS INT) + 1)"


_TABLES = {
    "make_customers": ("c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE", "id + 1, concat('Customer#', lpad(cast(id + 1 AS STRING), 9, '0')), cast(id * 7919 % 25 AS INT), (id * 104729 % 1100000 - 100000) / 100D"),
    "make_orders": ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderpriority STRING", f"id + 1, id * 15485863 % greatest(n div 10, 1) + 1, {_pick(STATUSES, 'id * 31')}, (id * 32452843 % 50000000) / 100D, {_pick(PRIORITIES, 'id * 17')}"),
    "make_lines": ("l_orderkey BIGINT, l_linenumber INT, l_quantity INT, l_returnflag STRING", f"id div 4 + 1, cast(id % 4 AS INT) + 1, cast(id * 6151 % 50 AS INT) + 1, {_pick(FLAGS, 'id * 13')}"),
}


#: Rows that one row of the first expansion stands for.
RUN = 65_536


def register(spark: SparkSession) -> None:
    """Makes the functions callable as ``SELECT * FROM make_orders(1000)`` in this session; runs of rows are dealt to tasks."""
    for name, (columns, body) in _TABLES.items():
        runs = f"SELECT /*+ REPARTITION(run) */ run FROM (SELECT explode(sequence(0L, ({name}.n - 1) div {RUN})) AS run WHERE {name}.n > 0)"
        rows = f"SELECT id, {name}.n AS n FROM ({runs}) LATERAL VIEW explode(sequence(run * {RUN}, least({name}.n, (run + 1) * {RUN}) - 1)) AS id"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(n BIGINT) RETURNS TABLE ({columns}) RETURN SELECT {body} FROM ({rows})")


def generated(spark: SparkSession, name: str, rows: int) -> DataFrame:
    """The rows of a table function as a DataFrame over Spark's own range."""
    columns, body = _TABLES[name]
    spark.range(rows).selectExpr("id", f"{rows}L AS n").createOrReplaceTempView(view := f"rows_of_{name}")
    return spark.sql(f"SELECT {body} FROM {view}").toDF(*[c.split()[0] for c in columns.split(", ")])
