"""Namespaces and tables by name, kept as small files next to each other under one root."""

from __future__ import annotations

import shutil
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from mergelake import sql
from mergelake.operators import log as L
from mergelake.sources.store import Store
from mergelake.table import Table, TableError

DEFAULT = "default"


class Catalog:
    """Names are case-insensitive. ``namespace.table`` or ``table`` in the current namespace."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.store = spark, root.rstrip("/"), Store(spark, root)
        self.current = DEFAULT
        self.store.create({"properties": {}}, "_namespaces", f"{DEFAULT}.json")

    def _split(self, name: str) -> tuple[str, str]:
        space, _, table = name.lower().rpartition(".")
        return space or self.current, table

    # namespaces

    def create_namespace(self, name: str, if_not_exists: bool = False, **properties: str) -> None:
        if not self.store.create({"properties": properties}, "_namespaces", f"{name.lower()}.json") and not if_not_exists:
            raise TableError(f"there is a namespace {name}")

    def list_namespaces(self) -> list[str]:
        return [n[:-5] for n in self.store.names("_namespaces") if n.endswith(".json")]

    def drop_namespace(self, name: str, cascade: bool = False) -> None:
        name = name.lower()
        if name == DEFAULT or name not in self.list_namespaces():
            raise TableError(f"{name} cannot be dropped")
        tables = self.list_tables(name)
        if tables and not cascade:
            raise TableError(f"{name} has tables")
        for t in tables:
            self.drop_table(f"{name}.{t}")
        self.store.delete("_namespaces", f"{name}.json")

    def use(self, name: str) -> None:
        if name.lower() not in self.list_namespaces():
            raise TableError(f"no namespace {name}")
        self.current = name.lower()

    # tables

    def create_table(self, name: str, like: T.StructType | DataFrame, ranges: Iterable[str] = (), keys: Iterable[str] = (), buckets: int = 4, properties: dict[str, str] | None = None, path: str | None = None, if_not_exists: bool = False, comment: str | None = None) -> Table:
        space, table = self._split(name)
        if space not in self.list_namespaces():
            raise TableError(f"no namespace {space}")
        if table in self.list_tables(space):
            if if_not_exists:
                return self.table(name)
            raise TableError(f"there is a table {name}")
        path = path or f"{self.root}/{space}/{table}"
        made = Table.create(self.spark, path, like, ranges, keys, buckets, properties, table, comment)
        self.store.create({"path": path}, "_tables", space, f"{table}.json")
        return made

    def replace_table(self, name: str, like: T.StructType | DataFrame, **how) -> Table:
        space, table = self._split(name)
        if table in self.list_tables(space):
            self.drop_table(name)
        return self.create_table(name, like, **how)

    def list_tables(self, namespace: str | None = None) -> list[str]:
        return [n[:-5] for n in self.store.names("_tables", (namespace or self.current).lower()) if n.endswith(".json")]

    def exists(self, name: str) -> bool:
        space, table = self._split(name)
        return table in self.list_tables(space)

    def table(self, name: str) -> Table:
        space, table = self._split(name)
        if table not in self.list_tables(space):
            raise TableError(f"no table {name}")
        return Table(self.spark, self.store.read("_tables", space, f"{table}.json")["path"])

    def for_path(self, path: str) -> Table:
        return Table(self.spark, path)

    def drop_table(self, name: str) -> None:
        space, table = self._split(name)
        dropped = self.table(name)
        self.store.delete("_tables", space, f"{table}.json")
        for part in ("_meta", "_log", "_commits", "data"):
            dropped.store.delete(part)
        if dropped.store.local:
            shutil.rmtree(dropped.store.base, ignore_errors=True)

    def register_views(self, namespace: str | None = None) -> None:
        """Temporary views of all tables of a namespace, for spark.sql."""
        for t in self.list_tables(namespace):
            self.table(f"{namespace or self.current}.{t}").read().createOrReplaceTempView(t)

    def sql(self, statement: str) -> DataFrame | None:
        """Runs a statement over these tables, see :mod:`mergelake.sql`: rows for queries, SHOW and DESCRIBE, else None."""
        return sql.execute(self, statement)

    def statistics(self) -> DataFrame:
        """Tables, partitions, files and bytes of each namespace."""
        rows = []
        for space in self.list_namespaces():
            for name in self.list_tables(space):
                t = self.table(f"{space}.{name}")
                snapshots = {p: v.snapshot for p in t.log.partitions() if (v := t.log.latest(p))}
                files = [f for p, ids in snapshots.items() for _, f in t.log.active(p, ids)]
                rows.append((space, name, len(snapshots), len(files), sum(f.size for f in files)))
        return self.spark.createDataFrame(rows, "namespace string, table string, partitions long, files long, bytes long")

    def clean(self, now: int | None = None) -> dict[str, list[str]]:
        """Applies every table's time-to-live and removes files that no version names."""
        done = {}
        for space in self.list_namespaces():
            for name in self.list_tables(space):
                t = self.table(f"{space}.{name}")
                done[f"{space}.{name}"] = t.expire(now)
                t.vacuum((now or L.now_ms()) - 86_400_000)
        return done
