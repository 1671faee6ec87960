"""Tables: append and primary-key tables with range partitions, merge-on-read, DML, time travel and maintenance."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, replace
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergelake.operators import log as L
from mergelake.operators import merging, schema
from mergelake.operators.filters import conjuncts, prune, split_condition, without_deleted
from mergelake.sources import bucketed
from mergelake.sources.store import Store

#: Table properties.
CDC_COLUMN, PARTITION_TTL, COMPACTION_TTL, KEEP_ONE, DROPPED, MERGE_OPS, VECTOR_COLUMNS = "cdc_change_column", "partition.ttl", "compaction.ttl", "only_save_once_compaction", "dropped_columns", "merge_operators", "vector_index_columns"
ROW_KINDS = {"+I": "insert", "+U": "update", "-U": "delete", "-D": "delete"}


class TableError(ValueError):
    """A use that the kind of table does not allow."""


@dataclass
class TableInfo:
    name: str
    schema: str
    ranges: list[str] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)
    buckets: int = 1
    properties: dict[str, str] = field(default_factory=dict)
    comment: str | None = None

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))


class Table:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.store = Store(spark, path)
        self.log = L.Log(self.store)
        self._info: tuple[str, TableInfo] | None = None
        if not self.store.names("_meta"):
            raise TableError(f"no table at {path}")

    # ---- creation and metadata -------------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, like: T.StructType | DataFrame, ranges: Iterable[str] = (), keys: Iterable[str] = (), buckets: int = 4, properties: dict[str, str] | None = None, name: str = "", comment: str | None = None) -> Table:
        """``like``: a schema, or rows that become the first commit."""
        struct = like if isinstance(like, T.StructType) else like.schema
        schema.check_names(struct)
        ranges, keys = list(ranges), list(keys)
        for column in [*ranges, *keys]:
            if schema.find(struct, column) is None:
                raise TableError(f"no column {column}")
        if set(ranges) & set(keys):
            raise TableError("a column is a range column or a key, not both")
        info = TableInfo(name or os.path.basename(path.rstrip("/")), schema.normalised(struct, keys).json(), ranges, keys, max(1, buckets) if keys else 1, dict(properties or {}), comment)
        if not Store(spark, path).create(asdict(info), "_meta", f"{0:020d}.json"):
            raise TableError(f"there is a table at {path}")
        table = cls(spark, path)
        if isinstance(like, DataFrame):
            table._add(table._prepared(like, False), L.MERGE if keys else L.APPEND)
        return table

    @property
    def info(self) -> TableInfo:
        name = self.store.names("_meta")[-1]
        if self._info is None or self._info[0] != name:
            self._info = (name, TableInfo(**self.store.read("_meta", name)))
        return replace(self._info[1])

    def _change(self, **new) -> None:
        names = self.store.names("_meta")
        made = replace(TableInfo(**self.store.read("_meta", names[-1])), **new)
        if not self.store.create(asdict(made), "_meta", f"{int(names[-1][:-5]) + 1:020d}.json"):
            raise L.CommitConflict("another writer changed the table's schema or properties")

    @property
    def schema(self) -> T.StructType:
        info = self.info
        dropped = set(json.loads(info.properties.get(DROPPED, "[]")))
        return T.StructType([f for f in info.struct.fields if f.name not in dropped])

    def set_properties(self, **properties: str) -> None:
        self._change(properties=self.info.properties | properties)

    def unset_properties(self, *names: str) -> None:
        self._change(properties={k: v for k, v in self.info.properties.items() if k not in names})

    def add_columns(self, *fields: T.StructField) -> None:
        new = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
        if taken := [f.name for f in new.fields if schema.find(self.info.struct, f.name)]:
            raise schema.SchemaError(f"there is a column {taken[0]}")
        self._change(schema=schema.merge(self.info.struct, new).json())

    def change_column(self, name: str, kind: T.DataType) -> None:
        info = self.info
        old = schema.find(info.struct, name)
        if old is None:
            raise schema.SchemaError(f"no column {name}")
        if old.name in info.ranges + info.keys and old.dataType != kind:
            raise schema.SchemaError("range and key columns keep their type")
        schema.check_change(old.dataType, kind, name)
        self._change(schema=T.StructType([T.StructField(f.name, kind if f is old or f.name == old.name else f.dataType, f.nullable) for f in info.struct.fields]).json())

    def drop_columns(self, *names: str) -> None:
        """Logically: files keep the column, readers no longer see it."""
        info = self.info
        for n in names:
            if schema.find(self.schema, n) is None or n in info.ranges + info.keys:
                raise schema.SchemaError(f"{n} cannot be dropped")
        dropped = sorted({*json.loads(info.properties.get(DROPPED, "[]")), *names})
        self._change(properties=info.properties | {DROPPED: json.dumps(dropped)})

    # ---- writing files ---------------------------------------------------------------------------------------

    def _prepared(self, df: DataFrame, evolve: bool, partial: bool = False, overwrite_schema: bool = False) -> DataFrame:
        """Rows checked and cast to the table's schema, which grows if ``evolve``."""
        info = self.info
        schema.check_names(df.schema)
        extra = [f for f in df.schema.fields if schema.find(info.struct, f.name) is None]
        if overwrite_schema:
            if [c for c in info.ranges + info.keys if schema.find(df.schema, c) is None]:
                raise schema.SchemaError("range and key columns cannot go")
            self._change(schema=schema.normalised(df.schema, info.keys).json())
        elif evolve:
            self._change(schema=schema.normalised(schema.merge(info.struct, df.schema), info.keys).json())
        elif extra:
            raise schema.SchemaError(f"columns that the table has not: {', '.join(f.name for f in extra)}")
        info = self.info
        for c in info.ranges + info.keys:
            if schema.find(df.schema, c) is None:
                raise schema.SchemaError(f"column {c} is missing")
        out = schema.aligned(df, info.struct, only_present=partial)
        checks = [F.col(f"`{k}`").isNull() for k in info.keys]
        for name, rule in self.invariants().items():
            if name in out.columns:
                checks.append(~F.coalesce(F.expr(rule), F.lit(False)))
        if checks:
            broken = checks[0]
            for c in checks[1:]:
                broken = broken | c
            guarded = out.columns[0]
            out = out.withColumn(guarded, F.when(broken, F.raise_error(F.lit("a key is null or an invariant does not hold"))).otherwise(F.col(f"`{guarded}`")))
        return out

    def invariants(self) -> dict[str, str]:
        """Column to SQL condition, from properties named ``invariant.<column>``."""
        return {k.removeprefix("invariant."): v for k, v in self.info.properties.items() if k.startswith("invariant.")}

    def _write(self, df: DataFrame, commit_id: str, sort_also: Iterable[str] = (), buckets: int | None = None) -> dict[str, list[L.DataFile]]:
        """Writes rows under the commit's folder; returns the files of each partition.

        Keys are dealt to buckets by Spark's hash, a file for each bucket and partition, sorted by key; of equal keys
        later rows of the input lie later. What is too much for one task becomes several files, in the order of the
        input for any key. A table without keys is rebalanced by its range columns.
        """
        info = self.info
        names = {r: f"p_{r}" for r in info.ranges}
        coded = {p: F.coalesce(F.when(F.col(f"`{r}`").cast("string") == "", L.EMPTY).otherwise(F.col(f"`{r}`").cast("string")), F.lit(L.NULL)) for r, p in names.items()}
        kept = [c for c in df.columns if c not in info.ranges]
        folder = self.store.uri("data", f"commit={commit_id}")
        if info.keys:
            n = buckets or info.buckets
            dealt = bucketed.bucket_id(self.spark, info.keys, n)
            part = bucketed.bucket_id(self.spark, info.keys, n * bucketed.parts_for(df, n))  # modulo n it is the bucket
            out = df.withColumns({"_row": F.monotonically_increasing_id(), "_bucket": part, **coded}).hint("rebalance", *names.values(), "_bucket")
            order = [*names.values(), dealt, *[F.col(f"`{k}`") for k in info.keys], *sort_also, "_row"]
            bucketed.write(out.sortWithinPartitions(*order).select(*[F.col(f"`{c}`") for c in kept], *names.values()), folder, list(names.values()), info.keys, n)
        else:
            out = df.withColumns(coded).select(*[F.col(f"`{c}`") for c in kept], *names.values())
            writer = (out.hint("rebalance", *names.values()) if names else out).write.option("compression", "zstd")
            (writer.partitionBy(*names.values()) if names else writer).parquet(folder)
        found: dict[str, list[L.DataFile]] = {}
        for path, size in self.store.files("data", f"commit={commit_id}"):
            parts = dict(p.split("=", 1) for p in path.split("/")[2:-1])
            values = {r: unquote(parts[p]) for r, p in names.items()}
            where = L.partition_name({r: None if v == L.NULL else "" if v == L.EMPTY else v for r, v in values.items()})
            found.setdefault(where, []).append(L.DataFile(path, "add", size, bucketed.bucket_of_file(path) if info.keys else 0, df.columns))
        return found

    def _commit(self, commit_id: str, op: str, files: list[L.DataFile], **more) -> L.Commit:
        return L.Commit(commit_id, op, files, L.now_ms(), buckets=self.info.buckets, **more)

    def _add(self, df: DataFrame, op: str, txn: list | None = None, read: dict[str, int] | None = None, sort_also: Iterable[str] = ()) -> bool:
        commit_id = L.new_id()
        commits = {p: self._commit(commit_id, op, files) for p, files in self._write(df, commit_id, sort_also).items()}
        return bool(commits or txn) and self.log.add(commits, read, txn)

    # ---- reading ---------------------------------------------------------------------------------------------

    def _latest(self, partitions: Iterable[str] | None = None) -> dict[str, list[str]]:
        return {p: v.snapshot for p in (self.log.partitions() if partitions is None else partitions) if (v := self.log.now(p))}

    def _load(self, snapshots: dict[str, list[str]], merge: bool = True, operators: dict[str, str] | None = None, buckets: tuple[int, int] | None = None, with_file: bool = False, only: set[str] | None = None, tasks: int = 0) -> DataFrame:
        """The rows of some snapshots, merged by key; of all their files, of every so-manieth bucket's (first, step), or ``only`` the files named.

        Each bucket is merged by one task, unless one is too large for that: then rows are dealt by key to ``tasks``.
        """
        info, struct = self.info, self.schema
        files = [(p, place, f) for p, ids in snapshots.items() for place, f in self.log.active(p, ids) if (buckets is None or f.bucket % buckets[1] == buckets[0]) and (only is None or f.path in only)]
        if not files:
            return self.spark.createDataFrame([], struct)
        data = T.StructType([f for f in struct.fields if f.name not in info.ranges])
        coded = T.StructType([T.StructField("commit", T.StringType()), *[T.StructField(f"p_{r}", T.StringType()) for r in info.ranges]])
        paths = [self.store.uri(p) for p in self._paths(files)]
        dealt = {self.log.commit(p, snapshots[p][place]).buckets for p, place, _ in files}
        if info.keys:
            tasks = tasks or bucketed.tasks_for([(f.bucket, f.size) for _, _, f in files], info.buckets, bucketed.rows_per_byte(self.spark, [(f.bucket, f.size, self.store.uri(f.path)) for _, _, f in files]))
        if info.keys and not tasks and len(dealt) == 1 and min(dealt) > 0:  # one layout: what needs rows of a key together needs no exchange
            raw = bucketed.read(self.spark, paths, self.store.uri("data"), data, coded, info.keys, min(dealt))
        else:
            raw = self.spark.read.schema(T.StructType(data.fields + coded.fields)).option("basePath", self.store.uri("data")).parquet(*paths)
        back = [F.when(F.col(f"p_{r}") == L.NULL, None).when(F.col(f"p_{r}") == L.EMPTY, "").otherwise(F.col(f"p_{r}")).cast(struct[r].dataType).alias(r) for r in info.ranges]
        operators = {**json.loads(info.properties.get(MERGE_OPS, "{}")), **(operators or {})}
        single = not operators and all(self._compacted(p, ids) for p, ids in snapshots.items())
        if not info.keys or not merge or single:
            if operators and not info.keys:
                raise TableError("merge operators need a table with keys")
            return raw.select(*[F.col(f"`{f.name}`") if f.name not in info.ranges else back[info.ranges.index(f.name)] for f in struct.fields], *([F.col("_metadata.file_path").alias("_file")] if with_file else []))
        if not operators and (split := self._base_and_deltas(snapshots, files)):
            return self._over_base(*split, buckets, tasks)
        pieces = len({(os.path.dirname(f.path), f.bucket) for _, _, f in files}) < len(files)
        seq = F.struct(self._places(files), *([bucketed.piece_of_file()] if pieces else []), F.col("_metadata.row_index"))
        rows = raw.select(*[F.col(f"`{f.name}`") for f in data.fields], *back, F.col("commit").alias(merging.FILE), seq.alias(merging.SEQ))
        columns = {f.name: (operators.get(f.name, "use_last"), f.dataType, self._has(f.name, files)) for f in data.fields if f.name not in info.keys}
        if tasks:
            rows = rows.repartition(tasks, *[F.col(f"`{k}`") for k in info.keys])
        if unknown := set(operators) - set(columns):
            raise TableError(f"merge operators for columns that are keys or not there: {', '.join(sorted(unknown))}")
        return merging.merged(rows, [*info.ranges, *info.keys], columns).select(*[f"`{f.name}`" for f in struct.fields])

    def _base_and_deltas(self, snapshots: dict[str, list[str]], files: list[tuple[str, int, L.DataFile]]) -> tuple[dict[str, list[str]], dict[str, list[str]]] | None:
        """Snapshots as compacted bases and what was upserted since, if there is such a base in every partition and the upserts have all columns."""
        if any(not ids or self.log.commit(p, ids[0]).op != L.COMPACTION for p, ids in snapshots.items()):
            return None
        if any(f.op == "del" for p, ids in snapshots.items() for c in ids for f in self.log.commit(p, c).files):
            return None
        names = set(self.schema.fieldNames()) - set(self.info.ranges)
        if any(place and not names <= set(f.columns) for _, place, f in files):
            return None
        return {p: ids[:1] for p, ids in snapshots.items()}, {p: ids[1:] for p, ids in snapshots.items() if ids[1:]}

    def _over_base(self, bases: dict[str, list[str]], deltas: dict[str, list[str]], buckets: tuple[int, int] | None, tasks: int) -> DataFrame:
        """Upserts merged by themselves, and the base's rows whose key they have not: the base is not aggregated, and not
        shuffled either where Spark finds the upserts small enough to broadcast."""
        on = [*self.info.ranges, *self.info.keys]
        base, delta = self._load(bases, buckets=buckets, tasks=tasks), self._load(deltas, buckets=buckets, tasks=tasks)
        match = None
        for c in on:
            same = base[c].eqNullSafe(F.col(f"d.`{c}`")) if c in self.info.ranges else base[c] == F.col(f"d.`{c}`")
            match = same if match is None else match & same
        return base.join(delta.select(*on).alias("d"), match, "left_anti").unionByName(delta)

    def _compacted(self, partition: str, ids: list[str]) -> bool:
        return len(ids) <= 1 and all(self.log.commit(partition, i).op == L.COMPACTION for i in ids)

    def _paths(self, files: list[tuple[str, int, L.DataFile]]) -> list[str]:
        """Folders whose every file is wanted, and single files of the others."""
        wanted: dict[str, set[str]] = {}
        partition: dict[str, str] = {}
        for p, _, f in files:
            folder = os.path.dirname(f.path)
            wanted.setdefault(folder, set()).add(f.path)
            partition[folder] = p
        out = []
        for folder, paths in wanted.items():
            own = self.log.find_commit(partition[folder], folder.split("/")[1].removeprefix("commit="))
            whole = own is not None and {f.path for f in own.files if f.op == "add" and os.path.dirname(f.path) == folder} == paths
            out += [folder] if whole else sorted(paths)
        return sorted(out)

    def _places(self, files: list[tuple[str, int, L.DataFile]]) -> Column:
        """What orders a row's commit in its partition's snapshot: the commit's name, which begins with its time, where all
        snapshots are in that order; a place by name and partition where compactions of some commits have come between."""
        chains: dict[str, list[str]] = {}
        for p, _, f in files:
            own = chains.setdefault(p, [])
            commit = f.path.split("/")[1].removeprefix("commit=")
            if not own or own[-1] != commit:
                own.append(commit)
        if all(a < b for own in chains.values() for a, b in zip(own, own[1:], strict=False)):
            return F.col("commit")
        ranges = self.info.ranges
        code = lambda v: L.NULL if v is None else L.EMPTY if v == "" else v
        places = [("\x01".join([c, *[code(L.partition_values(p).get(r)) for r in ranges]]), i) for p, own in chains.items() for i, c in enumerate(own)]
        names, numbers = F.lit([n for n, _ in places]), F.lit([i for _, i in places])
        return F.element_at(F.map_from_arrays(names, numbers), F.concat_ws("\x01", "commit", *[f"p_{r}" for r in ranges]))

    @staticmethod
    def _has(name: str, files: list[tuple[str, int, L.DataFile]]) -> Column | None:
        """The condition under which a row's file has a column; None if all have it."""
        lacking = sorted({f.path.split("/")[1].removeprefix("commit=") for _, _, f in files if name not in f.columns})
        return ~F.col(merging.FILE).isin(lacking) if lacking else None

    def _finished(self, df: DataFrame, keep_deleted: bool) -> DataFrame:
        kind = self.info.properties.get(CDC_COLUMN)
        return df if keep_deleted or not kind or kind not in df.columns else without_deleted(df, kind)

    def partitions_for(self, condition: str | None) -> list[str]:
        return prune(self.spark, self.info.struct, self.info.ranges, self.log.partitions(), condition)

    def read(self, condition: str | None = None, keep_deleted: bool = False, operators: dict[str, str] | None = None, skip_merge: bool = False, buckets: tuple[int, int] | None = None, premerge: int | None = None) -> DataFrame:
        """The current rows. A condition prunes partitions, and is applied after the merge.

        With ``premerge``, partitions where as many small commits have gathered are merged by level before they are read.
        ``skip_merge`` gives the rows as written. Equalities on a single key prune buckets, in the scan, either way.
        """
        if premerge and self.info.keys:
            self.compact_levels(premerge)
        where = self.partitions_for(condition) if condition else None
        df = self._finished(self._load(self._latest(where), not skip_merge, operators, buckets), keep_deleted)
        return df.where(condition) if condition else df

    def snapshot(self, end: int = 0, partition: str | None = None, keep_deleted: bool = False, buckets: tuple[int, int] | None = None) -> DataFrame:
        """As of ``end`` (milliseconds; 0: now), of one partition or all."""
        chosen = {p: v.snapshot for p in ([partition] if partition else self.log.partitions()) if (v := self.log.at_time(p, end))}
        return self._finished(self._load(chosen, buckets=buckets), keep_deleted)

    def at_version(self, partition: str, number: int, keep_deleted: bool = False, buckets: tuple[int, int] | None = None) -> DataFrame:
        return self._finished(self._load({partition: self.log.version(partition, number).snapshot}, buckets=buckets), keep_deleted)

    def incremental(self, start: int, end: int = 0, partition: str | None = None, buckets: tuple[int, int] | None = None) -> DataFrame:
        """What was committed after the last version before ``start`` up to ``end``; change kinds and deletes stay."""
        chosen = {}
        for p in [partition] if partition else self.log.partitions():
            ids = self.log.incremental(p, start, end)
            if ids is None:
                last = self.log.at_time(p, end)
                ids = last.snapshot if last else []
            if ids:
                chosen[p] = ids
        return self._load(chosen, buckets=buckets)

    # ---- inserts ---------------------------------------------------------------------------------------------

    def append(self, df: DataFrame, merge_schema: bool = False, txn: list | None = None) -> bool:
        if self.info.keys:
            raise TableError("a table with keys takes upserts, not appends")
        return self._add(self._prepared(df, merge_schema), L.APPEND, txn)

    def insert_by_position(self, df: DataFrame, merge_schema: bool = False) -> None:
        named = schema.by_position(df, self.schema)
        (self.upsert if self.info.keys else self.append)(named, merge_schema=merge_schema)

    def overwrite(self, df: DataFrame, replace_where: str | None = None, merge_schema: bool = False, overwrite_schema: bool = False, txn: list | None = None, whole: bool = False) -> bool:
        """Without range columns the whole table; with them the partitions that the new rows touch, or all that
        ``replace_where`` (over range columns; all new rows must satisfy it) or ``whole`` names."""
        info = self.info
        rows = self._prepared(df, merge_schema, overwrite_schema=overwrite_schema)
        if replace_where:
            meta, data = split_condition(self.spark, info.struct, info.ranges, replace_where)
            if data or not meta:
                raise TableError("replaceWhere is over range columns only")
            first = rows.columns[0]
            rows = rows.withColumn(first, F.when(~F.coalesce(F.expr(replace_where), F.lit(False)), F.raise_error(F.lit("a row does not satisfy replaceWhere"))).otherwise(F.col(f"`{first}`")))
        commit_id = L.new_id()
        targets = set(self.partitions_for(replace_where) if replace_where else self.log.partitions() if whole or not info.ranges else ())
        written = self._write(rows, commit_id)
        targets |= set(written)
        self.log.partitions()
        read = {p: v.number for p in targets if (v := self.log.now(p))}
        return bool(self.log.replace({p: self._commit(commit_id, L.UPDATE, written[p]) if p in written else None for p in sorted(targets)}, read, False, txn))

    # ---- upserts ---------------------------------------------------------------------------------------------

    def upsert(self, source: DataFrame, condition: str | None = None, merge_schema: bool = False, delta: bool = True, txn: list | None = None, sort_also: Iterable[str] = (), full_scan: bool = False) -> bool:
        """Writes the source's rows as a merge commit; the source may lack columns that are neither range nor key.

        ``condition`` filters the source. Without ``delta`` the touched partitions are rewritten by a full join, which
        needs a condition over the range columns unless ``full_scan``.
        """
        info = self.info
        if not info.keys:
            raise TableError("upserts need keys")
        if condition:
            check_condition(self.spark, source.schema, condition)
            source = source.where(condition)
        rows = self._prepared(source, merge_schema, partial=True)
        if delta:
            return self._add(rows, L.MERGE, txn, sort_also=sort_also)
        if info.ranges and not full_scan and not split_condition(self.spark, info.struct, info.ranges, condition)[0]:
            raise TableError("rewriting a partitioned table needs a condition over its range columns, or full_scan")
        touched = self.partitions_for(" AND ".join(split_condition(self.spark, info.struct, info.ranges, condition)[0]) or None)
        read = {p: self.log.latest(p).number for p in touched}
        on = [*info.ranges, *info.keys]
        old, new = self._load(self._latest(touched)).alias("o"), rows.withColumn("_new", F.lit(True)).alias("n")
        match = F.expr(" AND ".join(f"o.`{c}` <=> n.`{c}`" for c in on))
        pick = lambda c: F.coalesce(F.col(f"n.`{c}`"), F.col(f"o.`{c}`")).alias(c) if c in rows.columns else F.col(f"o.`{c}`")
        self._rewrite(old.join(new, match, "full").select(*[pick(f.name) for f in self.schema.fields]), read, L.UPDATE, keep_empty=touched)
        return True

    def _rewrite(self, rows: DataFrame, read: dict[str, int], op: str, keep_empty: Iterable[str] = (), replaces: dict[str, list[str]] | None = None) -> set[str]:
        commit_id = L.new_id()
        written = self._write(rows, commit_id)
        commits = {p: self._commit(commit_id, op, written.get(p, []), replaces=(replaces or {}).get(p, [])) for p in sorted({*written, *keep_empty})}
        return self.log.replace(commits, read, keep_unread=op == L.COMPACTION)

    def upsert_on_join_key(self, delta: DataFrame, join_key: Iterable[str], partition: str | None = None, condition: str | None = None) -> None:
        """A changed dimension: every row that has one of its join keys gets the dimension's columns.

        The changed rows are broadcast only if Spark's own estimate of them is under its threshold.
        """
        info, on = self.info, list(join_key)
        wanted = [c for c in self.schema.fieldNames() if c in (*info.ranges, *info.keys, *on)]
        rows = self.snapshot(0, partition) if partition else self.read()
        if condition:
            delta = delta.where(condition)
        fresh = delta.drop(*[c for c in delta.columns if c in (*info.ranges, *info.keys) and c not in on])
        rows = rows.select(*wanted)
        if set(info.keys) <= set(on):
            rows = bucketed.dealt_apart(rows, on, info.buckets)
        self.upsert(rows.join(fresh, on, "inner"))

    def join_with_tables_and_upsert(self, delta: DataFrame, tables: Iterable[Table], condition: str | None = None) -> None:
        """New facts: each dimension table's columns are joined to them by that table's keys, then all are upserted."""
        rows = delta.where(condition) if condition else delta
        for t in tables:
            rows = rows.join(bucketed.dealt_apart(t.read(), t.info.keys, t.info.buckets), t.info.keys, "left")
        self.upsert(rows)

    def merge_into(self, source: DataFrame, on: str, update: dict[str, str] | str = "*", insert: dict[str, str] | str = "*", source_name: str = "s", target_name: str = "t") -> None:
        """MERGE INTO as far as it is an upsert: ``on`` equates exactly the range and key columns, both clauses are
        unconditional and assign plain source columns."""
        info = self.info
        if not info.keys:
            raise TableError("MERGE INTO needs a table with keys")
        pairs: dict[str, str] = {}
        for part in conjuncts(on):
            m = re.fullmatch(r"(\w+)\.`?(\w+)`?\s*=\s*(\w+)\.`?(\w+)`?", part)
            if not m or {m[1], m[3]} != {source_name, target_name} or m[2].lower() != m[4].lower():
                raise TableError("the condition of MERGE INTO is a conjunction of t.key = s.key")
            pairs[m[2].lower()] = m[4]
        if not {k.lower() for k in info.keys} <= set(pairs) or set(pairs) - {c.lower() for c in [*info.keys, *info.ranges]}:
            raise TableError("the condition of MERGE INTO names all keys and nothing else")
        clauses = []
        for clause in (update, insert):
            assigned = {c: f"{source_name}.{c}" for c in source.columns} if clause == "*" else dict(clause)
            if any(not re.fullmatch(rf"{source_name}\.`?\w+`?", v) for v in assigned.values()):
                raise TableError("MERGE INTO assigns plain source columns")
            clauses.append({k: v.split(".", 1)[1].strip("`") for k, v in assigned.items()})
        keys = {c: c for c in [*info.ranges, *info.keys]}
        if keys | clauses[0] != keys | clauses[1]:
            raise TableError("UPDATE and INSERT assign the same columns")
        self.upsert(source.select(*[F.col(f"`{v}`").alias(k) for k, v in (keys | clauses[0]).items()]))

    def change(self, source: DataFrame, kind: Column | str) -> None:
        """Rows with row kinds (+I, +U, -U, -D) become inserts, updates and deletes of the change column."""
        column = self.info.properties.get(CDC_COLUMN)
        if not column:
            raise TableError("the table has no change column")
        kinds = F.element_at(F.create_map(*[F.lit(x) for pair in ROW_KINDS.items() for x in pair]), F.col(kind) if isinstance(kind, str) else kind)
        self.upsert(source.withColumn(column, kinds).drop(*([kind] if isinstance(kind, str) and kind != column else [])))

    # ---- update, delete --------------------------------------------------------------------------------------

    def update(self, assignments: dict[str, str | Column], condition: str | None = None) -> int:
        """Sets columns (``a`` or nested ``a.b``) where the condition holds; returns the number of partitions rewritten."""
        info = self.info
        for c in assignments:
            if c.split(".")[0] in [*info.ranges, *info.keys]:
                raise TableError("range and key columns cannot be updated")
            if schema.find(self.schema, c.split(".")[0]) is None:
                raise schema.SchemaError(f"no column {c}")
        hit = F.coalesce(F.expr(condition), F.lit(False)) if condition else F.lit(True)

        def changed(rows: DataFrame) -> DataFrame:
            out = {}
            for c, value in assignments.items():
                top, _, nested = c.partition(".")
                new = F.expr(value) if isinstance(value, str) else value
                old = out.get(top, F.col(f"`{top}`"))
                target = self.schema[top].dataType
                whole = F.when(old.isNotNull(), old.withField(nested, new)) if nested else new
                out[top] = F.when(hit, whole.cast(target)).otherwise(old)
            return rows.withColumns(out)

        return self._rewrite_where(condition, changed, L.UPDATE)

    def delete(self, condition: str | None = None) -> int:
        """Without a condition, or with one over range columns alone, only the log changes. Else rows where the
        condition is true go, and the commit adds the new files and deletes the old ones."""
        info = self.info
        meta, data = split_condition(self.spark, info.struct, info.ranges, condition)
        if condition is None or (meta and not data):
            where = self.partitions_for(condition)
            self.log.clear(where)
            return len(where)
        kind = info.properties.get(CDC_COLUMN)
        if info.keys and kind:
            gone = self.read(condition).select(*info.ranges, *info.keys).withColumn(kind, F.lit("delete"))
            self.upsert(gone)
            return len(self.partitions_for(condition))
        return self._rewrite_where(condition, lambda rows: rows.where(~F.expr(condition).eqNullSafe(F.lit(True))), L.APPEND)

    def _rewrite_where(self, condition: str | None, changed: Callable[[DataFrame], DataFrame], op: str) -> int:
        """Rewrites what a condition touches: without keys the files that have such rows, with keys whole partitions."""
        info = self.info
        touched = {p: v for p in (self.partitions_for(condition) if condition else self.log.partitions()) if (v := self.log.now(p)) and v.snapshot}
        if not touched:
            return 0
        chosen = {p: v.snapshot for p, v in touched.items()}
        active = {p: [f for _, f in self.log.active(p, ids)] for p, ids in chosen.items()}
        if info.keys or condition is None:
            stale = {p: {f.path for f in files} for p, files in active.items()}
            rows = self._load(chosen)
        else:  # one look for the files that have such rows, which reads the condition's columns alone; then those files whole
            top = f"{self.store.uri('data').removeprefix('file://').rstrip('/')}/"
            found = self._load(chosen, with_file=True).where(condition).select("_file").distinct().toLocalIterator()
            hit = {"data/" + unquote(r["_file"]).partition(top)[2] for r in found}
            stale = {p: {f.path for f in files if unquote(f.path) in hit} for p, files in active.items()}
            if not any(stale.values()):
                return 0
            rows = self._load(chosen, only={f for paths in stale.values() for f in paths})
        commit_id = L.new_id()
        written = self._write(changed(rows), commit_id)
        changes = [p for p in touched if stale[p]]
        read = {p: touched[p].number for p in changes}
        if op == L.UPDATE:
            self.log.replace({p: self._commit(commit_id, op, written.get(p, []) + [f for f in active[p] if f.path not in stale[p]]) for p in changes}, read, False)
        else:
            self.log.add({p: self._commit(commit_id, op, [replace(f, op="del") for f in active[p] if f.path in stale[p]] + written.get(p, [])) for p in changes}, read)
        return len(changes)

    # ---- maintenance -----------------------------------------------------------------------------------------

    def compact(self, condition: str | None = None, operators: dict[str, str] | None = None, buckets: int | None = None, clean_old: bool = False) -> int:
        """Merges each partition's files into one per bucket (more where a bucket is large), applying merge operators. In a table with a change column
        deleted rows go and updates become inserts. Returns the number of partitions compacted."""
        info = self.info
        chosen = {p: v for p in self.partitions_for(condition) if (v := self.log.now(p)) and v.snapshot and (buckets or operators or not self._compacted(p, v.snapshot))}
        if not chosen:
            return 0
        if buckets and info.keys:
            if len(chosen) < len(self.log.partitions()) and condition:
                raise TableError("the number of buckets belongs to the whole table")
            self._change(buckets=buckets)
        rows = self._load({p: v.snapshot for p, v in chosen.items()}, operators=operators)
        kind = info.properties.get(CDC_COLUMN)
        if kind in rows.columns:
            rows = without_deleted(rows, kind).withColumn(kind, F.when(F.col(kind) == "update", "insert").otherwise(F.col(kind)))
        old = {p: {f.path for _, f in self.log.active(p, v.snapshot)} for p, v in chosen.items()}
        done = self._rewrite(rows, {p: v.number for p, v in chosen.items()}, L.COMPACTION, keep_empty=chosen, replaces={p: v.snapshot for p, v in chosen.items()})
        if clean_old:  # only where this compaction won, and only what the table as it is now does not name
            self.log.forget({p: [n for n in self.log.numbers(p) if n <= chosen[p].number] for p in done})
            named = {p: {f.path for v in self.log.history(p) for c in v.snapshot for f in self.log.commit(p, c).files} for p in done}
            for p in done:
                for path in sorted(old[p] - named[p]):
                    self.store.delete(path)
        return len(done)

    def compact_levels(self, file_limit: int = 4, byte_limit: int = 64 << 20, growth: int = 4, max_level: int = 4) -> dict[str, int]:
        """Levelled compaction: level 0 holds incremental commits; a level with ``file_limit`` commits, or with more bytes
        than its limit (``byte_limit`` times ``growth`` a level), is merged into one commit of the next level, the last into
        one of its own. Without the oldest commit only such with the same columns are merged, so that a column which they
        lack stays what older commits make it. Deleted rows stay, since older levels may hold what they delete. A
        compaction that meets another one, an update or a delete leaves the partition alone. Returns the level reached by
        each partition touched."""
        done: dict[str, int] = {}
        for p in self.log.partitions():
            while (job := self._level_job(p, file_limit, byte_limit, growth, max_level)) is not None:
                version, first, last, level = job
                before, part = version.snapshot, version.snapshot[first : last + 1]
                columns = sorted({c for i in part for f in self.log.commit(p, i).files for c in f.columns})
                rows = self._load({p: part})
                commit_id = L.new_id()
                files = self._write(rows.select(*[f"`{c}`" for c in rows.columns if not first or c in columns]), commit_id).get(p, [])
                commit = self._commit(commit_id, L.MERGE if first else L.COMPACTION, files, replaces=part, level=level)
                new = [*before[:first], commit_id, *before[last + 1 :]]

                def plan(p=p, before=before, new=new, commit=commit) -> dict[str, L.Change] | None:
                    now = self.log.now(p)
                    return {p: L.Change([*new, *now.snapshot[len(before) :]], L.COMPACTION, commit)} if now and now.snapshot[: len(before)] == before else None

                if not self.log.transact(plan):
                    break
                done[p] = level
        return done

    def _level_job(self, partition: str, file_limit: int, byte_limit: int, growth: int, max_level: int) -> tuple[L.Version, int, int, int] | None:
        """(version, first, last commit, new level) of the lowest level that is full; a level's commits lie together."""
        version = self.log.latest(partition)
        ids = version.snapshot if version else []
        commits = [self.log.commit(partition, c) for c in ids]
        if any(f.op == "del" for c in commits for f in c.files):
            return None
        columns = [{x for f in c.files for x in f.columns} for c in commits]
        for level in range(max_level + 1):
            at = [i for i, c in enumerate(commits) if c.level == level]
            size = sum(f.size for i in at for f in commits[i].files)
            if len(at) < file_limit and not (len(at) > 1 and size > byte_limit * growth**level):
                continue
            runs: list[list[int]] = []
            for i in at:
                if runs and runs[-1][-1] == i - 1 and (runs[-1][0] == 0 or columns[i] == columns[i - 1]):
                    runs[-1].append(i)
                else:
                    runs.append([i])
            if longest := max((r for r in runs if len(r) > 1), key=len, default=None):
                return version, longest[0], longest[-1], min(level + 1, max_level)
        return None

    def needs_compaction(self, versions: int = 10) -> list[str]:
        """Partitions with that many versions since their last compaction."""
        out = []
        for p in self.log.partitions():
            history = self.log.history(p)
            last = max((i for i, v in enumerate(history) if v.op == L.COMPACTION), default=-1)
            if len(history) - 1 - last >= versions:
                out.append(p)
        return out

    def rollback(self, partition: str = L.WHOLE, version: int | None = None, end: int | None = None) -> None:
        """Makes an old version the latest one, as a new version; history stays."""
        if version is None:
            found = self.log.at_time(partition, end or 0)
            if found is None:
                raise TableError(f"{partition} has no version by then")
            version = found.number
        if version not in self.log.numbers(partition):
            raise TableError(f"{partition} has no version {version}")
        self.log.restore(partition, version)

    def cleanup(self, partition: str, before: int) -> None:
        """Forgets versions before a time (but the latest), then deletes files that no remaining version uses."""
        history = self.log.history(partition)
        old = [v for v in history[:-1] if v.timestamp < before]
        files = lambda versions: {f.path for v in versions for c in v.snapshot for f in self.log.commit(partition, c).files}
        had = files(old)
        self.log.forget({partition: [v.number for v in old]})
        for path in sorted(had - files(self.log.history(partition))):
            self.store.delete(path)

    def expire(self, now: int | None = None) -> list[str]:
        """Applies the time-to-live properties, in days; returns the partitions dropped."""
        properties, now, dropped = self.info.properties, now or L.now_ms(), []
        for p in self.log.partitions():
            last = self.log.latest(p)
            if PARTITION_TTL in properties and last and last.snapshot and last.timestamp < now - float(properties[PARTITION_TTL]) * 86_400_000:
                dropped.append(p)
                continue
            compactions = [v for v in self.log.history(p) if v.op == L.COMPACTION]
            if compactions and properties.get(KEEP_ONE, "").lower() == "true":
                self.cleanup(p, compactions[-1].timestamp)
            elif COMPACTION_TTL in properties:
                old = [v for v in compactions if v.timestamp < now - float(properties[COMPACTION_TTL]) * 86_400_000]
                if old:
                    self.cleanup(p, old[-1].timestamp)
        self.log.clear(dropped)
        return dropped

    def vacuum(self, older_than: int = 0) -> int:
        """Deletes data files that no version names (what failed writers left); returns how many."""
        named = {f.path for p in self.log.partitions() for v in self.log.history(p) for c in v.snapshot for f in self.log.commit(p, c).files}
        stale = [path for path, _ in self.store.files("data") if path not in named and int(path.split("/")[1].removeprefix("commit=").split("-")[0]) // 1_000_000 < (older_than or L.now_ms())]
        for path in stale:
            self.store.delete(path)
        return len(stale)

    def drop_partition(self, condition: str) -> list[str]:
        """An empty snapshot for each partition that a condition over range columns names."""
        meta, data = split_condition(self.spark, self.info.struct, self.info.ranges, condition)
        if data or not meta:
            raise TableError("the condition is over range columns only")
        where = self.partitions_for(condition)
        self.log.clear(where)
        return where

    def truncate(self) -> None:
        self.log.clear(self.log.partitions())

    def partitions(self) -> list[str]:
        """Partitions that have rows."""
        return [p for p, ids in self._latest().items() if ids]

    def call(self, procedure: str, **arguments) -> object:
        """Procedures by name, partition values as a mapping: ``call("rollback", partition_value={"d": "1"}, version=2)``."""
        values = arguments.pop("partition_value", None)
        if procedure == "rollback":
            return self.rollback(L.partition_name({k: str(v) for k, v in (values or {}).items()}), arguments.get("version"), arguments.get("to_time"))
        if procedure == "compaction":
            where = " AND ".join(f"`{k}` = '{v}'" for k, v in (values or {}).items()) or None
            return self.compact(where, arguments.get("operators"), clean_old=arguments.get("clean_old", False))
        raise TableError(f"no procedure {procedure}")

    def statistics(self) -> DataFrame:
        """Files, bytes and commits of each partition's latest version."""
        rows = []
        for p, ids in self._latest().items():
            files = [f for _, f in self.log.active(p, ids)]
            rows.append((self.info.name, p, len(self.log.numbers(p)), len(ids), len(files), sum(f.size for f in files)))
        return self.spark.createDataFrame(rows, "table string, partition string, versions long, commits long, files long, bytes long")

    def publish_bucketed(self, name: str) -> None:
        """The current rows as a Spark bucketed table, so that joins and aggregates on its keys need no exchange."""
        info = self.info
        out = self.read().repartition(info.buckets, *info.keys)
        out.write.mode("overwrite").format("parquet").bucketBy(info.buckets, *info.keys).sortBy(*info.keys).saveAsTable(name)


def check_condition(spark: SparkSession, struct: T.StructType, condition: str) -> None:
    """Conditions are deterministic, without aggregates and subqueries."""
    if re.search(r"\bselect\b", condition, re.IGNORECASE):
        raise TableError("subqueries are not allowed in conditions")
    plan = spark.createDataFrame([], struct).select(F.expr(condition))._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "Aggregate":
        raise TableError("aggregates are not allowed in conditions")
    if not plan.deterministic():
        raise TableError("conditions must be deterministic")
