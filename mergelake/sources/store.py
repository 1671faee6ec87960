"""Small metadata files on a local disk or any Hadoop file system, with create-if-absent as the only primitive for agreement."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import uuid
from typing import Any
from urllib.parse import urlsplit

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; on one machine without it a temporary one."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='mergelake-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    atexit.register(shutil.rmtree, own.removeprefix("file://"), ignore_errors=True)
    return own


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder. What is there when this process ends is removed, as far as it can be reached."""
    path = f"{shared_folder(spark)}/mergelake-{name}-{uuid.uuid4().hex}"

    def clean() -> None:
        if urlsplit(path).scheme in ("", "file"):
            shutil.rmtree(urlsplit(path).path, ignore_errors=True)
        elif spark.sparkContext._jsc is not None:
            remove(spark, path)

    atexit.register(clean)
    return path


class Store:
    """Paths are relative to ``root``. Only the driver uses it, and only for metadata."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self.local = urlsplit(root).scheme in ("", "file")
        self.base = urlsplit(root).path.rstrip("/") if self.local else self.root
        if not self.local:
            self._path = spark._jvm.org.apache.hadoop.fs.Path
            self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
            hadoop = spark._jvm.org.apache.hadoop.fs
            self._context = hadoop.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())
            kind = getattr(hadoop, "Options$Rename")
            self._never = spark.sparkContext._gateway.new_array(kind, 1)
            self._never[0] = kind.NONE
            self._io = spark._jvm.org.apache.commons.io.IOUtils

    def uri(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _at(self, *parts: str):
        where = "/".join([self.base, *parts])
        return where if self.local else self._path(where)

    def exists(self, *parts: str) -> bool:
        return os.path.exists(self._at(*parts)) if self.local else self._fs.exists(self._at(*parts))

    def names(self, *parts: str) -> list[str]:
        """Sorted names in a folder, but for what is still being written; none if it is absent."""
        if not self.exists(*parts):
            return []
        names = os.listdir(self._at(*parts)) if self.local else [s.getPath().getName() for s in self._fs.listStatus(self._at(*parts))]
        return sorted(n for n in names if not n.startswith(".") and not n.endswith(".tmp"))

    def files(self, *parts: str) -> list[tuple[str, int]]:
        """(path below the root, bytes) of all data files below a folder."""
        if not self.exists(*parts):
            return []
        found = []
        if self.local:
            for folder, _, names in os.walk(self._at(*parts)):
                found += [(os.path.relpath(f"{folder}/{n}", self.base), os.path.getsize(f"{folder}/{n}")) for n in names]
        else:
            each = self._fs.listFiles(self._at(*parts), True)
            top = self._fs.makeQualified(self._path(self.root)).toString().rstrip("/") + "/"
            while each.hasNext():
                s = each.next()
                found.append((s.getPath().toString().removeprefix(top), s.getLen()))
        return sorted((p, n) for p, n in found if p.endswith(".parquet") and not os.path.basename(p).startswith((".", "_")))

    def read(self, *parts: str) -> Any:
        if self.local:
            with open(self._at(*parts), encoding="utf-8") as f:
                return json.load(f)
        stream = self._fs.open(self._at(*parts))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, value: Any, *parts: str) -> bool:
        """Writes a file that must not exist; False if it does."""
        data = json.dumps(value, sort_keys=True)
        if self.local:
            os.makedirs(os.path.dirname(self._at(*parts)), exist_ok=True)
            own = f"{self._at(*parts)}.{os.getpid()}.{os.urandom(4).hex()}.tmp"
            with open(own, "w", encoding="utf-8") as f:
                f.write(data)
            try:
                os.link(own, self._at(*parts))  # a link to the whole file: readers never see half of it
            except FileExistsError:
                return False
            finally:
                os.unlink(own)
            return True
        own = self._at(f"{'/'.join(parts[:-1])}/.{parts[-1]}.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(own, False)
        out.write(bytearray(data.encode()))
        out.close()
        try:
            self._context.rename(own, self._at(*parts), self._never)  # fails where there is something, so readers see a whole file or none
        except Exception as e:  # noqa: BLE001  py4j hides the Java class
            self._fs.delete(own, False)
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        return True

    def delete(self, *parts: str) -> None:
        if not self.local:
            self._fs.delete(self._at(*parts), True)
        elif os.path.isdir(self._at(*parts)):
            shutil.rmtree(self._at(*parts))
        elif os.path.exists(self._at(*parts)):
            os.unlink(self._at(*parts))

    def move(self, source: str, target: str) -> None:
        if not self.local:
            self._fs.mkdirs(self._at(os.path.dirname(target)))
            self._fs.rename(self._at(source), self._at(target))
            return
        os.makedirs(os.path.dirname(self._at(target)), exist_ok=True)
        os.rename(self._at(source), self._at(target))
