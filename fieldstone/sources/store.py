"""Tables of plain Parquet folders with atomic commits over several of them.

A commit writes one fresh folder per table that it touches, with the rows as they are after it and the ids that are
gone, and one small file that names the folders of every table: a base and, in order, the changes on top of it.  So
a save costs what it changes, whatever the table's size; a reader takes of each id the last change, which the
base is anti-joined with.  ``fold`` makes one base of a table's folders, when they have become many.

The commit file's number is one above the commit that was read, and it is created only if no file of that number
exists, so of two writers from the same base one fails and nothing it wrote becomes visible.  Readers
pin the commit they opened.  The root may be in any store that Spark writes whose rename is atomic and fails if
the target exists, as on HDFS; local disks check first and rename then, so one process at a time should save there.
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldstone.operators.changes import SEQ, last_wins

GONE = "__gone"


class StaleSnapshotError(Exception):
    """Another writer published a commit after the one this writer read."""


def shared_root(spark: SparkSession) -> str:
    """A fresh folder that all executors see, below ``spark.checkpoint.dir``; a temporary one for local masters."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{found or tempfile.mkdtemp(prefix='fieldstone-')}/fieldstone-store-{uuid.uuid4().hex}"


class Store:
    """Tables below one root folder.  The last ``history`` commits can be read."""

    def __init__(self, spark: SparkSession, root: str, history: int = 100):
        self.spark, self.root, self.history = spark, root.rstrip("/"), max(1, history)
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, tail: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{tail}" if tail else self.root)

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def temporary(self) -> Store:
        """This store, removed when the application ends."""
        self._fs().deleteOnExit(self._path())
        return self

    # -- commits

    def _commits(self) -> list[int]:
        fs, at = self._fs(), self._path("_commits")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def latest(self) -> int:
        """The number of the current commit; 0 before the first."""
        return max(self._commits(), default=0)

    def manifest(self, commit: int) -> dict[str, dict]:
        """table -> {schema, key, base, changes} of a commit."""
        if commit == 0:
            return {}
        stream = self._fs().open(self._path(f"_commits/{commit:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def tables(self, commit: int | None = None) -> list[str]:
        return sorted(self.manifest(self.latest() if commit is None else commit))

    # -- reading

    def _folder(self, folder: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")

    def read(self, table: str, commit: int | None = None) -> DataFrame:
        """The table's rows as of a commit, by default the current one."""
        return self.rows(self.manifest(self.latest() if commit is None else commit)[table])

    def rows(self, entry: dict) -> DataFrame:
        """The rows that a manifest entry, published or only staged, names."""
        schema, key = T.StructType.fromJson(json.loads(entry["schema"])), entry["key"]
        base = self._folder(entry["base"], schema)
        if not entry["changes"]:
            return base
        flagged = T.StructType([*schema.fields, T.StructField(GONE, T.BooleanType())])
        parts = [self._folder(f, flagged) for f in entry["changes"]]
        last = parts[0]  # holds each id once
        if len(parts) > 1:
            last = last_wins(reduce(DataFrame.unionByName, [p.withColumn(SEQ, F.lit(i)) for i, p in enumerate(parts)]), key)
        kept = base.join(last.select(key), key, "left_anti").select(*schema.names)
        return kept.unionByName(last.filter(~F.col(GONE)).select(*schema.names))

    # -- writing

    def _write(self, table: str, rows: DataFrame, key: str) -> tuple[str, int]:
        """Rows sorted by key within each file, whose statistics let loads skip what they don't need; and how many."""
        folder, seen = f"{table}/{uuid.uuid4().hex}", Observation()
        rows.sortWithinPartitions(key).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.root}/{folder}")
        return folder, seen.get["n"]

    def stage(self, table: str, rows: DataFrame, key: str, before: dict | None = None, gone: DataFrame | None = None) -> dict:
        """Writes rows, each id once, to a folder that no commit names yet and gives the table's new entry.  They replace the rows
        of their ids in ``before``, the current entry, and the ids ``gone`` leave it."""
        schema = rows.schema
        if before is None:
            folder, n = self._write(table, rows, key)
            return {"schema": schema.json(), "key": key, "base": folder, "changes": [], "new": folder, "rows": n}
        changes = rows.withColumn(GONE, F.lit(False))
        if gone is not None:
            changes = changes.unionByName(gone.select(key).withColumn(GONE, F.lit(True)), allowMissingColumns=True)
        folder, n = self._write(table, changes, key)
        return before | {"changes": [*before["changes"], folder], "new": folder, "rows": n}

    def publish(self, staged: dict[str, dict], base: int) -> int:
        """Makes staged folders current in one step, if ``base`` still is the current commit."""
        if self.latest() != base:
            self.discard(staged)
            raise StaleSnapshotError(f"commit {base} is no longer the current one")
        body = json.dumps(self.manifest(base) | staged).encode()
        fs = self._fs()
        fs.mkdirs(self._path("_commits"))
        draft = self._path(f"_commits/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(body))
        out.close()
        if not self._claim(fs, draft, self._path(f"_commits/{base + 1:012d}.json")):
            fs.delete(draft, False)
            self.discard(staged)
            raise StaleSnapshotError(f"commit {base} is no longer the current one")
        for old in self._commits():
            if old <= base + 1 - self.history:
                fs.delete(self._path(f"_commits/{old:012d}.json"), False)
        return base + 1

    def _claim(self, fs, draft, final) -> bool:
        """Renames the draft to the final name unless that exists."""
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        none = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(final), none)
            return True
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                return False
            raise

    def fold(self, table: str, keys: tuple[str, ...] = ()) -> int:
        """Publishes the table as one folder, in ranges of ``keys`` if given; for when its changes have become many."""
        base = self.latest()
        entry = self.manifest(base)[table]
        rows = self.rows(entry)
        return self.publish({table: self.stage(table, rows.repartitionByRange(*keys) if keys else rows, keys[0] if keys else entry["key"]) | {"key": entry["key"]}}, base)

    def discard(self, staged: dict[str, dict]) -> None:
        """Removes staged folders."""
        for entry in staged.values():
            self._fs().delete(self._path(entry["new"]), True)

    def park(self, rows: DataFrame, parked: list[str]) -> DataFrame:
        """Rows written beside the tables for the time of a save; the folder is noted in ``parked``."""
        parked.append(f"_parked/{uuid.uuid4().hex}")
        rows.write.parquet(f"{self.root}/{parked[-1]}")
        self._fs().deleteOnExit(self._path(parked[-1]))
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/{parked[-1]}")

    def unpark(self, parked: list[str]) -> None:
        for folder in parked:
            self._fs().delete(self._path(folder), True)

    def vacuum(self, older_than: float = 7 * 24 * 3600) -> int:
        """Removes folders that no commit of the history names and that were made over ``older_than`` seconds ago; returns
        how many.  It must be longer than any session or save lasts: these may hold folders that no commit names yet
        or any more."""
        fs = self._fs()
        live = {f for c in self._commits() for e in self.manifest(c).values() for f in (e["base"], *e["changes"])}
        limit, gone = (time.time() - older_than) * 1000, 0
        for table in fs.listStatus(self._path()) if fs.exists(self._path()) else []:
            name = table.getPath().getName()
            if name == "_commits" or not table.isDirectory():
                continue
            for made in fs.listStatus(table.getPath()):
                if f"{name}/{made.getPath().getName()}" not in live and made.getModificationTime() < limit:
                    fs.delete(made.getPath(), True)
                    gone += 1
        return gone
