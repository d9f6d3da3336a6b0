"""Versioned catalogue tables.

The large tables, content and files, lie in hash buckets of their key: partition folders that Spark's writer cuts. A commit
of changed rows (``upsert``) reads and writes the buckets of their keys only, so what it writes follows the batch; the manifest keeps
naming the other buckets where they are. Few changed rows meet the stored ones by broadcast: the stored side is read, not shuffled.

Each version is one small manifest naming the Parquet folders of every table. A commit writes new
folders first and the manifest last, under the next number; readers see all of it or nothing, and
of two concurrent writers the second fails and must start again from the new version. A job reads and commits
inside ``pinned``: everything it reads is of one version, and its commits follow that version or fail.
"""

from __future__ import annotations

import functools
import json
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.operators.narrow import narrowed
from shoebox.schemas import BUCKETED, PARTITIONED, TABLES
from shoebox.session import durable
from shoebox.sources.storage import ControlFiles

MAX_FOLDERS = 100  # appended folders per table before they are merged
BUCKETS = 16  # of a new bucketed table; ``rebucket`` changes it as a library grows
OF = "_buckets"  # where the manifest keeps the numbers of buckets

COMMIT_TRIES = 5


class VersionTaken(RuntimeError):
    """Another writer has published the version that a commit was to make."""


def one_version(job: Callable) -> Callable:
    """A job on a library, of which all reads and commits build on one version; lost races start it again."""

    @functools.wraps(job)
    def run(lib, *args, **kwargs):
        inner = lib.catalog.base is not None
        for left in reversed(range(1 if inner else COMMIT_TRIES)):
            try:
                with lib.catalog.pinned():
                    return job(lib, *args, **kwargs)
            except VersionTaken:
                if not left:
                    raise

    return run


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._control = ControlFiles(spark, self.root)
        self._of_thread = threading.local()

    @property
    def base(self) -> int | None:
        """The version this thread's job builds on."""
        return getattr(self._of_thread, "base", None)

    @contextmanager
    def pinned(self) -> Iterator[None]:
        if self.base is not None:  # part of a larger job
            yield
            return
        self._of_thread.base = self.version()
        try:
            yield
        finally:
            self._of_thread.base = None

    def version(self) -> int:
        names = [n for n in self._control.names(f"{self.root}/versions") if n.endswith(".json")]
        return max((int(n.removesuffix(".json")) for n in names), default=0)

    def _manifest(self, version: int) -> dict:
        if version == 0:
            return {}
        return json.loads(self._control.read(f"{self.root}/versions/{version:010d}.json"))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as of ``version``, by default the job's or the latest one; empty before the first commit."""
        return self._opened(table, self._manifest(self._default(version)).get(table, []))

    def _opened(self, table: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], TABLES[table])
        reader = self.spark.read.schema(TABLES[table])
        if table in PARTITIONED or table in BUCKETED:
            reader = reader.option("basePath", f"{self.root}/tables/{table}")
        return reader.parquet(*[f"{self.root}/{f}" for f in folders]).select(*TABLES[table].names)

    def folders(self, table: str) -> int:
        """Of how many folders the table is made."""
        return len(self._manifest(self._default(None)).get(table, []))

    def _default(self, version: int | None) -> int:
        known = version if version is not None else self.base
        return self.version() if known is None else known

    def _typed(self, table: str, rows: DataFrame) -> DataFrame:
        return rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in TABLES[table]])

    def _write(self, table: str, rows: DataFrame) -> str:
        typed = self._typed(table, rows)
        if by := PARTITIONED.get(table):
            # One base folder for all sets, so that a reader finds the same columns in each.
            folder = f"tables/{table}/set={uuid.uuid4().hex}"
            typed = typed.repartition(*by).sortWithinPartitions(*[c for c in typed.columns if c not in by])
            typed.write.partitionBy(*by).parquet(f"{self.root}/{folder}")
        else:
            folder = f"tables/{table}/{uuid.uuid4().hex}"
            typed.write.parquet(f"{self.root}/{folder}")
        return folder

    def _with_bucket(self, table: str, rows: DataFrame, of: int) -> DataFrame:
        return self._typed(table, rows).withColumn("bucket", F.pmod(F.xxhash64(BUCKETED[table]), F.lit(of)).cast("int"))

    def _write_buckets(self, table: str, rows: DataFrame) -> list[str]:
        folder = f"tables/{table}/set={uuid.uuid4().hex}"
        rows.write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        return [f"{folder}/{name}" for name in self._control.names(f"{self.root}/{folder}") if name.startswith("bucket=")]

    def merged(self, table: str, changed: DataFrame, folders: list[str]) -> DataFrame:
        """The rows of these buckets with the changed ones (with their bucket, a durable table) in the place of those of the same key."""
        kept = narrowed(self._opened(table, folders), changed, BUCKETED[table], outside=True)
        return self._with_bucket(table, kept, self.buckets(table)).unionByName(changed.repartition("bucket"))

    def buckets(self, table: str) -> int:
        """In how many buckets the table is kept."""
        return self._manifest(self._default(None)).get(OF, {}).get(table, BUCKETS)

    def _upserted(self, table: str, rows: DataFrame, held: list[str]) -> list[str]:
        """Folders of the table after the rows took the place of those of the same key."""
        changed = durable(self._with_bucket(table, rows, self.buckets(table)))
        touched = {f"bucket={r[0]}" for r in changed.select("bucket").distinct().collect()}
        if not touched:
            return held
        beside = [f for f in held if f.rsplit("/", 1)[1] not in touched]
        inside = [f for f in held if f.rsplit("/", 1)[1] in touched]
        return beside + self._write_buckets(table, self.merged(table, changed, inside))

    def rebucket(self, table: str, buckets: int) -> int:
        """Keep a table in another number of buckets."""
        rows = self._with_bucket(table, self.read(table), buckets).repartition("bucket")
        return self._publish(self._default(None), {table: self._write_buckets(table, rows)}, {table: buckets})

    def commit(
        self,
        replace: dict[str, DataFrame] | None = None,
        append: dict[str, DataFrame] | None = None,
        upsert: dict[str, DataFrame] | None = None,
        base: int | None = None,
    ) -> int:
        """Publish new table contents together; returns the new version number.

        ``replace`` takes whole tables, ``append`` rows to add, ``upsert`` changed and new rows of a bucketed table, one per key.
        """
        base = self._default(base)
        before, changed = self._manifest(base), {}
        for table, rows in (replace or {}).items():
            if table in BUCKETED:
                of = self.buckets(table)
                changed[table] = self._write_buckets(table, self._with_bucket(table, rows, of).repartition("bucket"))
            else:
                changed[table] = [self._write(table, rows)]
        for table, rows in (append or {}).items():
            held = before.get(table, [])
            if len(held) >= MAX_FOLDERS:
                changed[table] = [self._write(table, self.read(table, base).unionByName(rows))]
            else:
                changed[table] = held + [self._write(table, rows)]
        for table, rows in (upsert or {}).items():
            changed[table] = self._upserted(table, rows, before.get(table, []))
        return self._publish(base, changed, {t: self.buckets(t) for t in changed if t in BUCKETED})

    def _publish(self, base: int, changed: dict[str, list[str]], buckets: dict[str, int]) -> int:
        manifest = self._manifest(base) | changed
        if buckets:
            manifest[OF] = manifest.get(OF, {}) | buckets
        name = f"{self.root}/versions/{base + 1:010d}.json"
        try:
            self._control.create(name, json.dumps(manifest, sort_keys=True))
        except Py4JJavaError as problem:
            if self._control.is_file(name):
                raise VersionTaken(f"version {base + 1} of {self.root} is already there") from problem
            raise
        if self.base is not None:
            self._of_thread.base = base + 1
        return base + 1
