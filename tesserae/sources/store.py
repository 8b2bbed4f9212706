"""Log-structured tables on plain Parquet.

A commit writes rows that bear its own random id to each table it changes, then publishes by writing
(id, version) to `commits`. Readers see rows of published commits only, so that a commit which fails
half-way leaves nothing to see, then or later. Of each key the row of the greatest version counts. A
transaction publishes several commits by one write; inside it its own rows are seen. One writer at a
time. Tables with tenants are laid out by tenant and namespace, so a scope's filter prunes folders.
"""
from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.errors import ConfigurationError, StoreError
from tesserae.schema import KEYS, TABLES, VERSION

LAYOUT = ("tenant_id", "namespace")
COMMITS = "commit string, version bigint"
#: Commits that are broadcast when a table is read; a store with more of them joins by shuffle until it is compacted.
FEW = 200_000


def columns_of(name: str) -> list[str]:
    return [f.split(" ")[0] for f in TABLES[name].split(", ")]


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._pending: list[tuple[str, int]] | None = None

    def _exists(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def commits(self) -> DataFrame:
        """(commit, version) of all that may be seen."""
        empty = self.spark.createDataFrame(self._pending or [], COMMITS)
        return self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits").union(empty) if self._exists("commits") else empty

    def version(self) -> int:
        return self.commits().agg(F.max("version")).first()[0] or 0

    def log(self, name: str, at: int | None = None, columns: list[str] | None = None) -> DataFrame:
        """All rows of a table that are published, with their version; only the named columns are read."""
        want = columns_of(name) if columns is None else columns
        if not self._exists(name):
            return self.spark.createDataFrame([], TABLES[name] + ", version bigint").select(*want, "version")
        seen = self.commits() if at is None else self.commits().where(F.col("version") <= at)
        seen = F.broadcast(seen) if seen.count() <= FEW else seen
        rows = self.spark.read.schema(TABLES[name] + ", commit string").parquet(f"{self.path}/{name}")
        return rows.select(*want, "commit").join(seen, "commit").drop("commit")

    def latest(self, name: str, at: int | None = None, without: tuple = ()) -> DataFrame:
        """One row for each key, less the columns in `without`, which are not read. Partial aggregation keeps one
        row of a key in each task before the shuffle; filters on key columns reach the scan."""
        want = [c for c in columns_of(name) if c not in without]
        log = self.log(name, at, want)
        cols = [c for c in want if c not in KEYS[name]]
        out = log.groupBy(*KEYS[name]).agg(F.max_by(F.struct(*cols), "version").alias("r")).select(*KEYS[name], "r.*")
        return out.where("not coalesce(gone, false)").drop("gone") if "gone" in cols else out

    def _checked(self, name: str, rows: DataFrame | list[dict]) -> DataFrame | None:
        """Rows with all columns of a table; None if a list is empty."""
        names = columns_of(name)
        if isinstance(rows, list):
            if not rows:
                return None
            rows = self.spark.createDataFrame([tuple(r.get(f) for f in names) for r in rows], TABLES[name]).coalesce(1)
        if "gone" in names and "gone" not in rows.columns:
            rows = rows.withColumn("gone", F.lit(False))
        if set(names) - set(rows.columns):
            raise StoreError(f"{name} lacks {sorted(set(names) - set(rows.columns))}")
        return rows.select(*names)

    def commit(self, changes: dict[str, DataFrame | list[dict]]) -> int:
        """Append the changes as one version; all are checked before the first is written."""
        version, own = self.version() + 1, uuid.uuid4().hex
        if version == 1:
            changes = changes | {"settings": [*changes.get("settings", []), {"key": "schema", "value": str(VERSION), "updated_at": None}]}
        checked = {name: rows for name, raw in changes.items() if (rows := self._checked(name, raw)) is not None}
        for name, rows in checked.items():
            parts = [c for c in LAYOUT if c in rows.columns]
            rows.withColumn("commit", F.lit(own)).write.mode("append").partitionBy(*parts).parquet(f"{self.path}/{name}")
        if self._pending is None:
            self._publish([(own, version)])
        else:
            self._pending.append((own, version))
        return version

    def _publish(self, rows: list[tuple[str, int]]) -> None:
        if rows:
            self.spark.createDataFrame(rows, COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    @contextmanager
    def transaction(self):
        """Commits inside are published by one write at the end, or not at all; one inside another joins it."""
        if self._pending is not None:
            yield self
            return
        self._pending = []
        try:
            yield self
            self._publish(self._pending)
        finally:
            self._pending = None

    def schema_version(self) -> int:
        """The version that the store was made with; the library's own for a store without commits."""
        row = self.latest("settings").where("key = 'schema'").first()
        return int(row.value) if row else VERSION

    def migrate(self) -> int:
        """Bring an older store to the library's schema: columns that it lacks read as null, so only its version
        is written anew. A store of a newer schema is refused."""
        found = self.schema_version()
        if found > VERSION:
            raise ConfigurationError(f"the store has schema {found}, this library knows {VERSION}")
        if found < VERSION:
            self.commit({"settings": [{"key": "schema", "value": str(VERSION), "updated_at": None}]})
        return found

    def compact(self, target: str) -> "Store":
        """A new store at target that holds the latest rows alone."""
        out = Store(self.spark, target)
        out.commit({name: self.latest(name) for name in TABLES if name != "settings"} | {"settings": [r.asDict() for r in self.latest("settings").where("key <> 'schema'").collect()]})  # a handful of settings
        return out
