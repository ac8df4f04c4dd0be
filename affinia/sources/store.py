"""A store of tables: each publication is a new folder, and a pointer names the current one."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinia.operators.changes import upserted
from affinia.schemas import READER_SHAPE, SCHEMA_VERSION, TABLES

#: Tables that must not lose rows from one publication to the next.
GUARDED = ("items", "plays", "enrichment")


class ShapeError(Exception):
    """The store was written in a shape that this reader doesn't know."""


def digest(df: DataFrame) -> dict:
    """rows and a sum of the rows' hashes: equal for the same rows in any order, with one small row to the driver."""
    columns = sorted(df.columns)
    hashed = F.xxhash64(*columns, *[F.col(c).isNull() for c in columns]).cast("decimal(20,0)")
    found = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(hashed).alias("sum")).first()
    return {"rows": found["rows"], "sum": str(found["sum"] or 0)}


class Store:
    """Tables under root/v<n>/<table>; the manifest in root/v<n>/_meta names the shape, and each table's version and digest."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = [int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}/_meta/_SUCCESS"))]
        return sorted(done)

    def _at(self, version: int | None) -> str:
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"nothing was published under {self.root}")
        return f"{self.root}/v{found[-1] if version is None else version}"

    def check_shape(self, version: int | None = None) -> dict:
        meta = json.loads(self.spark.read.text(f"{self._at(version)}/_meta").first()[0])
        if meta["reader_shape"] != READER_SHAPE:
            raise ShapeError(f"shape {meta['reader_shape']}, not {READER_SHAPE}")
        return meta

    def table(self, name: str, version: int | None = None) -> DataFrame:
        meta = self.check_shape(version)
        if name not in meta["tables"]:
            return self.spark.createDataFrame([], TABLES[name].schema)
        return self.spark.read.schema(TABLES[name].schema).parquet(f"{self.root}/v{meta['tables'][name]}/{name}")

    def publish(self, tables: Mapping[str, DataFrame], shrink: Mapping[str, int] | None = None, keep: bool = False) -> int:
        """Writes the tables as a new version; readers see it when its _meta is complete.

        A guarded table may lose rows only if shrink names the count it must then have. With keep the other
        tables of the version before stay: its files are named again, not written again.
        """
        versions = self.versions()
        version = (versions[-1] if versions else 0) + 1
        at = f"{self.root}/v{version}"
        for name, df in tables.items():
            declared = df.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[name].schema])
            declared.write.mode("overwrite").parquet(f"{at}/{name}")
        before = self.check_shape() if versions else {"tables": {}}
        held = before.get("digests", {})
        digests = {name: digest(self.spark.read.schema(TABLES[name].schema).parquet(f"{at}/{name}")) for name in tables}
        for name in GUARDED:
            if versions and name in tables:
                old, new = held[name]["rows"] if name in held else self.table(name).count(), digests[name]["rows"]
                if new < old and (shrink or {}).get(name) != new:
                    raise ValueError(f"{name} would shrink from {old} to {new} rows")
        stay = keep and versions
        self._seal(version, {**(before["tables"] if stay else {}), **dict.fromkeys(sorted(tables), version)}, {**(held if stay else {}), **digests})
        return version

    def _seal(self, version: int, tables: Mapping[str, int], digests: Mapping[str, dict]) -> None:
        """Writes a version's manifest: readers see the version, whole, from then on."""
        meta = json.dumps({"schema_version": SCHEMA_VERSION, "reader_shape": READER_SHAPE, "tables": tables, "digests": digests})
        self.spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/v{version}/_meta")

    def publish_changed(self, tables: Mapping[str, DataFrame], shrink: Mapping[str, int] | None = None) -> tuple[int, list[str]]:
        """The version that holds these tables, and which were written: those whose digests differ, all in one new version.

        Without a difference there is no new version. The tables are read for their digests before anything is written.
        """
        held = self.check_shape().get("digests", {}) if self.versions() else {}
        changed = {}
        for name, df in tables.items():
            declared = df.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[name].schema])
            if digest(declared) != held.get(name):
                changed[name] = df
        if not changed:
            return self.versions()[-1], []
        return self.publish(changed, shrink, keep=True), sorted(changed)

    def rollback(self, version: int) -> int:
        """A new version with the tables of an earlier one: its files are named again, its row counts are not guarded."""
        meta = self.check_shape(version)
        new = self.versions()[-1] + 1
        self._seal(new, meta["tables"], meta.get("digests", {}))
        return new

    def damaged(self, version: int | None = None) -> list[str]:
        """The tables of a version whose rows are no longer those of its manifest."""
        digests = self.check_shape(version).get("digests", {})
        return sorted(name for name, known in digests.items() if digest(self.table(name, version)) != known)

    def upsert(self, name: str, rows: DataFrame, update: bool = True) -> int:
        """A new version in which a table has rows by its key."""
        old = self.table(name)
        return self.publish({name: upserted(old, rows.select(*old.columns), TABLES[name].key, update)}, keep=True)
