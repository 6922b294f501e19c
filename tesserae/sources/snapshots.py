"""Tables kept as snapshots: immutable segments, and a manifest for each version that a commit creates.

A writer puts its rows into a folder of its own and then creates the next manifest; creating fails if
another writer was first, and rows without a manifest are never read. Readers merge on read: of each key
the row of the last segment counts, unless a later one buried it. So a lost task, a failed writer or a
reader in between never sees half of a change, and every version stays readable until it is swept away.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer committed first; read the new version and try again."""


class Folder:
    """Files below a root that Spark's readers open, through the file system that the path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def create(self, name: str, text: str) -> None:
        """A new file with this text; Conflict if there is one."""
        hadoop, gateway = self.spark._jvm.org.apache.hadoop.fs, self.spark.sparkContext._gateway
        fs, path, part = self._fs(), self._path(name), self._path(f"_parts/{uuid.uuid4().hex}")
        out = fs.create(part, True)
        out.write(text.encode())
        out.close()
        fs.mkdirs(path.getParent())
        rename = getattr(hadoop, "Options$Rename")
        never_over = gateway.new_array(rename, 1)
        never_over[0] = rename.NONE
        try:  # written whole under another name before, so that no reader finds half of it
            hadoop.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration()).rename(part, path, never_over)
        except Exception as e:
            fs.delete(part, False)
            if fs.exists(path):
                raise Conflict(name) from e
            raise

    def read(self, name: str) -> str:
        stream = self._fs().open(self._path(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def remove(self, name: str) -> None:
        self._fs().delete(self._path(name), True)


class Manifests:
    """The versions of one store. A version is a dict; version 0 is the empty one."""

    def __init__(self, folder: Folder):
        self.folder = folder

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.folder.names("_manifests") if n.endswith(".json"))

    def load(self, version: int | None = None) -> tuple[int, dict]:
        if version is None:
            version = max(self.versions(), default=0)
        return (version, json.loads(self.folder.read(f"_manifests/{version:012d}.json"))) if version else (0, {"segments": []})

    def commit(self, base: int, manifest: dict) -> int:
        self.folder.create(f"_manifests/{base + 1:012d}.json", json.dumps(manifest))
        return base + 1


class SnapshotTable:
    """Rows by key: put, delete by a column, read any version, compact."""

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.key = spark, key
        self.folder = Folder(spark, root)
        self.manifests = Manifests(self.folder)

    def _stage(self, rows: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder.root}/{name}")
        return name

    def _add(self, base: int, manifest: dict, rows: DataFrame, kind: str) -> int:
        segment = {"path": self._stage(rows), "kind": kind, "seq": base + 1}
        return self.manifests.commit(base, {"segments": [*manifest["segments"], segment]})

    def put(self, rows: DataFrame, seq: str | None = None) -> int:
        """Writes rows over those of the same keys and gives the new version. Of several rows of a key the last by `seq` counts, or any one."""
        base, manifest = self.manifests.load()
        if seq is None:
            once = rows.dropDuplicates([self.key])
        else:
            rest = [c for c in rows.columns if c != self.key]
            once = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(self.key, "_r.*")
        return self._add(base, manifest, once, "rows")

    def delete(self, column: str, value) -> tuple[int, int]:
        """Buries the rows whose column has the value: (the new version, how many)."""
        base, manifest = self.manifests.load()
        rows = self.read(base)
        if rows is None:
            return base, 0
        name = self._stage(rows.filter(F.col(column) == F.lit(value)).select(self.key))
        removed = self.spark.read.parquet(f"{self.folder.root}/{name}").count()
        if not removed:
            return base, 0
        segment = {"path": name, "kind": "buried", "seq": base + 1}
        return self.manifests.commit(base, {"segments": [*manifest["segments"], segment]}), removed

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, the newest by default; None of the empty one.

        A segment is compared only with the keys of later ones, so a large first segment and small changes make one scan and a small join.
        """
        _, manifest = self.manifests.load(version)
        parts = [(s, self.spark.read.parquet(f"{self.folder.root}/{s['path']}")) for s in manifest["segments"]]
        rows = [df.withColumn("_seq", F.lit(s["seq"])) for s, df in parts if s["kind"] == "rows"]
        if not rows:
            return None
        out = rows[0]
        for more in rows[1:]:
            out = out.unionByName(more, allowMissingColumns=True)
        later = [df.select(F.col(self.key).alias("_key"), F.lit(s["seq"]).alias("_last")) for s, df in parts[1:]]
        if later:
            keys = later[0]
            for more in later[1:]:
                keys = keys.unionByName(more)
            keys = keys.groupBy("_key").agg(F.max("_last").alias("_last"))
            out = out.join(keys, out[self.key].eqNullSafe(keys["_key"]), "left").filter("_last IS NULL OR _last <= _seq").drop("_key", "_last")
        return out.drop("_seq")

    def compact(self) -> int:
        """One segment with the rows of the newest version."""
        base, manifest = self.manifests.load()
        rows = self.read(base)
        if rows is None or len(manifest["segments"]) < 2:
            return base
        return self.manifests.commit(base, {"segments": [{"path": self._stage(rows), "kind": "rows", "seq": base + 1}]})

    def sweep(self) -> int:
        """Removes older versions and all data that the newest one does not name; no writer may be under way. Gives the number of folders removed."""
        version, manifest = self.manifests.load()
        kept = {s["path"].split("/")[-1] for s in manifest["segments"]}
        gone = [n for n in self.folder.names("data") if n not in kept]
        for n in gone:
            self.folder.remove(f"data/{n}")
        for v in self.manifests.versions():
            if v < version:
                self.folder.remove(f"_manifests/{v:012d}.json")
        return len(gone)
