"""O-101, O-19: stored results that are updated in place: tables cut into buckets by media, versions under a manifest.

A version's manifest names the folder of every bucket of every table.  An update rewrites the buckets of its media alone, into
a new folder, and then puts the next manifest in place, all tables at once.  Until that moment, and after any failure before it, readers
see the version before; files that no manifest names are left for ``vacuum``.  An update that carries a batch number
that its source has already brought is left out, so a stream's batches and repeated jobs take effect once.

Everything goes through Spark's readers and writers and Hadoop's file systems, so the folder may be in any store they reach.
"""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another update came first; the caller may read again and repeat."""


def work_folder(spark: SparkSession) -> str:
    """A new folder that all executors see: under ``spark.checkpoint.dir``, or, in local mode without it, a temporary one.

    It goes when the program ends, if its session is still there.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", top)
    folder = f"{top.rstrip('/')}/spanloom-{uuid.uuid4().hex}"
    _made.append((spark, folder))
    return folder


_made: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean() -> None:
    for spark, folder in _made:
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session has ended; the folder's own retention applies
            return


class ResultStore:
    """Tables with a media_id, such as spans and models, kept under ``root``.

    tables: each one's schema (DDL), which must have ``key``; buckets: into how many parts a table is cut by a hash of the key.  Both
    are fixed when a store is first written and are read from its manifest afterwards.
    """

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, str] | None = None, buckets: int = 64, key: str = "media_id"):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        first = {"version": 0, "key": key, "count": buckets, "schemas": {n: StructType.fromDDL(s).json() for n, s in (tables or {}).items()}, "folders": {n: {} for n in tables or {}}, "batches": {}}
        self._first = first

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/_manifests/{version:012d}.json"

    def versions(self) -> list[int]:
        """Versions there are, ascending."""
        return sorted(int(n.removesuffix(".json")) for n in self._names("_manifests") if n.endswith(".json") and n[:1].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The given version's, or the newest; before any update, that of an empty store."""
        known = self.versions()
        if version is None and not known:
            if not self._first["schemas"]:
                raise ValueError(f"there is no store at {self.root}")
            return self._first
        at = known[-1] if version is None else version
        return json.loads(self.spark.read.text(self._manifest_path(at), wholetext=True).first()[0])

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as of a version."""
        return self._read(self.manifest(version), table, None)

    def _read(self, manifest: dict, table: str, buckets: set[int] | None) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest["schemas"][table]))
        paths = [f"{self.root}/{p}" for b, p in sorted(manifest["folders"][table].items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, manifest: dict):
        return F.pmod(F.xxhash64(manifest["key"]), F.lit(manifest["count"])).cast("int")

    def update(self, new: dict[str, DataFrame], updated: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Rows of ``updated``'s keys are replaced by those of ``new``, in all tables named, as one version; its number.

        updated: the key and further columns, such as category, that all tables have: what is being replaced.  Rows
        of ``new`` outside of it are left out.  batch: (source, number); one not above the source's last does nothing.
        """
        manifest = self.manifest()
        if batch and manifest["batches"].get(batch[0], -1) >= batch[1]:
            return manifest["version"]
        on, key, bucket = updated.columns, manifest["key"], self._bucket(manifest)
        if key not in on or set(new) - set(manifest["schemas"]):
            raise ValueError(f"updated must have {key}, and tables must be among {sorted(manifest['schemas'])}")
        updated = updated.distinct()
        touched = {r[0] for r in updated.select(bucket.alias("b")).distinct().collect()}  # bounded by the number of buckets
        folders = {n: dict(f) for n, f in manifest["folders"].items()}
        part = f"data/{manifest['version'] + 1:012d}-{uuid.uuid4().hex}"
        for table, rows in new.items():
            names = [f.name for f in StructType.fromJson(json.loads(manifest["schemas"][table])).fields]
            old = self._read(manifest, table, touched).join(updated, on, "left_anti")
            fresh = rows.select(*names).join(updated, on, "left_semi")
            whole = old.select(*names).unionAll(fresh).withColumn("_bucket", bucket)
            whole.repartition(*([F.col("_bucket"), key])).write.partitionBy("_bucket").parquet(f"{self.root}/{part}/{table}")
            written = set(self._names(f"{part}/{table}"))
            for b in touched:
                name = f"_bucket={b}"
                folders[table].pop(str(b), None)  # a bucket without rows has no folder
                if name in written:
                    folders[table][str(b)] = f"{part}/{table}/{name}"
        batches = manifest["batches"] | ({batch[0]: batch[1]} if batch else {})
        return self._commit(manifest | {"version": manifest["version"] + 1, "folders": folders, "batches": batches})

    def _commit(self, manifest: dict) -> int:
        """The manifest appears whole or not at all, and only if no other one of its number is there."""
        target = self._manifest_path(manifest["version"])
        draft = f"{self.root}/_manifests/_draft-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(draft), False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(draft).toUri() if "://" in draft else self._fs.getUri())
        none = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(draft), self._path(target), none)
        except Py4JJavaError as e:
            self._fs.delete(self._path(draft), False)
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {manifest['version']} was written by another update") from e
            raise
        return manifest["version"]

    def vacuum(self, keep: int = 1) -> int:
        """Delete versions before the last ``keep`` and the bucket folders that no kept version names; how many folders went.

        Not to be run beside an update: its new folders are not named yet.
        """
        known = self.versions()
        used = {p for v in known[-keep:] for f in self.manifest(v)["folders"].values() for p in f.values()}
        for v in known[:-keep]:
            self._fs.delete(self._path(self._manifest_path(v)), False)
        gone = 0
        for part in self._names("data"):
            kept = [p for p in used if p.startswith(f"data/{part}/")]
            buckets = [f"data/{part}/{t}/{b}" for t in self._names(f"data/{part}") for b in self._names(f"data/{part}/{t}") if b.startswith("_bucket=")]
            for p in set(buckets) - set(kept):
                self._fs.delete(self._path(f"{self.root}/{p}"), True)
                gone += 1
            if not kept:
                self._fs.delete(self._path(f"{self.root}/data/{part}"), True)
        return gone

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return [f.getPath().getName() for f in self._fs.listStatus(path)] if self._fs.exists(path) else []
