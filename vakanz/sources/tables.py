"""Tables as immutable parquet versions behind a small manifest.

A writer never overwrites the files a reader may hold: it writes a new version folder and then
adds one manifest file. A run that dies before the manifest leaves the table as it was, and a
run that is repeated writes another folder.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vakanz.functions.text import content_hash
from vakanz.operators.common import dedupe_first
from vakanz.operators.upsert import upsert_versioned


class VersionedTable:
    """``root/v-*`` hold data, ``root/manifest`` lists the visible folders.

    A ``base`` folder is a whole table. A ``delta`` folder holds the rows one batch touched;
    readers take the newest row per key over the last base and the deltas after it, and
    ``compact`` turns them into a new base.
    """

    MANIFEST = "version long, folder string, kind string, note string"

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str] = ()):
        self.spark = spark
        self.root = root.rstrip("/")
        self.keys = list(keys)

    def _manifest(self) -> DataFrame | None:
        path = f"{self.root}/manifest"
        if not path_exists(self.spark, path):
            return None
        # a file that is just being written has no whole row yet
        return self.spark.read.json(path, schema=self.MANIFEST).filter(F.col("version").isNotNull())

    def has_note(self, note: str) -> bool:
        manifest = self._manifest()
        return manifest is not None and not manifest.filter(F.col("note") == note).isEmpty()

    def visible(self) -> list[tuple[int, str]]:
        """Newest base folder and the deltas after it; one small manifest row per commit."""
        manifest = self._manifest()
        if manifest is None:
            return []
        base = manifest.filter("kind = 'base'").agg(F.max("version")).scalar()
        rows = manifest.filter(F.col("version") >= F.coalesce(base, F.lit(0)))
        return [(r.version, r.folder) for r in rows.orderBy("version").collect()]

    def current(self) -> tuple[int, str | None]:
        folders = self.visible()
        return folders[-1] if folders else (0, None)

    def read(self) -> DataFrame | None:
        """The table as of the last commit."""
        folders = self.visible()
        if not folders:
            return None
        if len(folders) == 1:
            return self.spark.read.parquet(f"{self.root}/{folders[0][1]}")
        parts = [
            self.spark.read.parquet(f"{self.root}/{f}").withColumn("_version", F.lit(v))
            for v, f in folders
        ]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return dedupe_first(rows, self.keys, [F.col("_version").desc()]).drop("_version")

    def write_version(self, df: DataFrame, partition_by: Sequence[str] = ()) -> str:
        folder = f"v-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(f"{self.root}/{folder}")
        return folder

    def publish(self, folder: str, note: str = "", kind: str | None = None, after: int | None = None) -> int:
        """Make a written folder visible under the next free version.

        The manifest has one file per version, which only one writer can create; the others take
        the number after it. Without a ``kind`` the first version is a base and all others are
        deltas. ``after`` is the version a new base was made from: if another commit came in
        between, it would be hidden, so nothing is published and :class:`ConcurrentCommit` is raised.
        """
        while True:
            version = self.current()[0] + 1
            if after is not None and version != after + 1:
                raise ConcurrentCommit(f"{self.root} is at version {version - 1}, not {after}")
            row = {"version": version, "folder": folder, "note": note,
                   "kind": kind or ("base" if version == 1 else "delta")}
            if create_once(self.spark, f"{self.root}/manifest/v-{version:012d}.json", json.dumps(row) + "\n"):
                return version

    def replace(
        self, df: DataFrame, note: str = "", partition_by: Sequence[str] = (), after: int | None = None
    ) -> int:
        return self.publish(self.write_version(df, partition_by), note, "base", after)

    def append(self, delta: DataFrame, note: str = "") -> int:
        """Publish the rows of one batch; the first commit of a table is its base."""
        return self.publish(self.write_version(delta), note)

    def compact(self, note: str = "compacted") -> int:
        """Rewrite base and deltas as a new base; raises if a commit comes in meanwhile."""
        after = self.current()[0]
        return self.replace(self.read(), note, after=after)

    def vacuum(self, hours: float = 24) -> list[str]:
        """Delete data folders older than ``hours`` that no reader of the current version needs:
        those before the last base, and staged ones of batches that ended or failed."""
        held = {folder for _, folder in self.visible()}
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        limit = (time.time() - hours * 3600) * 1000
        gone = []
        for status in files.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("v-") and name not in held and status.getModificationTime() <= limit:
                files.delete(status.getPath(), True)
                gone.append(name)
        return gone


class ConcurrentCommit(RuntimeError):
    """Another writer committed first; read the table again and repeat."""


def create_once(spark: SparkSession, location: str, content: str) -> bool:
    """Write a small file; False if it exists, which the store decides for one writer at a time."""
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    try:
        out = files.create(path, False)
    except Py4JJavaError:
        if files.exists(path):
            return False
        raise
    out.write(bytearray(content.encode()))
    out.close()
    return True


def path_exists(spark: SparkSession, location: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)


def apply_upsert(
    postings: VersionedTable,
    snapshots_path: str,
    incoming: DataFrame,
    *,
    keys: Sequence[str],
    hash_cols: Sequence[str],
    now: Column,
    text_col: str,
    note: str = "",
) -> DataFrame:
    """Merge a batch into stored tables and return its outcomes.

    The batch is written once as staging data with its content hash, so the results neither read the
    landing files nor hash the texts again, and only the rows it touches are written. Snapshots are appended before the
    postings become visible; a snapshot is only added when its (key, hash) is unseen, so a
    repeated run adds nothing twice. A batch whose note is already listed returns no outcomes.
    """
    spark = postings.spark
    postings.keys = postings.keys or list(keys)
    if "content_hash" not in incoming.columns:
        incoming = incoming.withColumn("content_hash", content_hash([F.col(c) for c in hash_cols]))
    staged = postings.write_version(incoming)
    batch = spark.read.parquet(f"{postings.root}/{staged}")
    current = postings.read()
    if current is None:
        empty = batch.limit(0).withColumn("content_hash", F.lit(None).cast("string"))
        current = empty.withColumn("last_seen_at", now)
    schema = (
        ", ".join(f"{k} {batch.schema[k].dataType.simpleString()}" for k in keys)
        + ", content_hash string, change_kind string, fetched_at "
        + batch.select(now.alias("n")).schema["n"].dataType.simpleString()
        + ", cleaned_text string"
    )
    if path_exists(spark, snapshots_path):
        known = spark.read.schema(schema).parquet(snapshots_path)
    else:
        known = spark.createDataFrame([], schema)
    result = upsert_versioned(
        current, known, batch, keys=keys, hash_cols=hash_cols, now=now, text_col=text_col
    )
    outcomes = postings.write_version(result.outcomes)
    done = bool(note) and postings.has_note(note)
    if not done:
        folder = postings.write_version(result.delta)
        result.new_snapshots.write.mode("append").parquet(snapshots_path)
        postings.publish(folder, note)
    merged = spark.read.parquet(f"{postings.root}/{outcomes}")
    return merged.limit(0) if done else merged
