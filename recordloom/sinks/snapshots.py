"""Stage snapshots: written tables that can be read again and cut the lineage."""

from __future__ import annotations

import hashlib
import json
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_local_root: dict[str, str] = {}
_open = threading.local()


def snapshot_root(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would lose the data with the machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "root" not in _local_root:
        _local_root["root"] = tempfile.mkdtemp(prefix="recordloom-")
    return _local_root["root"]


def cut(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a frame to the shared folder and go on from the written table.

    The written files survive the loss of executors, and their sizes tell the
    optimizer whether a side may be broadcast. Inside ``scratch`` the table is dropped
    when that ends.
    """
    path = f"{snapshot_root(df.sparkSession)}/cut/{name}-{uuid.uuid4().hex}"
    if getattr(_open, "tables", None):
        _open.tables[-1].append(path)
    df.write.partitionBy(*(partition_by or [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Remove a written table, wherever it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that are cut inside are dropped at the end, also of a failure. What goes on
    being read has to be written elsewhere, or to be taken out of the list."""
    tables: list[str] = []
    _open.tables = [*getattr(_open, "tables", []), tables]
    try:
        yield tables
    finally:
        _open.tables = _open.tables[:-1]
        for path in tables:
            drop(spark, path)


def new_run_id() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S_%f")


def save_snapshot(df: DataFrame, stage: str, run_id: str, root: str | None = None) -> str:
    """Write the rows of a stage under its name and run."""
    base = root or f"{snapshot_root(df.sparkSession)}/stages"
    path = f"{base}/{stage}/run_id={run_id}"
    df.write.mode("overwrite").parquet(path)
    return path


def load_snapshot(spark: SparkSession, stage: str, run_id: str | None = None, root: str | None = None):
    """The snapshot of a run, by default the newest; None when there is none."""
    base = f"{root or snapshot_root(spark) + '/stages'}/{stage}"
    try:
        if run_id is None:
            # Run folders are partitions, and a failed write leaves none.
            run_id = spark.read.parquet(base).agg(F.max("run_id")).first()[0]
        return spark.read.parquet(f"{base}/run_id={run_id}")
    except AnalysisException:
        return None


def fingerprint(spark: SparkSession, df: DataFrame, *more) -> str:
    """A digest of the files that a frame reads (names, sizes, times), its columns, and ``more``."""
    files = []
    for name in sorted(df.inputFiles()):
        where = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
        files.append((name, status.getLen(), status.getModificationTime()))
    return hashlib.sha256(json.dumps([files, df.schema.json(), [repr(m) for m in more]]).encode()).hexdigest()


class Stages:
    """The written stages of a run, with a manifest: which are complete, with which schema, and from what.

    A stage is entered in the manifest after its table is written, so what a killed run
    left half written is not taken for done.
    """

    def __init__(self, spark: SparkSession, run_id: str, root: str | None = None):
        self.spark, self.run_id = spark, run_id
        self.base = root or f"{snapshot_root(spark)}/stages"
        self.manifest = f"{snapshot_root(spark) if root is None else root}/manifests/{run_id}"

    def done(self) -> dict[str, dict]:
        """The entries of all complete stages by name."""
        try:
            rows = self.spark.read.option("recursiveFileLookup", True).text(self.manifest).collect()  # one row a stage
        except AnalysisException:
            return {}
        return {e["stage"]: e for e in (json.loads(r["value"]) for r in rows)}

    def table(self, stage: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table: the written one if the manifest has it from the same ``source``, else made and written."""
        return self.counted(stage, source, lambda: (make(), None))[0]

    def counted(self, stage: str, source: str, make: Callable[[], tuple[DataFrame, Observation | None]]) -> tuple[DataFrame, dict]:
        """The same with what an observation counted while the table was written."""
        entry = self.done().get(stage)
        if entry is None or entry["source"] != source:
            df, seen = make()
            save_snapshot(df, stage, self.run_id, self.base)
            entry = {"stage": stage, "source": source, "schema": df.schema.json(), "counts": seen.get if seen else {}}
            line = self.spark.createDataFrame([(json.dumps(entry),)], "value string")
            line.coalesce(1).write.mode("overwrite").text(f"{self.manifest}/{stage}")
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        return self.spark.read.schema(schema).parquet(f"{self.base}/{stage}/run_id={self.run_id}"), entry["counts"]

    def drop(self) -> None:
        """Remove the run's tables and its manifest."""
        for stage in self.done():
            drop(self.spark, f"{self.base}/{stage}/run_id={self.run_id}")
        drop(self.spark, self.manifest)
