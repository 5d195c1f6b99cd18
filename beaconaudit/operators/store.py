"""Keeping a result that several jobs read, where a lost executor cannot take it along."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: How tables are packed: context lines and the like repeat what stands next to them.
PACKED = {"compression": "zstd"}
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where nothing is named, local mode gets a temporary folder (driver and executor are one
    process there); a cluster is refused, as no other folder is known to be shared.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="beaconaudit-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing else uses; ``forget`` removes what is put there."""
    path = f"{shared_folder(spark)}/beaconaudit-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stored(frame: DataFrame) -> DataFrame:
    """``frame`` as a table written once and read back: its lineage ends there.

    Sorting samples its input and a joined count reads it again; from a table both are
    cheap, from a scan they would be the scan once more. A stream is returned as it is.
    """
    if frame.isStreaming:
        return frame
    path = new_folder(frame.sparkSession)
    frame.write.options(**PACKED).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def made() -> list[str]:
    """The paths that this process has put into the shared folder and not removed."""
    return list(_written)


def forget(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Removes every table this process stored, or those at ``paths``; call it when their results are no longer read."""
    jvm, removed = spark.sparkContext._jvm, 0
    for name in made() if paths is None else [p for p in paths if p in _written]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        removed += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _written.remove(name)
    return removed
