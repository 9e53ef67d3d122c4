"""Where operators keep intermediate tables and files.

Every write goes below the folder that the session names in ``spark.checkpoint.dir``, which executors
and driver share. Only where that setting is missing (tests, a notebook in local mode) a folder of the
local machine is made and set.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode, where it is unset, a new folder of this machine, and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            at = jvm_dir.get()
        elif not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        else:
            at = tempfile.mkdtemp(prefix="tessera-")
            spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def bounded_batches(spark: SparkSession, most_bytes: int = 4 << 20) -> None:
    """Let Arrow batches hold about ``most_bytes``, whatever their rows, and Parquet readers decode 512 rows at a time.

    Ten thousand rows of text, or 4096 in a reader's column, can be very long; both are held whole by the JVM.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: its lineage ends there."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def put(uri: str, write) -> None:
    """Call ``write(stream)`` on a new file and give it its name only when it is whole.

    A task that runs twice (a lost executor, speculation) writes the same bytes, so the last one may win.
    """
    system, path = filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as stream:
        write(stream)
    system.move(part, path)
