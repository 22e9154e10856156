"""Reading and writing event tables as files, and deriving streams from them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import partition_of


def read_events(spark: SparkSession, *paths: str, schema: StructType | None = None) -> DataFrame:
    """Parquet folders or files as one table; with a schema, no file is opened for planning."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(*paths)


def first_events(events: DataFrame, n: int, ts: str = "ts", tiebreak: str = "event_id") -> DataFrame:
    """The first n events by time; a bounded heap in each task and one merge."""
    return events.orderBy(ts, tiebreak).limit(n)


def write_events(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    events.write.mode(mode).parquet(path)


def write_round_robin(events: DataFrame, path: str, n: int, ts: str = "ts") -> None:
    """n files of about equal size, each in order of time."""
    events.repartition(n).sortWithinPartitions(ts).write.parquet(path)


def write_by_key(events: DataFrame, path: str, n: int, key: str, ts: str = "ts") -> None:
    """Folders ``part=0`` to ``part=n-1`` by hash of a key, each in order of time: all of a key is in one.

    A folder holding a hot key is written by as many tasks as its rows need: rows are dealt by folder and time,
    and folders stay readable by key.
    """
    dealt = events.withColumn("part", partition_of(F.col(key), n))
    dealt.repartitionByRange("part", ts).sortWithinPartitions("part", ts).write.partitionBy("part").parquet(path)


def stream_events(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """A stream that takes up a folder's files, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session that driver and executors see, under ``spark.checkpoint.dir``; it is deleted with the session.

    Where that setting is missing, a local master gets a temporary folder and any other an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not top:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
            top = "file://" + tempfile.mkdtemp(prefix="tidemark-")
            spark.conf.set("spark.checkpoint.dir", top)
            spark.sparkContext.setCheckpointDir(top)
        folder = f"{top.rstrip('/')}/tidemark-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _folders[app] = folder
    return _folders[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the session's shared folder; nothing is there yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
