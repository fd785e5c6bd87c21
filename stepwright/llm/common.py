"""What the operators of this folder share: the shared folder, files in it, word hashing.

Executors share only the folder named by ``spark.checkpoint.dir``. Every
intermediate table and every file that one task writes and another reads lies
there, under a name that no two runs have in common.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space and the ASCII controls from tab to carriage return.
SPACE = "\x20\x09-\x0d"
WORD_SQL = r"[^\x20\x09-\x0D]+"

#: Documents with their texts that one task should write, so that files are not small.
TASK_TEXTS = 20_000

_LOCAL_TMP: dict[str, str] = {}

#: Rows of an Arrow batch at most: whole texts are long, and a batch is held by the executor and by its worker.
BATCH_ROWS = 1_000

#: Memories of a worker process that end with each task: workers are used again, by other stages too.
TASK_MEMORIES: list[dict] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` is read from the session. Where it is unset a
    temporary folder is made, on a local master only: on a cluster a machine's
    own folder would not be seen by the others, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        hadoop = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = hadoop.get() if hadoop.isDefined() else None
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL_TMP:
        _LOCAL_TMP[key] = tempfile.mkdtemp(prefix="stepwright-")
        atexit.register(shutil.rmtree, _LOCAL_TMP[key], ignore_errors=True)
    return "file://" + _LOCAL_TMP[key]


def fresh_dir(spark: SparkSession, tag: str) -> str:
    """A folder name below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/stepwright/{tag}-{uuid.uuid4().hex}"


def few_tasks(spark: SparkSession, rows: int, per_task: int = 500_000) -> int:
    """How many tasks should hold ``rows`` narrow rows: two a core at least, more as the rows grow."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // per_task))


def materialize(df: DataFrame, tag: str, tasks: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Cuts the lineage: an executor that is lost later costs a reread of the
    table, not another run of what made it. ``tasks`` bounds the number of
    files where the rows are known to be few.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, tag)
    (df if tasks is None else df.coalesce(tasks)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing that is still to run reads them."""
    for t in tables:
        remove_dir(t.sparkSession, t.stored_at)


def remove_dir(spark: SparkSession, uri: str) -> None:
    """Delete a folder in the shared store."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def make_dir(spark: SparkSession, uri: str) -> None:
    """Make a folder in the shared store."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def open_store(uri: str):
    """(file system, path) for a folder or file of the shared store, on any machine."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        path = uri[5:]
        return fs.LocalFileSystem(), "/" + path.lstrip("/")
    return fs.FileSystem.from_uri(uri)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` whose workers give back at the end of each task what they hold.

    Where the session allows longer Arrow batches than ``BATCH_ROWS``, it is set to that.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            _forget()

    return df.mapInArrow(tidy, schema)


def _forget() -> None:
    """Empty the memories of this process and return its free pages to the system."""
    import ctypes

    import pyarrow as pa

    for memory in TASK_MEMORIES:
        memory.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        return


def values_of(column, step: int = 500):
    """The values of an Arrow array, some at a time: a batch of long texts is never held twice."""
    for i in range(0, len(column), step):
        yield from column.slice(i, step).to_pylist()


def attempt_name(prefix: str, suffix: str) -> str:
    """A file name that belongs to this attempt of this task alone.

    A task that is run again writes another file; the rows that it returns
    name the file they came with, so files of lost attempts are never read.
    """
    from pyspark import TaskContext

    t = TaskContext.get()
    n, a = (t.partitionId(), t.taskAttemptId()) if t else (0, 0)
    return f"{prefix}-{n:06d}-{a}-{uuid.uuid4().hex[:8]}{suffix}"


def text_or_empty(name: str = "text"):
    """The column, or '' for null."""
    return F.coalesce(F.col(name), F.lit(""))


def hash_partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
