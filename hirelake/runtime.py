"""Session-level helpers: tables, the shared folder, lineage cuts, shipping the package."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Work folders of this process, deleted when it ends.
_WORK: dict[str, tuple[SparkSession, str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where none is set, a local session gets a temporary one; a cluster is refused, since a folder of one
    machine would be lost with it.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    target = sc.getConf().get("spark.checkpoint.dir", None)
    if not target:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        target = tempfile.mkdtemp(prefix="hirelake-checkpoints-")
    sc.setCheckpointDir(target)
    return target


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path on any file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = file_system(spark, path)
    return fs.exists(where)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    fs, where = file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, where = file_system(spark, path)
    fs.delete(where, True)


def work_folder(spark: SparkSession) -> str:
    """A folder of this application in the shared folder; it is deleted when the process ends."""
    application = spark.sparkContext.applicationId
    if application not in _WORK:
        if not _WORK:
            atexit.register(clean_up)
        root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/hirelake-{application}-{uuid.uuid4().hex[:8]}"
        fs, where = file_system(spark, root)
        fs.mkdirs(where)
        _WORK[application] = spark, root
    return _WORK[application][1]


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder of its own in the work folder; not created yet."""
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def clean_up() -> None:
    """Delete the work folders of this process."""
    while _WORK:
        spark, root = _WORK.popitem()[1]
        try:
            remove(spark, root)
        except Exception:  # noqa: BLE001  the session has ended before
            pass


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Parquet looks at what a task has gathered only every hundred rows, and keeps the least and greatest value of
#: each row group until the file ends.
LARGE_ROWS = {"maxRecordsPerFile": 1, "parquet.enable.dictionary": False, "parquet.column.statistics.enabled": False}


def stored(df: DataFrame, name: str = "table", large_rows: bool = False) -> DataFrame:
    """Materialise df as a compressed columnar table in the work folder and cut its lineage.

    Unlike a checkpoint, readers take only the columns they need, and sizes are known to the planner.
    With large_rows, which is for rows of megabytes, every row is a file of its own, so that writing takes the
    memory of one row, however many a task has.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(compression="zstd", **(LARGE_ROWS if large_rows else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_hirelake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    archive = f"{work_folder(spark)}/hirelake.zip"
    fs, where = file_system(spark, archive)
    stream = fs.create(where, True)
    try:
        stream.write(packed.getvalue())
    finally:
        stream.close()
    sc.addPyFile(archive)
    sc._hirelake_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """Round-robin over all cores where a scan came in far fewer pieces than there are cores.

    Frames with a shuffle are left alone: only running them would tell their pieces.
    """
    query = df._jdf.queryExecution()
    if query.executedPlan().nodeName().startswith("AdaptiveSparkPlan"):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * query.toRdd().getNumPartitions() <= cores else df
