"""Session construction and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(master: str = "local[*]", app: str = "quillveil", **conf: str) -> SparkSession:
    """A session with the settings that the queries assume; `conf` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what `spark.checkpoint.dir` names. Only where that is unset and Spark runs
    in local mode, as in tests, is a local temporary folder taken, and it becomes
    the setting of the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillveil-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: What this process wrote, in order, by application.
_written: dict[str, list[str]] = {}


def _own_folder(spark: SparkSession) -> str:
    """The part of the shared folder that this application alone uses."""
    return f"{scratch_dir(spark)}/quillveil/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the application's part of the shared folder."""
    path = f"{_own_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back.

    This cuts the lineage with files that outlive any executor, and gives the
    reader fresh exchanges, so adaptive execution can split skewed joins on it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame, tag: str) -> DataFrame:
    """`materialize`, and then delete everything else that this application wrote: for results that stand on their own, such as a stage's."""
    out = materialize(df, tag)
    written = _written[df.sparkSession.sparkContext.applicationId]
    for path in written[:-1]:
        _delete(df.sparkSession, path)
    del written[:-1]
    return out


def release_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote; call it once results are consumed. Other applications on the same folder keep theirs."""
    _written.pop(spark.sparkContext.applicationId, None)
    _delete(spark, _own_folder(spark))


def plan_bytes(df: DataFrame) -> int:
    """Size of a plan's result as the optimizer sees it; a scan's is that of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


#: Written bytes up to which a side is broadcast.
MOST_BROADCAST = 16 << 20


def small_side(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """The side of a join, marked for broadcast if its files show that it is small; for sides whose partner is wide. Written tables only."""
    return F.broadcast(df) if plan_bytes(df) <= most else df


def spread(df: DataFrame, key: str, least: int = 1 << 20, most_per_core: int = 16 << 20) -> DataFrame:
    """Deal a small table out to all cores by a key before work that the processors bound.

    A small file often is one row group, hence one task. Tables with more than
    `most_per_core` bytes for each core have splits enough and stay as they are,
    as do tiny ones.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if least < plan_bytes(df) < most_per_core * cores else df


def partitions_for(df: DataFrame, most_bytes: int = 64 << 20) -> int:
    """Partitions for an explicit shuffle of `df`: the session's number, or more where the plan's size asks for it."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = plan_bytes(df)
    # Without statistics Spark assumes an absurd size; then the session's number stands.
    return least if size > 1 << 60 else max(least, -(-size // most_bytes))
