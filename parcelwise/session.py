"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the jobs profit from. They belong to whoever builds the session: the library sets none of them in a
#: session that runs.
ADVISED = {
    # ``row_number() <= k`` is cut inside the map tasks, before the shuffle, up to this k (Spark's own: 1000).
    "spark.sql.optimizer.windowGroupLimitThreshold": "2001",
    # A score is longer than the 8000 bytes up to which HotSpot compiles a method; above the limit Spark
    # evaluates it as split projections, about four times faster.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names for intermediate data, reachable from every executor.

    A cluster has to name one. A local session that names none is given a checkpoint folder of its own, which its context
    remembers; no setting is changed.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if not folder and context.master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="parcelwise-"))
        folder = context.getCheckpointDir()
    if not folder:
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written files.

    For frames that several branches of a plan read. The files outlive the executors that wrote them,
    and Parquet keeps column pruning for the branches, which a checkpoint would lose.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_session(cores: int | str = 8, name: str = "parcelwise") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config(map=ADVISED)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
