"""Session defaults, table loading and lineage cutting.

Nothing here changes a session that already exists: cluster settings win over ours.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Defaults for a session of our own. A cluster sets its own sizes; these only make local runs behave like one.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", app: str = "tallyrill", **conf: str) -> SparkSession:
    """A session with our defaults; keyword settings use ``__`` for dots and win over the defaults."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the session names. Where it names none, a temporary one in local mode, as in
    tests; on a cluster, whose executors don't share their disks, that raises."""
    context = spark.sparkContext
    named = context._jsc.sc().getCheckpointDir()
    if named.isDefined():
        return named.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tallyrill-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session, the width used where a stage has to name one."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def spread(df: DataFrame) -> DataFrame:
    """A bare scan in at least as many parts as there are cores: a table of fewer files would leave cores idle in a
    step that costs much more than moving its rows. A table of enough files is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
