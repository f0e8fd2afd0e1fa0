"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every operator relies on. They are runtime SQL settings, so they can
# also be applied to a session somebody else built.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join partition even where that costs one more shuffle above.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Window stages cost far more per byte than a plain scan: let small shuffles
    # still use every core. Large ones are cut by the advisory size as usual.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16kb",
    # The JVM never compiles a method of more than 8000 bytes. Wide feature and rule chains generate such
    # methods; beyond this limit Spark evaluates them as many small ones, which are compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Temporary folder of each application with a local master. Spark fixes
# spark.checkpoint.dir when it starts, so the folder cannot be kept there.
_LOCAL_FOLDERS: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "skyledger") -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        # Wide feature plans generate more classes than the default cache holds.
        .config("spark.sql.codegen.cache.maxEntries", "1000")
        # Recording a Python call site for every column costs more than the column.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by ``spark.checkpoint.dir``.

    A temporary folder, one for each application, is made only where that is unset and
    the master is local, so driver and executors share one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="skyledger-")
    return _LOCAL_FOLDERS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/skyledger/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts lineage, survives lost executors, and gives the planner the real
    size of the table: a later join broadcasts it only when it is below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly over ``spark.sql.shuffle.partitions`` partitions, one for each core at least.

    For rows whose work is far greater than their bytes: a small file is one task, however much is computed on its
    rows. Rows are dealt in turn, so no key decides where they go and none can be hot.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
