"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Rows a block may hold. Every ordered operator works on blocks of a recording, never on
# a whole recording, so one huge recording spreads over many tasks.
BLOCK_ROWS_KEY = "spark.pinglake.block.rows"
BLOCK_ROWS_DEFAULT = 65536

_SETTINGS = {
    # Epoch seconds are the time key; wall-clock columns are read as UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Without this, rows already hashed by (recording) are taken as good enough for a
    # window or aggregate by (recording, block), and a hot recording stays in one task.
    "spark.sql.requireAllClusterKeysForDistribution": "true",
    # Spark takes a stored frame's size for its rows' before they are read, but broadcast rows
    # take many times as much in the driver. Sizes measured while a query runs are not affected.
    "spark.sql.sources.fileCompressionFactor": "8",
    # Masks pack so tightly that a whole survey's fit the default least size of a task, 1 MB, but
    # each row is as much work as ever. Below it, tasks are joined only down to the cores' number.
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k",
    # Folders of many recordings are listed by this many tasks at most, not ten thousand.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "256",
}

# Before an array is exploded, this rule filters by its size. That filter, pushed down, works the array
# out once more from its sources, and where a lambda holds one of them, once more per element.
_EXCLUDED = "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate"


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application.

    Functions are pickled by name, so a worker must be able to import the package even when
    only the driver has it on its path. Spark serves the archive from the driver.
    """
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.abspath(__file__))
        if os.path.isdir(root):  # else it was itself imported from an archive that workers have
            path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="pinglake-")), "pinglake.zip")
            with zipfile.ZipFile(path, "w") as z:
                for folder, _, names in os.walk(root):
                    for n in sorted(names):
                        if n.endswith(".py"):
                            f = os.path.join(folder, n)
                            z.write(f, os.path.join("pinglake", os.path.relpath(f, root)))
            spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    return spark


_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to a running session."""
    ship(spark)
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    rules = [r for r in spark.conf.get("spark.sql.optimizer.excludedRules", "").split(",") if r.strip()]
    if _EXCLUDED not in rules:
        spark.conf.set("spark.sql.optimizer.excludedRules", ",".join([*rules, _EXCLUDED]))
    if spark.sparkContext.master.startswith("local") and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return spark


def local_session(cpus: str = "*", app: str = "pinglake", **conf) -> SparkSession:
    """A local session for tests and benches."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def block_rows(spark: SparkSession | None = None) -> int:
    spark = spark or SparkSession.getActiveSession()
    return int(spark.conf.get(BLOCK_ROWS_KEY, str(BLOCK_ROWS_DEFAULT)))


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the one the session names for checkpoints.

    Only a local master may fall back to a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        path = tempfile.mkdtemp(prefix="pinglake-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df, name: str = "stage"):
    """Write a frame to the shared folder and read it back.

    Used where a derived frame feeds several branches, and in loops: the plan starts anew
    at a stored table, nothing is computed twice, and a lost executor costs no rework of
    earlier steps. Being columnar, later steps still read only the columns they need.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def ensure(spark: SparkSession, key: tuple, build) -> str:
    """Path of a table or folder written once per application; ``build`` writes it and says where."""
    k = (spark.sparkContext.applicationId, *key)
    if k not in _WRITTEN or not exists(spark, _WRITTEN[k]):
        _WRITTEN[k] = build()
    return _WRITTEN[k]


_WRITTEN: dict[tuple, str] = {}
