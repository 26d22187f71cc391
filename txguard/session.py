"""Session helpers: local sessions for tests/bench, checkpoint-dir discovery."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # long-lived sessions: keep the status store small (scoring plans print
    # 1,253 literal terms per layer)
    "spark.sql.ui.retainedExecutions": "20",
    "spark.ui.retainedJobs": "100",
    "spark.ui.retainedStages": "100",
    "spark.sql.maxPlanStringLength": "200000",
}

#: Bytes of an Arrow batch in steps over whole texts.
ARROW_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "txguard", driver_memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench (the cluster supplies its own)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    b = (b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
          .config("spark.driver.memory", driver_memory))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is configured by the platform and read from the
    session.  Only when it is unset (local tests) do we pick a scratch folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for this cluster")
        d = tempfile.mkdtemp(prefix="txguard-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def small_batches(spark: SparkSession, limit: int = ARROW_BYTES) -> None:
    """Let an Arrow batch to a Python step hold ``limit`` bytes at most (a longer row stands alone).

    Spark's 64 MB are a whole partition of texts, held in the executor's JVM and
    in each of its Python workers, which keep what they once took.  A size that
    the session was given stays.
    """
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(limit))


def ship_package(spark: SparkSession) -> None:
    """Make ``txguard`` importable in Python workers on every executor.

    Python steps (stateful stream function, blocked median, training epochs)
    are pickled by reference to this package; the package is zipped on the
    driver and distributed with ``addPyFile`` once per SparkContext.
    """
    sc = spark.sparkContext
    if getattr(sc, "_txguard_shipped", False):
        return
    import zipfile

    import txguard
    pkg = os.path.dirname(os.path.abspath(txguard.__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="txguard-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._txguard_shipped = True
