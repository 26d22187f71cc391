"""Intermediate tables in the shared folder of the session.

A table written here cuts lineage: when an executor is lost, later stages read
the committed files again instead of recomputing the whole chain.  The folder
is the one named by ``spark.checkpoint.dir``, which all executors share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from txguard.session import ensure_checkpoint_dir

#: Shuffle files of a written table go as it is done; otherwise they stay until the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Written tables of one operator run; ``drop`` frees those no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._path: dict[int, tuple[DataFrame, str]] = {}      # with the frame, so that its id stays its own

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self._n}"
        self._n += 1
        conf = self.spark.conf
        before = conf.get(_CLEAN, None)
        conf.set(_CLEAN, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                conf.unset(_CLEAN)
            else:
                conf.set(_CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._path[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this run that no later step reads."""
        for df in tables:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self._path.pop(id(df))[1])
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def own_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name
