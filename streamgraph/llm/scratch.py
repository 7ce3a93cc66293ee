"""Tables cut out of the lineage, in the folder that all executors share.

A table belongs to a run. ``with run(spark)`` makes one: what is kept inside it goes into a folder of its own, and ``close``
deletes that folder and no other. What is kept outside of any run belongs to the process and goes when the JVM ends.
"""

from __future__ import annotations

import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_current: contextvars.ContextVar[Run | None] = contextvars.ContextVar("run", default=None)
_process: dict[str, Run] = {}


def root(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``. Where that is unset, a local master gets a folder of this process; on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="streamgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Run:
    """A folder of tables. ``with`` makes it the one that ``keep`` writes to; leaving the block deletes nothing, since lazy frames may still read it."""

    def __init__(self, spark: SparkSession):
        self.path = f"{root(spark)}/streamgraph-{uuid.uuid4().hex}"
        self._spark, self._token = spark, None
        path, system = self._folder()
        system.deleteOnExit(path)

    def _folder(self):
        path = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration())

    def __enter__(self) -> Run:
        self._token = _current.set(self)
        return self

    def __exit__(self, *error) -> None:
        _current.reset(self._token)

    def close(self) -> None:
        """Delete the folder; call it when no frame reads its tables any more."""
        path, system = self._folder()
        system.delete(path, True)


def run(spark: SparkSession) -> Run:
    return Run(spark)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table of the current run and read it back: lineage is cut, and a lost executor costs one task's reread."""
    spark = df.sparkSession
    owner = _current.get()
    if owner is None:
        app = spark.sparkContext.applicationId
        owner = _process.get(app) or _process.setdefault(app, Run(spark))
    path = f"{owner.path}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
