"""Tables that cut lineage, in the folder all executors share; tables kept for a session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_kept: dict[tuple[str, str], str] = {}
_made: dict[str, set[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; only a local session without it gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lexstrata-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/lexstrata-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def clean(spark: SparkSession) -> int:
    """Deletes the folders that this session made for intermediates, but for those of ``kept`` tables; returns how many were there.

    To be called when no DataFrame made so far is read any more.
    """
    own = _made.get(spark.sparkContext.applicationId, set())
    gone = own - {path.rpartition("/")[0] for path in _kept.values()}
    found = 0
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        found += where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    own -= gone
    return found


def materialize(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: true sizes for the planner, and a lost executor costs no more."""
    path = f"{folder or shared_dir(df.sparkSession)}/{name}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Name, length and time of change of every file below ``path``, as one text."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files, found = system.listFiles(where, True), []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return "\n".join(sorted(found))


def kept(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` gave for this session and the files now below ``source``; made and stored at the first call."""
    key = (f"{spark.sparkContext.applicationId}/{name}", fingerprint(spark, source))
    path = _kept.get(key)
    if path is None or not exists(spark, path):
        path = f"{shared_dir(spark)}/{name}"
        make().write.mode("overwrite").option("compression", "zstd").parquet(path)
        _kept[key] = path
    return spark.read.parquet(path)
