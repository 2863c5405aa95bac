"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Tables by the frame that reads them, and the sessions that wrote them.
_TABLE: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_WRITTEN: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, a temporary one serves a session that has no other
    machine (tests); on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if master not in _LOCAL:
            _LOCAL[master] = "file://" + tempfile.mkdtemp(prefix="clarispan-")
        folder = _LOCAL[master]
    return folder.rstrip("/")


def materialise(df: DataFrame, tag: str, replaces: DataFrame | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, survives lost executors. The table of
    `replaces`, an earlier one that nothing else reads, goes. All others go with `release`, or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _TABLE[out] = path
    _WRITTEN[path] = spark
    if replaces is not None and replaces in _TABLE:
        _delete(_TABLE.pop(replaces))
    return out


def _delete(path: str) -> None:
    spark = _WRITTEN.pop(path)
    old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


def tables(spark: SparkSession) -> set[str]:
    """Paths of this session's tables in the shared folder that still exist."""
    return {path for path, owner in _WRITTEN.items() if owner is spark}


def release(spark: SparkSession, paths: set[str], keep: DataFrame | None = None) -> None:
    """Deletes tables that no result still to be read needs, but for that of `keep`."""
    kept = _TABLE.get(keep) if keep is not None else None
    for path in paths & tables(spark) - {kept}:
        _delete(path)


@atexit.register
def _release_all() -> None:
    for path in list(_WRITTEN):
        with contextlib.suppress(Exception):  # the session may have ended
            if _WRITTEN[path].sparkContext._jsc is not None:
                _delete(path)
