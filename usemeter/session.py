"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_local_root: str | None = None
_scratch: list[tuple[SparkSession, str, int]] = []  # with the thread that stored it


def build_session(app: str = "usemeter", master: str | None = None, **conf: str) -> SparkSession:
    """A session for bench and tests; on a cluster the submitter's settings are used."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        _local_root = _local_root or tempfile.mkdtemp(prefix="usemeter-")
        root = _local_root
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once to the shared folder, for results that several branches need.

    It survives lost executors, cuts the lineage and gives later joins a known size.  It goes when
    the program ends.
    """
    path = scratch_dir(df.sparkSession, purpose)
    _scratch.append((df.sparkSession, path, threading.get_ident()))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def passing() -> Iterator[None]:
    """What this thread stores inside goes at the end: for steps that are repeated for as long as a stream runs."""
    own = threading.get_ident()
    before = {path for _, path, _ in _scratch}
    try:
        yield
    finally:
        for entry in [e for e in _scratch if e[2] == own and e[1] not in before]:
            _delete(*entry[:2])
            _scratch.remove(entry)


@atexit.register
def _delete_stored() -> None:
    for spark, path, _ in _scratch:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended before: nothing is left to ask
            return
