"""Session defaults and the shared scratch location.

Scratch output (written tables used to cut lineage, files produced by the
source operators) always lives under the folder the cluster names in
``spark.checkpoint.dir``.  Only when that setting is absent in a local
session (tests) do we pick a folder of our own and register it; on a
cluster an absent setting is an error, never a driver-local folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, app: str = "supplylens",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build or fetch a session with the library's defaults.

    On a cluster ``master`` stays None so the launcher decides; tests pass
    ``local[*]``.  Shuffle partitions default to Spark's own value unless
    given; AQE coalesces small partitions at runtime either way.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder; set a private one only when unset.

    Works with classic sessions (the SparkContext's checkpoint dir) and with
    Spark Connect sessions, which expose only the ``spark.checkpoint.dir``
    setting.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext on the client
        sc = None
    if sc is not None:
        d = sc.getCheckpointDir()
        if d:
            return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.conf.get("spark.master", "") or ""
        if not master.startswith("local"):
            # a driver-local folder is invisible to executors on a cluster
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        d = tempfile.mkdtemp(prefix="supplylens-ckpt-")
        if sc is None:
            spark.conf.set("spark.checkpoint.dir", d)
    if sc is not None:
        sc.setCheckpointDir(d)
        return sc.getCheckpointDir() or d
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder path under the shared checkpoint root."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/supplylens/{name}-{uuid.uuid4().hex[:12]}"


def drop_scratch(spark: SparkSession, path: str) -> bool:
    """Delete one folder made by :func:`scratch_path`, and nothing else.

    Call it only when no DataFrame still reads from the folder.  Paths
    outside this application's scratch root are refused.
    """
    root = checkpoint_root(spark).rstrip("/") + "/supplylens/"
    if not path.startswith(root) or "/../" in path:
        raise ValueError(f"not a supplylens scratch folder: {path}")
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.delete(jpath, True))
