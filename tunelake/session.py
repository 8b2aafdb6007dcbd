"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that every job here relies on.  AQE re-plans joins and coalesces
# small shuffle partitions at run time; skew-join splits oversized partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tunelake", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings above.

    On a cluster ``master`` is left to spark-submit; tests pass ``local[*]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    apply_runtime_conf(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; we use it as is.  Only when the
    setting is absent (local tests) do we create a private folder.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not is_single_process(sc):
            raise RuntimeError("spark.checkpoint.dir is not set: name a shared folder (HDFS/S3/...) "
                               "that every executor can reach")
        # Single-machine session (tests, local runs): a private folder is shared by construction.
        configured = tempfile.mkdtemp(prefix="tunelake-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


_FOLDERS: dict[str, SparkSession] = {}


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder, deleted when the driver exits."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _FOLDERS[path] = spark
    return path


@atexit.register
def _delete_folders() -> None:
    for path, spark in list(_FOLDERS.items()):
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone: the cluster's folder policy applies
            return


def cut_lineage(df):
    """Reliable, eager checkpoint into the shared checkpoint folder.

    Used where a result is consumed twice and must be identical both times
    (e.g. positions derived from a sort), and to survive executor loss.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Arrow batches feed the few Python steps (LCS over whole documents, user
# models): 1024 rows of 20,000-word texts stay within a worker's memory, where
# the default 10,000 would not.
ARROW_MAX_RECORDS = 1024


def apply_runtime_conf(spark: SparkSession) -> None:
    """Lower (never raise) the Arrow batch size of the session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    try:
        current = int(spark.conf.get(key, "10000"))
    except ValueError:
        current = 10000
    if current <= 0 or current > ARROW_MAX_RECORDS:
        spark.conf.set(key, str(ARROW_MAX_RECORDS))


_SHIPPED: set = set()


def is_single_process(sc) -> bool:
    """True for ``local`` and ``local[...]``: driver and workers share this machine's files."""
    return sc.master == "local" or sc.master.startswith("local[")


def ship_package(spark: SparkSession) -> None:
    """Make ``tunelake`` importable in every Python worker (Arrow UDFs,
    mapInPandas) wherever the driver was started.

    On a cluster this does what ``--py-files`` would: zip the package once and
    add it to the SparkContext.  In a single-process session the workers get
    the package's folder on their path, which costs nothing per task."""
    import zipfile
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    if is_single_process(sc):
        known = sc.environment.get("PYTHONPATH", "")
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
        _SHIPPED.add(key)
        return
    zpath = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="tunelake-pyfiles-")), "tunelake.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)
