"""Session helpers.

The library never hard-codes cluster settings.  ``get_session`` is for tests,
benchmarks and the command line; on a cluster the caller's session is used as
is.  The only settings the operators rely on are:

* ``spark.sql.session.timeZone = UTC`` - naive timestamps are UTC instants;
* a shared ``spark.checkpoint.dir`` - iterative operators cut lineage there.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "wattlane") -> SparkSession:
    """The running session, or a new one.

    Without ``master`` the launcher's choice stands (``spark-submit --master``, or
    Spark's own default); tests and benchmarks name one.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):                # driver and tasks share one heap
            builder = builder.config("spark.driver.memory", "16g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins.  When nothing is configured, a session
    on one machine (``local[...]``: unit tests) gets a scratch folder; on a
    cluster, where such a folder would be another one on every machine, it is
    an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote sessions manage the folder server-side
        return spark.conf.get("spark.checkpoint.dir", "") or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        configured = scratch_folder(sc.master)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_folder(master: str) -> str:
    """A folder of this machine for intermediate tables; only for a session that runs on this machine alone."""
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {master!r} share")
    return tempfile.mkdtemp(prefix="wattlane-ckpt-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Survives executor loss (unlike a local checkpoint) and bounds the plan of
    iterative operators.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for an intermediate table."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/wattlane-{name}-{uuid.uuid4().hex}"


def written_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back.

    For loops: a checkpoint keeps the constraints and statistics of its plan,
    which grow with every round built on the last one; a file keeps neither.
    """
    path = scratch_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Fewer rows per Arrow batch for jobs run inside, whose rows are wide; the setting is put back after."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``wattlane`` importable in the Python workers (``addPyFile`` of a zip).

    Operators that run Python in tasks (Ward components, trees, silhouette
    blocks) call this; the zip is built once per application on the driver and
    Spark distributes it to every executor.
    """
    import zipfile

    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote sessions: install the package on the cluster
        return
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import wattlane
    root = os.path.dirname(os.path.abspath(wattlane.__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="wattlane-pyfiles-"), "wattlane.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.join("wattlane", os.path.relpath(full, root)))
    sc.addPyFile(target)
    _SHIPPED.add(app)
