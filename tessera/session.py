"""Session helpers: sane defaults that never override what a cluster sets.

Every setting here is applied only when the session does not already carry a
value, so a cluster's ``spark-defaults.conf`` (shuffle partitions sized for
the data, a shared ``spark.checkpoint.dir``) always wins.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Defaults for a session we build ourselves (tests, bench, local runs).
_LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.driver.memory": "8g",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # delete reliable-checkpoint files once their DataFrame/RDD is unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, app_name: str = "tessera",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Return the active session, or build one with local-friendly defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_LOCAL_DEFAULTS)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; set one only if unset.

    On a cluster the setting names a shared folder (HDFS/S3/ABFS) that
    survives executor loss.  A local scratch folder is created only on a
    local master with nothing configured, which happens in tests; a cluster
    without the setting is an error, since executors do not share a folder of
    the driver's machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def materialize(df):
    """Cut lineage of a small, reused intermediate (e.g. the monthly rollup).

    Reliable ``checkpoint()`` into the session's checkpoint directory: the
    data survives executor loss, and every consumer reads the stored rows
    instead of re-running the scan/join/aggregate beneath them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a training frame to a partition.  The count follows from the data alone,
#: whatever the cluster: tree learners seed their draws by partition, so it is part
#: of the model.  A frame of a few thousand rows is one task of each step.
FIT_ROWS = 50_000
#: Memory (MB) in which tree learners group nodes of a level; it decides which nodes
#: draw their features together, so it is part of the model, not of the machine.
TREE_AGGREGATION_MB = 512


def for_fitting(df, *key: str, partitions: int | None = None):
    """Persist a training frame dealt over a number of partitions that its rows
    give, by its key and sorted by it, so that a seed gives the same model on any
    cluster.  ``df`` is counted, so it should be cheap to read twice."""
    partitions = partitions or -(-max(df.count(), 1) // FIT_ROWS)
    out = df.repartition(partitions, *key).sortWithinPartitions(*key).persist()
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


_SCOPES: list[list] = []


def tracked(df):
    """Register a frame the caller persisted with the active fitting scope."""
    if _SCOPES:
        _SCOPES[-1].append(df)
    return df


def side_by_side(tasks: dict, at_once: int | None = None):
    """Results of some functions of no arguments, run at the same time (``at_once``
    of them, if given; the first ones start first): fits of small frames wait for
    the scheduler, not for the data."""
    from pyspark import inheritable_thread_target

    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max(at_once or len(tasks), 1)) as pool:
        started = {name: pool.submit(inheritable_thread_target(f)) for name, f in tasks.items()}
        return {name: f.result() for name, f in started.items()}


class fitting_scope:
    """Unpersist every frame cached by ``for_fitting`` inside the block.

    Use with ``materialize`` on the (small) result so nothing downstream
    still needs the cached training data::

        with fitting_scope():
            out = materialize(fit_and_evaluate(...))
    """

    def __enter__(self):
        _SCOPES.append([])
        return self

    def __exit__(self, *exc):
        for df in _SCOPES.pop():
            df.unpersist()
        return False
