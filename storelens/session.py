"""Spark session and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Tables written in the open ``shared_scope`` blocks, innermost last; every thread (or task of an event loop) has its own.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("storelens_scopes", default=())

# Session settings the library relies on: AQE (runtime coalescing, skew-join
# splitting, broadcast conversion from measured sizes) and UTC.
LIBRARY_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key's join partition even where the join's output
    # partitioning was reused downstream (e.g. lines joined to orders, then
    # aggregated per order in the same stage): the extra shuffle carries
    # pre-aggregated rows, one task would carry a third of the fact
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # files of a checkpoint go when its DataFrame is no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def scale_conf(input_bytes: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Partition sizing for a run over ``input_bytes`` of parquet (e.g. about 100 TB of order lines).

    Scan splits and post-shuffle partitions target ``partition_bytes``, so a
    task's input fits in executor memory without spilling. The initial shuffle
    partition count follows the input size; AQE then coalesces small
    partitions to the advisory size and splits a skewed partition (a hot
    client, SKU or order) beyond ``4 x partition_bytes`` into map-range slices.
    Auto-broadcast stays at a fixed, small size: only dimension-sized sides
    qualify, whatever the input.
    """
    parts = max(200, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * partition_bytes),
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }


def apply_unset(spark: SparkSession, conf: dict[str, str]) -> dict[str, str]:
    """Set each key the session does not set explicitly (the cluster's own settings win)."""
    explicit = dict(spark.sparkContext.getConf().getAll())
    applied = {k: v for k, v in conf.items() if k not in explicit}
    for k, v in applied.items():
        spark.conf.set(k, v)
    return applied


#: Rows of a table behind one shuffle partition: a line sorted for its join and then summed takes about 650 bytes of a task.
ROWS_PER_PARTITION = 300_000
#: Bytes (compressed, as shuffled) up to which AQE may put partitions together again.
COALESCE_TO = 16 << 20

_SIZES = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def size_bytes(text: str) -> int:
    """Bytes of a size setting such as ``64MB``, ``16k`` or ``1048576b``."""
    t = text.strip().lower()
    digits = t.rstrip("bkmgt")
    unit = t[len(digits) :].strip()[:1] or "b"
    return int(digits) * _SIZES[unit]


def fit_shuffles(spark: SparkSession, rows: int) -> int:
    """Let shuffles of a table of ``rows`` rows go to partitions of ROWS_PER_PARTITION rows at most, whatever its size.

    The sorts and hash tables of a task hold one partition, so with a fixed
    count a task's memory grows with the table. Raises
    ``spark.sql.shuffle.partitions`` where it is lower, and lowers the size up to
    which AQE coalesces, which would undo it; both stay for the session, as the
    frames built on the table are planned only when they are run. A small table changes
    nothing. The planner's own shuffles are kept (no ``repartition`` by the
    key), so AQE still splits the partition of a hot key. Returns the count.
    """
    wanted = -(-rows // ROWS_PER_PARTITION)
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if wanted > 1:
        name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
        if size_bytes(spark.conf.get(name)) > COALESCE_TO:
            spark.conf.set(name, str(COALESCE_TO))
        if wanted > count:
            spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
            return wanted
    return count


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "storelens") -> SparkSession:
    """A local session for tests and the benchmark (the cluster brings its own)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in LIBRARY_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    Reads ``spark.checkpoint.dir`` from the session. Only a local session
    (tests, the bench) without it gets a fresh folder of its own; on a cluster
    a machine-local folder would not survive the loss of an executor, so an
    unset setting is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (lineage is cut by writing there)")
        configured = tempfile.mkdtemp(prefix="storelens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_shared(spark: SparkSession, path: str) -> None:
    """Delete a table written under the shared checkpoint folder (through Hadoop, wherever that is)."""
    base = ensure_checkpoint_dir(spark)
    if not path.startswith(os.path.join(base, "tables") + "/"):
        raise ValueError(f"not a table under {base}: {path}")
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


@contextmanager
def shared_scope(spark: SparkSession):
    """Tables that ``write_shared`` writes inside the block are deleted when it ends."""
    written: list[str] = []
    outer = _SCOPES.get()
    _SCOPES.set((*outer, written))
    try:
        yield written
    finally:
        _SCOPES.set(outer)
        for path in written:
            remove_shared(spark, path)


def write_shared(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    Cuts lineage like a checkpoint, and later scans prune columns and push
    filters into the written files. Size estimates start anew from the files,
    too: a checkpoint carries the estimate of its plan, which for joins is a
    product, so in loops of joins it grows without bound and planning with it. Within a ``shared_scope`` the table goes
    when the block ends; elsewhere the caller removes it (``remove_shared``).
    """
    path = shared_path(df.sparkSession, name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    if _SCOPES.get():
        _SCOPES.get()[-1].append(path)
    w.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
