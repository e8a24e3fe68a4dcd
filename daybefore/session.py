"""Session helpers. Nothing here is needed when a cluster session already exists."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that deletes the shuffle files of a statement when it ends; older versions ignore it.
FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables that the innermost :func:`scratch` block deletes at its end; None outside of one.
_TABLES: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("tables", default=None)


def local_session(cpus: int | str = 8, app: str = "daybefore") -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster; a private one only where unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="daybefore-ckpt-"))
    return spark.sparkContext.getCheckpointDir()


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go when each write ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(FREES, None)
    spark.conf.set(FREES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREES) if before is None else spark.conf.set(FREES, before)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that :func:`written` makes inside are deleted at the end: nothing that is read later may come from them."""
    tables: list[tuple[SparkSession, str]] = []
    token = _TABLES.set(tables)
    try:
        yield
    finally:
        _TABLES.reset(token)
        for spark, path in tables:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder as Parquet and read again.

    For tables that several parts of a plan read, each some of the columns: they are computed once, pruned
    when read, and there again if an executor is lost.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    if _TABLES.get() is not None:
        _TABLES.get().append((spark, path))
    with freeing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(build: Callable[[], DataFrame]) -> DataFrame:
    """``build()`` written as by :func:`written`; the tables it had written on its way are deleted then."""
    around = _TABLES.get()
    with scratch():
        df = build()
        token = _TABLES.set(around)
        try:
            return written(df)
        finally:
            _TABLES.reset(token)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from there.

    Used only between the steps of driver-side loops (model folds, rating epochs), where
    the plan would otherwise grow with every step and a lost executor would redo them all.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
