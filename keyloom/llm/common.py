"""Helpers shared by the training-data operators.

Column names inside an operator start with ``_kl_`` where they could clash with extra columns of the caller's table, and
every operator selects the columns it needs first, so extra or clashing columns of the input never reach its own logic.
"""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the cluster's ``spark.checkpoint.dir``.

    Only in local mode, where that is unset (tests, a laptop), a folder under the SQL warehouse is set instead.
    """
    sc = spark.sparkContext
    if (have := sc._jsc.sc().getCheckpointDir()).isDefined():
        return have.get()
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    conf = conf or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    sc.setCheckpointDir(conf)
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, label: str, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, which cuts its lineage and survives lost executors."""
    spark = spark or df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    trim_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def trim_driver(spark: SparkSession) -> None:
    """The driver's JVM gives free native memory back to the system. Plans of many passes come and go on hundreds of threads, and the C
    library keeps what they freed in an arena for every few of them, without end. Where the JVM has no such command, nothing happens."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    types, values = array(jvm.java.lang.Class, len(kinds)), array(jvm.java.lang.Object, len(kinds))
    for i, kind in enumerate(kinds):
        types[i] = jvm.java.lang.Class.forName(kind)
    values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    invoke = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", types)  # the server's own class is closed
    with contextlib.suppress(Py4JJavaError):
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of an action go when it ends, not when the driver collects its garbage: several passes over the corpus
    then need the disk of one. An action that is run again makes its shuffle again.

    Before and after, the driver collects its garbage, as Spark does by itself every half hour (``spark.cleaner.periodicGC.interval``):
    broadcasts and plans of earlier passes go from all machines, and the driver's heap does not start from its fullest. Its free native
    memory goes, too.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")

    def collect() -> None:
        spark.sparkContext._jvm.System.gc()
        trim_driver(spark)

    collect()
    try:
        yield
    finally:
        spark.conf.set(key, before)
        collect()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII strings take the byte-wise fast path of ``lower``."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def workers_find_package(spark: SparkSession) -> SparkSession:
    """Python workers import this package from where the driver did, unless it was shipped to them (``--py-files``)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df``, which has a few narrow columns, marked for broadcast if it has at most ``rows`` rows; joined by shuffle beyond that."""
    return F.broadcast(df) if df.count() <= rows else df
