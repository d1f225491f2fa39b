"""Session helpers shared by the library, the queries and the tests."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
#: Rows and bytes that go to a Python worker at once, where the session names
#: none: texts and pages are long, and a worker holds a batch several times over.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
_MADE: list[str] = []


def ship(spark: SparkSession) -> None:
    """Give this package's code to the executors, once for each application,
    so that Python functions run there however the driver was started; and bound
    the batches that they get. What the session has set stays."""
    for name, bound in BATCH.items():
        if not spark.conf.get(name, None):
            spark.conf.set(name, bound)
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / f"{here.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the input tables; only Spark opens the path."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in
    spark.checkpoint.dir. Where that is unset, a local session (one machine, as
    in tests) gets a folder of its own; on a cluster it has to be named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="almanac-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage is cut,
    and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many tables materialize has written so far, for forget."""
    return len(_MADE)


def forget(spark: SparkSession, since: int, most: int) -> None:
    """Delete the written tables numbered since to most - 1: those of a job
    whose result is written too."""
    for path in _MADE[since:most]:
        remove(spark, path)
    _MADE[since:most] = []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Each name, made longer until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def sized(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """df, marked for broadcast only if it has at most most_rows rows; beyond
    that Spark shuffles. df should be narrow and cheap to read twice."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
