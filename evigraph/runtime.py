"""What every operator shares: reading tables, cutting lineage and shipping the package to executors."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the project's parquet tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever they run and whatever their folder is; once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_evigraph_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="evigraph-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "evigraph.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(str(target))
    sc._evigraph_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: spark.checkpoint.dir, or a temporary one where it is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        base = getattr(spark.sparkContext, "_evigraph_dir", None)
        if base is None:
            base = spark.sparkContext._evigraph_dir = tempfile.mkdtemp(prefix="evigraph-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base.rstrip("/")


def materialize(df: DataFrame, by: Sequence[str] = (), **metrics: Column) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage is cut and each row is computed once.

    Unlike a cached table the copy outlives the executors that made it. ``metrics`` are aggregates worked out while the rows
    are written, without a job of their own; the result has them in ``metrics``. The files are partitioned by the columns ``by``.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/evigraph/{uuid.uuid4().hex}"
    seen = Observation() if metrics else None
    (df.observe(seen, *(c.alias(n) for n, c in metrics.items())) if seen else df).write.parquet(path, partitionBy=list(by) or None)
    out = spark.read.schema(df.schema).parquet(path)
    out._evigraph_path = path
    out.metrics = seen.get if seen else {}
    atexit.register(_discard_at_exit, out)
    return out


def _discard_at_exit(df: DataFrame) -> None:
    """Written tables go with the driver's process, if its session still lives then."""
    with contextlib.suppress(Exception):
        if df.sparkSession.sparkContext._jsc is not None:
            discard(df)


def discard(df: DataFrame | None) -> None:
    """Remove the files of a materialized table that nothing reads any more."""
    path = getattr(df, "_evigraph_path", None)
    if path is None:
        return
    jvm = df.sparkSession._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def bounded(rows: DataFrame, total: int, most: int, column: str = "h") -> DataFrame:
    """About twice ``most`` of ``total`` rows by a 64-bit hash in ``column``, before they are sorted and cut to ``most``.

    Without it every partition would send ``most`` rows to the driver, which grows with the number of partitions.
    """
    if total <= 2 * most:
        return rows
    return rows.where(F.col(column) < F.lit(int(-(2**63) + 2**64 * (2 * most / total))))
