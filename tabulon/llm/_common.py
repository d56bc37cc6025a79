"""What the operators of this subpackage share: tables, checkpoints, shipped code."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]

BATCH_ROWS = 1_000
#: A word: a run without the six ASCII white-space characters.
WORD = r"[^ \t-\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read ``<sf_dir>/<name>.parquet`` and see to it that Python workers can import this package.

    Arrow batches are set to BATCH_ROWS rows: texts may be long, and a worker holds several copies of a batch.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send the package to the executors unless they find it on PYTHONPATH or in the working folder."""
    sc = spark.sparkContext
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if any(Path(p).resolve() == ROOT for p in [*paths, os.getcwd()]) or getattr(sc, "_tabulon_shipped", False):
        return
    import zipfile

    archive = Path(tempfile.mkdtemp(prefix="tabulon-")) / "tabulon.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((ROOT / "tabulon").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(archive))
    sc._tabulon_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; unset, a local one where Spark is local (tests), else an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write *df* once as Parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation, and each further
    consumer reads only the columns it needs.
    """
    path = f"{shared_folder(df.sparkSession)}/tabulon-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hex64(c) -> "F.Column":
    """A long as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def whole(docs: DataFrame) -> "F.Column":
    """All columns of a row as a struct, whatever their names: beside it an operator's own columns clash with none."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`").alias(c) for c in docs.columns])


def row_key(docs: DataFrame) -> "F.Column":
    """A hash of a row's whole content: equal rows, which nothing tells apart, share one, others don't."""
    return F.unhex(F.sha2(F.to_json(whole(docs)), 256))


def source_order(df: DataFrame, keys: list[str], name: str = "position") -> DataFrame:
    """Dense positions from 0 in the order of *keys*, without a single-partition window.

    A range sort is written out, the rows of each part file range are counted, and only these counts
    (one per task) are summed up in order.
    """
    rows = df.repartitionByRange(*[F.asc_nulls_last(k) for k in keys]).sortWithinPartitions(*[F.asc_nulls_last(k) for k in keys])
    rows = cut(rows.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    from pyspark.sql import Window

    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = parts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return (
        rows.join(F.broadcast(before), "_part")  # a row per task of the sort
        .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1))
        .drop("_at", "_part", "_before")
    )
