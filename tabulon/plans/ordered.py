"""Windows over a whole ordered table without a single-partition sort.

Rows get dense positions from a range sort and the row counts of its tasks. Positions are cut into
blocks; a window of bounded reach runs inside a block that also holds a halo of the rows before it
(or after it), and a running window is a local one combined with the totals of the blocks before.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a block.
BLOCK = 1 << 18
POS, BLK, HALO = "__pos__", "__blk__", "__halo__"


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder named by spark.checkpoint.dir, which all executors share; unset, a local one where Spark is local."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(folder)
    return f"{folder}/tabulon-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write *df* as Parquet into the shared folder and read it back."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def positions(df: DataFrame, order: list[Column], name: str = POS) -> DataFrame:
    """*df* with dense positions from 0 in the given order. The sorted rows are written once."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    rows = cut(rows.withColumn("__at__", F.monotonically_increasing_id())).withColumn("__part__", F.shiftright("__at__", 33))
    before = Window.orderBy("__part__").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("__part__").agg(F.count(F.lit(1)).alias("__n__")).select("__part__", F.coalesce(F.sum("__n__").over(before), F.lit(0)).alias("__before__"))
    out = rows.join(F.broadcast(parts), "__part__")  # one row for each task of the sort
    return out.withColumn(name, F.col("__before__") + F.col("__at__").bitwiseAND((1 << 33) - 1)).drop("__at__", "__part__", "__before__")


def positioned(source: DataFrame, df: DataFrame, order: list[Column]) -> DataFrame:
    """positions(df, order) for a *df* made from *source*; asked again with the same columns, what was written is taken.

    The memory hangs on the source's own object, so a table read anew is sorted anew.
    """
    known = source.__dict__.setdefault("_tabulon_positions", [])
    for before, by, rows in known:
        if by == repr(order) and before.columns == df.columns and before.sameSemantics(df):
            return rows
    known.append((df, repr(order), positions(df, order)))
    return known[-1][2]


def bounded(df: DataFrame, order: list[Column], back: int, ahead: int, make: Callable[[Window], dict[str, Column]], block: int | None = None) -> DataFrame:
    """Columns computed by windows that reach at most *back* rows before and *ahead* rows after each row.

    ``make(window)`` gets a window ordered by position and returns the new columns.
    """
    size = max(block or BLOCK, back, ahead, 1)
    rows = df if POS in df.columns else positions(df, order)
    blk, at = F.floor(F.col(POS) / size), F.pmod(F.col(POS), F.lit(size))
    homes = [F.struct(blk.alias("b"), F.lit(False).alias("h"))]
    if back:
        homes.append(F.when(at >= size - back, F.struct((blk + 1).alias("b"), F.lit(True).alias("h"))))
    if ahead:
        homes.append(F.when(at < ahead, F.struct((blk - 1).alias("b"), F.lit(True).alias("h"))))
    spread = rows.select("*", F.explode(F.filter(F.array(*homes), lambda x: x.isNotNull())).alias("__home__"))
    spread = spread.withColumn(BLK, F.col("__home__.b")).withColumn(HALO, F.col("__home__.h")).drop("__home__")
    w = Window.partitionBy(BLK).orderBy(POS)
    return spread.withColumns(make(w)).where(~F.col(HALO)).drop(BLK, HALO)


def running(df: DataFrame, order: list[Column], make: Callable[[Window], dict[str, Column]], totals: dict[str, Column], carry: Callable[[str, Window], Column], block: int | None = None) -> DataFrame:
    """Running columns: local ones by ``make(window)`` and, beside them, what the blocks before add up to.

    *totals* are aggregates of a block; ``carry(name, window)`` combines those of the blocks before, as
    a column over the small table of blocks. They arrive as columns named after the totals.
    """
    rows = (df if POS in df.columns else positions(df, order)).withColumn(BLK, F.floor(F.col(POS) / (block or BLOCK)))
    sums = rows.groupBy(BLK).agg(*[c.alias(n) for n, c in totals.items()])
    past = Window.orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(BLK, *[carry(n, past).alias(n) for n in totals])
    local = Window.partitionBy(BLK).orderBy(POS).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(F.broadcast(sums), BLK).withColumns(make(local)).drop(BLK)  # one row for each block
