"""What the operators of this subpackage share: lineage cuts, size-checked joins, input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut as _cut
from ..lineage import remove, scratch, shared_dir

__all__ = ["bound_batches", "cut", "join_checked", "measured_bytes", "remove", "scratch", "shared_dir", "table"]

#: A side of a join is broadcast only if its measured size is at most this.
BROADCAST_BYTES = 8 << 20
#: Rows and bytes of an Arrow batch. Batches of whole texts at Spark's default of 10,000 rows can outgrow a worker's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES, _BYTES_UNSET = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by BATCH_ROWS and BATCH_BYTES, unless they have been set to something else than the default."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if spark.conf.get(_BYTES) == _BYTES_UNSET:
        spark.conf.set(_BYTES, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Compute df once, into reliable checkpoint files in the shared folder, and go on from these."""
    bound_batches(df.sparkSession)
    return _cut(df)


def measured_bytes(df: DataFrame) -> int:
    """Size of df's rows as text, an upper estimate of what a broadcast holds for narrow rows."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.to_json(F.struct("*")))).alias("b")).first()
    return int(row["b"] or 0) + 32 * int(row["n"])


def join_checked(big: DataFrame, small: DataFrame, on: Column | str | list[str], how: str = "inner") -> DataFrame:
    """Join that broadcasts small, which must be a cut, only if it measures at most BROADCAST_BYTES.

    Otherwise both sides are shuffled, and AQE splits hot keys.
    """
    if measured_bytes(small) <= BROADCAST_BYTES:
        small = F.broadcast(small)
    return big.join(small, on, how)
