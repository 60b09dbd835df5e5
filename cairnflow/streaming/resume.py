"""Phase 2 as a stream over pair files: the checkpoint takes the place of resume keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.phases import phase2
from ..plans.provider import TextProvider
from ..schema import PAIR


def verified_stream(spark: SparkSession, pairs_dir: str, out_dir: str, checkpoint: str, factory: Callable[[], TextProvider], files_per_trigger: int = 16, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Process new files of pairs_dir once each. A batch is written under its number, so that one repeated after a failure replaces itself."""
    work = transform or (lambda rows: phase2(rows, factory))

    def write(rows: DataFrame, number: int) -> None:
        work(rows).write.mode("overwrite").json(f"{out_dir}/batch={number}")

    source = spark.readStream.schema(PAIR).option("maxFilesPerTrigger", files_per_trigger).json(pairs_dir)
    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
