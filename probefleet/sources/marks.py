"""Marks of progress: how far each streaming query has read its sources, as a table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

MARK = (
    "query STRING, batch_id BIGINT, source INT, partition STRING, start BIGINT, stop BIGINT, "
    "input_rows BIGINT, late_rows BIGINT, watermark STRING"
)


def offsets(text: str | None) -> dict[str, int]:
    """The offsets in a source's mark: by topic and partition, or one for a source without partitions."""
    found = json.loads(text) if text and text not in ("null", "None") else {}
    if isinstance(found, int):
        return {"": found}
    out: dict[str, int] = {}
    for name, value in found.items():
        if isinstance(value, dict):
            out |= {f"{name}-{partition}": int(at) for partition, at in value.items()}
        else:
            out[""] = int(value)
    return out


class ProgressMarks(StreamingQueryListener):
    """Writes a row for each source and partition of each batch with rows, with the state's rows later than the watermark.

    A batch has its own folder, so that one which is reported again replaces its marks.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        rows = []
        for number, source in enumerate(p.sources):
            start, stop = offsets(source.startOffset), offsets(source.endOffset)
            rows += [
                (str(p.id), p.batchId, number, partition, start.get(partition), at, source.numInputRows, late, p.eventTime.get("watermark"))
                for partition, at in stop.items()
                if start.get(partition) != at
            ]
        if rows:
            path = f"{self._folder}/query={p.id}/batch={p.batchId}"
            self._spark.createDataFrame(rows, MARK).coalesce(1).write.mode("overwrite").parquet(path)


def read_marks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MARK).parquet(f"{folder}/query=*/batch=*")


def gaps(marks: DataFrame) -> DataFrame:
    """Marks that do not begin where the mark before them ended: something was left out or read twice."""
    before = F.lag("stop").over(W.partitionBy("query", "source", "partition").orderBy("batch_id"))
    return marks.withColumn("before", before).where(F.col("before").isNotNull() & ~F.col("start").eqNullSafe(F.col("before")))


def committed(marks: DataFrame) -> DataFrame:
    """Where each query goes on after a restart: (query, source, partition, stop)."""
    return marks.groupBy("query", "source", "partition").agg(F.max_by("stop", "batch_id").alias("stop"))
