"""Current tables of a stream as sorted runs in levels.

A micro-batch writes only its own part, a small run sorted by key, and a manifest that names the runs which together make up
the table. Every FANOUT runs of one level are merged into a run of the next, so a row is written again once for each level, not
once for each batch. Run and manifest names follow from the batch's number: a batch that runs again replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from probefleet.streaming.batches import start

FANOUT = 8
_MANIFEST = "position INT, level INT, run BIGINT"
Run = tuple[int, int]


@dataclass(frozen=True)
class Levels:
    """A table below folder. merge adds up rows of equal keys; merging parts first and the rest later gives the same rows."""

    folder: str
    keys: tuple[str, ...]
    schema: StructType
    merge: Callable[[DataFrame], DataFrame]
    fanout: int = FANOUT

    def _run(self, run: Run) -> str:
        return f"{self.folder}/runs/level={run[0]}/run={run[1]}"

    def manifest(self, spark: SparkSession, batch_id: int) -> list[Run]:
        """The runs of the table as a batch left it, oldest first; none before the first batch."""
        if batch_id < 0:
            return []
        rows = spark.read.schema(_MANIFEST).json(f"{self.folder}/manifests/batch={batch_id}").orderBy("position").collect()
        return [(r["level"], r["run"]) for r in rows]

    def _read(self, spark: SparkSession, runs: Sequence[Run]) -> DataFrame:
        parts = [spark.read.schema(self.schema).parquet(self._run(r)) for r in runs]
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame, run: Run) -> None:
        rows.select(*self.schema.names).repartition(*self.keys).sortWithinPartitions(*self.keys).write.mode("overwrite").parquet(self._run(run))

    def add(self, part: DataFrame, batch_id: int) -> list[Run]:
        """Add a batch's part to the table as batch batch_id - 1 left it; the runs from then on."""
        spark = part.sparkSession
        runs = [*self.manifest(spark, batch_id - 1), (0, batch_id)]
        self._write(self.merge(part), (0, batch_id))
        # At most fanout runs of a level are in a manifest, and at most one level more for each fanout of the table's size.
        while sum(level == runs[-1][0] for level, _ in runs) >= self.fanout:
            level = runs[-1][0]
            full, runs = [r for r in runs if r[0] == level], [r for r in runs if r[0] != level]
            self._write(self.merge(self._read(spark, full)), (level + 1, batch_id))
            runs.append((level + 1, batch_id))
        entries = spark.createDataFrame([(i, *r) for i, r in enumerate(runs)], _MANIFEST)
        entries.coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifests/batch={batch_id}")
        return runs

    def last(self, spark: SparkSession) -> int:
        """The newest batch of the table."""
        schema = f"{_MANIFEST}, batch BIGINT"
        named = spark.read.schema(schema).option("basePath", f"{self.folder}/manifests").json(f"{self.folder}/manifests/batch=*")
        return named.agg(F.max("batch")).first()[0]

    def current(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The table as a batch left it. Runs that no newer manifest names can be removed."""
        return self.merge(self._read(spark, self.manifest(spark, batch_id)))


def merge_levels(
    stream: DataFrame, table: Levels, checkpoint: str, prepare: Callable[[DataFrame], DataFrame], trigger: dict | None = None
) -> StreamingQuery:
    """Keep a current table of a stream; ``prepare`` turns a micro-batch into its part."""

    def write(batch: DataFrame, batch_id: int) -> None:
        table.add(prepare(batch), batch_id)

    return start(stream, checkpoint, write, "append", trigger)


def sum_levels(folder: str, keys: Sequence[str], key_types: Sequence[str], sums: Mapping[str, str], fanout: int = FANOUT) -> Levels:
    """A table of sums by keys; sums maps columns to types."""
    schema = StructType()
    for name, kind in [*zip(keys, key_types, strict=True), *sums.items()]:
        schema = schema.add(name, kind)

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(*[F.sum(c).cast(t).alias(c) for c, t in sums.items()])

    return Levels(folder, tuple(keys), schema, merge, fanout)
