"""Progress of running streams as rows on shared storage."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from mirrorkit.schemas import columns

PROGRESS = columns("query string, batch_id long, heartbeat string, n_rows long, metrics string")


def observed(df: DataFrame, phase: str, **metrics: Column) -> DataFrame:
    """Attach counters that Spark reports while the rows stream by, at no extra pass."""
    named = {"n_rows": F.count(F.lit(1)), **metrics}
    return df.observe(phase, *[c.alias(name) for name, c in named.items()])


class ProgressLog(StreamingQueryListener):
    """Appends every progress report to a folder; each report is a heartbeat of its stream."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        metrics = {phase: row.asDict() for phase, row in p.observedMetrics.items()}
        values = (p.name or str(p.id), p.batchId, p.timestamp, p.numInputRows, json.dumps(metrics, default=str))
        row = self._spark.range(1).select(*[
            F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(values, PROGRESS.fields, strict=True)
        ])
        row.coalesce(1).write.mode("append").parquet(self.path)

    def onQueryTerminated(self, event) -> None:
        pass

    def rows(self) -> DataFrame:
        return read_progress(self._spark, self.path)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """All reports written so far; a folder without any gives no rows."""
    try:
        return spark.read.schema(PROGRESS).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PROGRESS)
