"""An incremental report over a stream of findings; an extension, the batch report doesn't need it.

Every micro-batch is deduplicated against the fingerprints reported so far, which are kept as a table under the checkpoint folder, so a
restart reports nothing twice: a batch writes its rows under its own number, and one that is repeated overwrites them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import report


def new_findings(stream: DataFrame, ignores: DataFrame, baseline: DataFrame, state: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts the query. stream has the columns of findings; what is new lands in state/batch=<n>, by fingerprint. Ordinals count siblings
    within a batch."""
    spark = stream.sparkSession

    def step(batch: DataFrame, n: int) -> None:
        flagged = report.flagged_report(batch, ignores, baseline)
        try:
            before = spark.read.parquet(state).where(F.col("batch") < n).select("fingerprint")
            flagged = flagged.join(before, "fingerprint", "left_anti")
        except AnalysisException:
            pass  # nothing was reported yet
        flagged.write.mode("overwrite").parquet(f"{state}/batch={n}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(stream: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """tag, window, n: findings by time of arrival; rows later than `late` are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), "tag").agg(F.count(F.lit(1)).alias("n")).select("tag", F.col("window.start").alias("start"), "n")
