"""Headlines over a stream of observations (an extension; the batch form is ``derive.headline``).

State per project is the best (confidence, order) seen, and each micro-batch writes it as a
complete snapshot: the maximum is associative, so replays and late rows are harmless.
Recency decays with time, so the confidence is that of the given day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackledger.functions import domain as D
from trackledger.operators.derive import weigh
from trackledger.sources import versions


def best_so_far(observations: DataFrame, today: Column) -> DataFrame:
    """Streaming aggregate ``project_id, computed_phase, computed_confidence``, complete mode."""
    rows = weigh(observations, today).where((F.col("track") == "MAIN") & (F.col("conf") >= D.CREDIBLE) & F.col("phase_ord").isNotNull())
    best = rows.groupBy("project_id").agg(F.max(F.struct("conf", "phase_ord")).alias("m"))
    return best.select("project_id", D.phase_name(F.col("m.phase_ord")).alias("computed_phase"), F.col("m.conf").alias("computed_confidence"))


def windowed_counts(observations: DataFrame, ts: str = "ts", late: str = "2 days", width: str = "7 days") -> DataFrame:
    """Observations per source and week; rows later than ``late`` behind the watermark are dropped."""
    marked = observations.withWatermark(ts, late)
    return marked.groupBy(F.window(ts, width).alias("w"), "source_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("week"), "source_type", "n")


def write_headlines(stream: DataFrame, today: Column, path: str, checkpoint: str):
    """Start a query that keeps the newest headlines at ``path``, a version per micro-batch.

    Readers take ``versions.read``; a batch that is tried again after a failure writes no second version.
    """

    def snapshot(batch: DataFrame, number: int) -> None:
        versions.publish(batch, path, tag=f"batch {number}")

    return best_so_far(stream, today).writeStream.outputMode("complete").foreachBatch(snapshot).option("checkpointLocation", checkpoint).start()
