"""Feature counts by event-time window over a file stream, for drift monitoring.

State is one count per open (window, feature, bin): a few hundred per window whatever the
number of rows. A window is written once, when the watermark (latest event time less
``lateness``) has passed its end; rows that come later than that are dropped. The file sink
logs which batches it holds, so a batch that is run again after a failure is not written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlab.operators.drift import DriftBins, clock_of, instant_of, window_counts


def drift_stream(spark: SparkSession, bins: DriftBins, source: str, schema: T.StructType, sink: str, checkpoint: str,
                 time: str, width: str = "91 days", lateness: str = "1 day"):
    """Process the parquet files that ``source`` has by now and stop. Returns the query handle.

    ``time`` is a clock time without zone. Started again with the same checkpoint it goes on
    with the files that are new and the windows that are open.
    """
    rows = spark.readStream.schema(schema).parquet(source).withColumn("_instant", instant_of(time))
    counts = window_counts(rows.withWatermark("_instant", lateness), bins, "_instant", width)
    return (counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "feature", "bin", "n")
            .writeStream.outputMode("append").format("parquet").option("path", sink)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def closed_windows(spark: SparkSession, sink: str) -> DataFrame:
    """(window_start, window_end, feature, bin, n) of the windows written so far, as clock times."""
    schema = "start timestamp, end timestamp, feature string, bin string, n bigint"
    return spark.read.schema(schema).parquet(sink).select(
        clock_of("start").alias("window_start"), clock_of("`end`").alias("window_end"), "feature", "bin", "n")
