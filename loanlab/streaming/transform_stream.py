"""Apply a fitted preprocessor to a stream of new rows.

The fitted model is a stateless projection, so the streaming form needs no watermark and
no state; rows are written exactly once per micro-batch through the file sink.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from loanlab.functions.scalars import nan_to_null
from loanlab.operators.preprocess import PreprocessModel


def transform_stream(spark: SparkSession, model: PreprocessModel, source: str, schema: T.StructType,
                     sink: str, checkpoint: str):
    """Process the parquet files present in ``source`` and stop. Returns the query handle."""
    rows = nan_to_null(spark.readStream.schema(schema).parquet(source))
    return (model.transform(rows).writeStream.format("parquet").option("path", sink)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
