"""Score a file stream with a stored preprocessor and a stored model.

Both are read back from storage when the stream starts, so a restarted job needs nothing but
their paths. Scoring is a projection without state. The file sink logs its batches: a batch
that runs again after a failure replaces nothing and adds nothing, and files that were
processed before are known from the checkpoint.

Models that score by a join (nearest neighbours) are refused: each micro-batch would read
all training points.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlab.functions.scalars import nan_to_null
from loanlab.operators.learners import NeighborsModel
from loanlab.operators.preprocess import PreprocessModel
from loanlab.roles import Roles
from loanlab.sources.results_store import load_model


def save_preprocessor(spark: SparkSession, model: PreprocessModel, path: str) -> str:
    """The fitted constants as a parquet table."""
    model.to_frame(spark).coalesce(1).write.mode("overwrite").parquet(path)
    return path


def load_preprocessor(spark: SparkSession, path: str, roles: Roles) -> PreprocessModel:
    return PreprocessModel.from_frame(spark.read.parquet(path), roles)


def scoring_stream(spark: SparkSession, preprocessor: str, model: str, roles: Roles, source: str,
                   schema: T.StructType, sink: str, checkpoint: str, files_per_batch: int = 1000):
    """Score the parquet files that ``source`` has by now and stop. Returns the query handle.

    Writes (id, score, prediction); missing values are filled as in training.
    """
    prepared, scorer = load_preprocessor(spark, preprocessor, roles), load_model(spark, model)
    if isinstance(scorer, NeighborsModel):
        raise ValueError("a model that scores by a join cannot score a stream")
    rows = nan_to_null(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source))
    scored = scorer.score(prepared.transform(rows)).select(F.col(roles.id).alias("id"), "score", "prediction")
    return (scored.writeStream.outputMode("append").format("parquet").option("path", sink)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
