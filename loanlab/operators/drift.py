"""Drift of features between reference rows and newer rows.

Bins are fitted once on the reference rows: cut points at exact quantiles for numbers, the
values themselves for texts, one more bin for missing values. Counting is a narrow projection
and one grouped count, so rows are never shuffled, only (feature, bin) counts. The population
stability index compares two such counts; bins that one side lacks count with ``FLOOR`` as share.

Defined results: NaN counts as missing; a feature without any reference value has the bins
``missing`` and ``0``; an empty side gives no rows for the groups it lacks; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlab.functions.quantiles import exact_quantiles
from loanlab.functions.scalars import nan_to_null
from loanlab.roles import Roles

FLOOR = 1e-4          # share of a bin that one side lacks
STABLE, MOVED = 0.1, 0.25  # usual limits of the index


@dataclass(frozen=True)
class DriftBins:
    """Inner cut points by number column, and the text columns. A value on a cut is in the upper bin."""

    cuts: dict[str, tuple[float, ...]]
    texts: tuple[str, ...]

    def cells(self) -> Column:
        """An array of (feature, bin) with one entry per feature."""
        out = []
        for c, cuts in self.cuts.items():
            x = F.col(c).cast("double")
            place = reduce(lambda a, b: a + b, [(x >= cut).cast("int") for cut in cuts], F.lit(0))
            out.append((c, F.when(x.isNull() | F.isnan(x), "missing").otherwise(place.cast("string"))))
        out += [(c, F.coalesce(F.col(c).cast("string"), F.lit("missing"))) for c in self.texts]
        return F.array(*[F.struct(F.lit(c).alias("feature"), b.alias("bin")) for c, b in out])

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(c, i, v) for c, cuts in self.cuts.items() for i, v in enumerate(cuts)]
        rows += [(c, None, None) for c in (*self.texts, *[c for c, cuts in self.cuts.items() if not cuts])]
        return spark.createDataFrame([(f, f in self.texts, p, v) for f, p, v in rows],
                                     "feature string, is_text boolean, position int, cut double")

    @staticmethod
    def from_frame(table: DataFrame) -> "DriftBins":
        cuts, texts = {}, []
        for r in sorted(table.collect(), key=lambda r: (r["feature"], r["position"] or 0)):  # features x bins
            if r["is_text"]:
                texts.append(r["feature"])
            else:
                cuts.setdefault(r["feature"], []).extend([] if r["cut"] is None else [r["cut"]])
        return DriftBins({c: tuple(v) for c, v in cuts.items()}, tuple(texts))


def fit_bins(reference: DataFrame, roles: Roles, bins: int = 10) -> DriftBins:
    """Equal-frequency bins; cut points that coincide are merged."""
    if bins < 2:
        raise ValueError("two bins or more are needed")
    numbers = roles.present(reference, roles.numeric)
    found = exact_quantiles(nan_to_null(reference), numbers, [i / bins for i in range(1, bins)])
    return DriftBins({c: tuple(sorted({q for q in found[c] if q is not None})) for c in numbers},
                     tuple(roles.present(reference, roles.categorical)))


def bin_counts(rows: DataFrame, bins: DriftBins, by=()) -> DataFrame:
    """(by..., feature, bin, n)."""
    cells = rows.select(*by, F.explode(bins.cells()).alias("cell"))
    return cells.groupBy(*by, "cell.feature", "cell.bin").agg(F.count(F.lit(1)).alias("n"))


def stability_index(reference: DataFrame, counts: DataFrame, by=()) -> DataFrame:
    """(by..., feature, n, psi, state) of every group of ``counts`` against the reference counts."""
    by = list(by)
    total = counts.groupBy(*by, "feature").agg(F.sum("n").alias("n_new"))
    base = reference.groupBy("feature").agg(F.sum("n").alias("n_old"))
    # every group meets every reference bin, whether it has rows there or not
    old = total.select(*by, "feature").join(reference.withColumnsRenamed({"n": "old"}), "feature")
    both = old.withColumn("new", F.lit(0).cast("bigint")).unionByName(
        counts.select(*by, "feature", "bin", F.lit(0).cast("bigint").alias("old"), F.col("n").alias("new")))
    cells = both.groupBy(*by, "feature", "bin").agg(F.sum("old").alias("old"), F.sum("new").alias("new"))
    cells = cells.join(total, [*by, "feature"]).join(base, "feature")
    p = F.greatest(F.col("old") / F.col("n_old"), F.lit(FLOOR))
    q = F.greatest(F.col("new") / F.col("n_new"), F.lit(FLOOR))
    index = cells.groupBy(*by, "feature").agg(F.first("n_new").alias("n"), F.sum((q - p) * F.log(q / p)).alias("psi"))
    state = F.when(F.col("psi") < STABLE, "stable").when(F.col("psi") < MOVED, "moved").otherwise("drifted")
    return index.withColumn("state", state)


# ---------------------------------------------------------------- time windows

def instant_of(clock: str) -> Column:
    """A clock time without zone as an instant that reads the same in UTC, whatever the session's zone."""
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{clock}`)"))


def clock_of(instant: str) -> Column:
    return F.expr(f"timestampadd(MICROSECOND, unix_micros({instant}), TIMESTAMP_NTZ'1970-01-01 00:00:00')")


def window_counts(rows: DataFrame, bins: DriftBins, time: str, width: str) -> DataFrame:
    """(window, feature, bin, n) over tumbling windows of the instant ``time``; rows without a time go.

    The same plan serves a table and a stream; on a stream ``time`` must carry a watermark.
    """
    cells = rows.where(F.col(time).isNotNull()).select(time, F.explode(bins.cells()).alias("cell"))
    return cells.groupBy(F.window(time, width).alias("window"), F.col("cell.feature").alias("feature"),
                         F.col("cell.bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
