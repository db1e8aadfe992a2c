"""Exact quantiles (linear interpolation) with bounded state.

``percentile`` keeps one map entry per distinct value and sends every map to one task, so
it is not used. Instead the row of each wanted rank is found by counting: a column's value
range is cut into bins, the rows per bin are counted (partial counts first, so a map task
sends at most the bins), and only the bin that holds the rank is cut again. A range that
holds few rows is finished by counting its distinct values; a range that holds a single
value, however many copies, is finished at once. Each pass reads the column once and
narrows the range by the number of bins, so a handful of passes serve any table. Infinite
values are counted apart and stand at both ends; only finite ranges are cut.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROW_LIMIT = 1_000_000  # most rows of one range whose distinct values are counted directly
BINS = 4_096


@dataclass(frozen=True)
class _Range:
    """A closed value range of one column: rows before it, rows in it."""

    col: str
    lo: float
    hi: float
    below: int
    rows: int


def exact_quantiles(df: DataFrame, cols, probs, row_limit: int = ROW_LIMIT, bins: int = BINS,
                    at_most: int | None = None) -> dict:
    """``{column: [quantile per prob]}``; ``None`` for a column without values.

    ``at_most``: the table is known to have no more rows than this, which saves the pass
    that counts them when the number is within ``row_limit``.
    """
    cols, probs = list(cols), list(probs)
    if not cols:
        return {}
    x = {c: F.col(c).cast("double") for c in cols}
    if at_most is not None and at_most <= row_limit:
        return _in_one_pass(df, x, cols, probs)
    inf = float("inf")
    finite = {c: F.when(F.abs(x[c]) < inf, x[c]) for c in cols}
    facts = df.agg(*[F.struct(F.count(c).alias("n"), F.count_if(x[c] == -inf).alias("low"),
                              F.count(finite[c]).alias("mid"), F.min(finite[c]).alias("lo"),
                              F.max(finite[c]).alias("hi")).alias(c) for c in cols]).first()
    wanted, at = {}, {}
    for c in cols:
        f = facts[c]
        top = f["n"] - 1
        ranks = {min(math.floor(p * top) + step, top) for p in probs for step in (0, 1)} if f["n"] else set()
        at.update({(c, k): -inf if k < f["low"] else inf for k in ranks
                   if not f["low"] <= k < f["low"] + f["mid"]})
        inner = {k for k in ranks if (c, k) not in at}
        if inner:
            wanted[_Range(c, f["lo"], f["hi"], f["low"], f["mid"])] = inner
    at.update(_values_at(df, x, wanted, row_limit, bins))
    return {c: _interpolate(lambda k: at[(c, k)], facts[c]["n"], probs) for c in cols}


def _interpolate(value_at, n: int, probs) -> list:
    out = []
    for p in probs:
        if not n:
            out.append(None)
            continue
        k = math.floor(p * (n - 1))
        a, b = value_at(k), value_at(min(k + 1, n - 1))
        out.append(a if a == b else a + (p * (n - 1) - k) * (b - a))
    return out


def _in_one_pass(df, x, cols, probs) -> dict:
    """Running counts over the distinct values of every column of a small table."""
    ranges = [_Range(c, 0.0, 0.0, 0, 0) for c in cols]
    w = W.partitionBy("r")
    counts = (_cells(df, x, ranges, lambda r, v: {"v": v}).groupBy("r", "v").agg(F.count("*").alias("n"))
              .withColumn("upto", F.sum("n").over(w.orderBy("v").rowsBetween(W.unboundedPreceding, 0)))
              .withColumn("total", F.sum("n").over(w)))
    low = F.transform(F.array(*[F.lit(float(p)) for p in probs]), lambda p: F.floor(p * (F.col("total") - 1)))
    below = F.col("upto") - F.col("n")
    used = F.exists(low, lambda k: ((k >= below) & (k < F.col("upto"))) | ((k + 1 >= below) & (k + 1 < F.col("upto"))))
    hits = {}
    for h in counts.filter(used).select("r", "v", below.alias("below"), "upto", "total").collect():
        hits.setdefault(cols[h["r"]], []).append(h)

    def values(c):
        held = hits.get(c, [])
        return _interpolate(lambda k: next(h["v"] for h in held if h["below"] <= k < h["upto"]),
                            held[0]["total"] if held else 0, probs)

    return {c: values(c) for c in cols}


def _values_at(df, x, wanted, row_limit, bins) -> dict:
    """``{(column, rank): value}`` for ``{range: ranks}``."""
    found = {}
    while wanted:
        small = {}
        for r in list(wanted):
            if r.lo == r.hi:
                found.update({(r.col, k): r.lo for k in wanted.pop(r)})
            elif r.rows <= row_limit:
                small[r] = wanted.pop(r)
        if small:
            found.update(_look_up(df, x, small))
        if wanted:
            wanted = _narrow(df, x, wanted, bins)
    return found


def _scale(v, r: _Range):
    """A monotone position in the range: linear, or logarithmic when it spans magnitudes."""
    if max(abs(r.lo), abs(r.hi)) > 1e6 and (r.lo <= 0 <= r.hi or max(r.lo / r.hi, r.hi / r.lo) > 1e6):
        return F.signum(v) * F.log1p(F.abs(v)), *[math.copysign(math.log1p(abs(e)), e) for e in (r.lo, r.hi)]
    return v, r.lo, r.hi


def _cells(df, x, ranges, extra):
    """One row per (range, value inside it)."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(i).alias("r"), *[e.alias(n) for n, e in extra(r, x[r.col]).items()])
        for i, r in enumerate(ranges)])).alias("cell")
    return df.select(cells).select("cell.*").filter(F.col("v").isNotNull())


def _narrow(df, x, wanted, bins) -> dict:
    """Replace every range by its bins that hold a wanted rank."""
    ranges = list(wanted)

    def place(r, v):
        s, lo, hi = _scale(v, r)
        slot = F.least(F.greatest(F.floor((s - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(0)), F.lit(bins - 1))
        inside = v.between(r.lo, r.hi)
        return {"bin": F.when(inside, slot.cast("int")), "v": F.when(inside, v)}

    counted = (_cells(df, x, ranges, place).groupBy("r", "bin")
               .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect())
    out = {}
    by_range = {}
    for row in sorted(counted, key=lambda row: (row["r"], row["bin"])):
        by_range.setdefault(row["r"], []).append(row)
    for i, r in enumerate(ranges):
        below, left = r.below, sorted(wanted[r])
        for row in by_range[i]:
            held = {k for k in left if k < below + row["n"]}
            if held:
                part = _Range(r.col, row["lo"], row["hi"], below, row["n"])
                if (part.lo, part.hi) == (r.lo, r.hi):
                    raise RuntimeError(f"the search for quantiles of {r.col} does not narrow {r.lo} .. {r.hi}")
                out[part] = held
                left = [k for k in left if k not in held]
            below += row["n"]
    return out


def _look_up(df, x, small) -> dict:
    """Ranks inside ranges of few rows: running counts over their distinct values."""
    ranges = list(small)
    counts = (_cells(df, x, ranges, lambda r, v: {"v": F.when(v.between(r.lo, r.hi), v)})
              .groupBy("r", "v").agg(F.count("*").alias("n")))
    upto = F.sum("n").over(W.partitionBy("r").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    places = [(i, k - r.below) for i, r in enumerate(ranges) for k in sorted(small[r])]
    ask = F.element_at(F.array(*[
        F.array(*[F.lit(k).cast("bigint") for j, k in places if j == i]) for i in range(len(ranges))]), F.col("r") + 1)
    hits = (counts.withColumn("upto", upto)
            .withColumn("ranks", F.filter(ask, lambda k: (k < F.col("upto")) & (k >= F.col("upto") - F.col("n"))))
            .filter(F.size("ranks") > 0).select("r", "v", "ranks").collect())
    return {(ranges[h["r"]].col, ranges[h["r"]].below + k): h["v"] for h in hits for k in h["ranks"]}
