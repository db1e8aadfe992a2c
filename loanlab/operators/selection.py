"""Exact, repeatable row selection by hashed id.

A row's place is the md5 of ``seed:id``, so it depends on nothing but (seed, id): not on
partitioning, retries or row order. To take exactly r rows of a class, only the r-th
smallest hash of that class is needed. It is found by counting hash prefixes (a bounded
table), then looking inside the one prefix that straddles the quota. The selection itself
is a comparison with that constant: a narrow filter, no sort, join or shuffle of the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEYS_ON_DRIVER = 20_000  # most hash keys fetched from one straddling prefix
_END = "g"  # greater than every hex string


def hash_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))


def hash_unit(key: Column, start: int = 1) -> Column:
    """Eight hex digits of a hash as a number in [0, 1)."""
    return F.conv(F.substring(key, start, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)


def _same(stratum, s):
    return F.col(stratum).eqNullSafe(F.lit(s)) if stratum else F.lit(True)


def hash_cutoffs(df: DataFrame, id_col: str, stratum: str | None, seed: int, wanted, digits: int | None = None):
    """Cutoff hashes per stratum.

    ``wanted(counts)`` maps ``{stratum: n}`` to ``{stratum: [rank, ...]}``. The result maps
    each stratum to one key per rank such that exactly ``rank`` rows have a hash <= key.
    Returns ``(counts, cutoffs)``.
    """
    key = hash_key(id_col, seed)
    keyed = df.select((F.col(stratum) if stratum else F.lit(None).cast("string")).alias("s"), key.alias("h"))
    digits = digits or 3

    def prefix_counts(frame, n_digits):
        rows = frame.groupBy("s", F.substring("h", 1, n_digits).alias("p")).agg(F.count("*").alias("n")).collect()
        table = {}
        for r in sorted(rows, key=lambda r: r["p"]):
            table.setdefault(r["s"], []).append((r["p"], r["n"]))
        return table

    table = prefix_counts(keyed, digits)
    counts = {s: sum(n for _, n in t) for s, t in table.items()}
    goals = wanted(counts)
    cutoffs = {s: {} for s in counts}
    # (stratum, wanted rank) -> (prefix that holds it, rank inside the prefix, rows there)
    pending = {}

    def locate(s, rank, left, t):
        for p, n in t:
            if left <= n:
                pending[(s, rank)] = (p, left, n)
                return
            left -= n

    for s, ranks in goals.items():
        for r in ranks:
            if r <= 0:
                cutoffs[s][r] = ""
            elif r >= counts[s]:
                cutoffs[s][r] = _END
            else:
                locate(s, r, r, table[s])

    while pending:
        if digits >= 32:  # the prefix is a whole hash: rows of one repeated id
            for (s, rank), (p, _, _) in pending.items():
                cutoffs[s][rank] = p
            break
        straddling = F.lit(False)
        for (s, _), (p, _, _) in pending.items():
            straddling = straddling | (_same("s" if stratum else None, s) & F.col("h").startswith(p))
        hot = keyed.filter(straddling)
        if sum({(s, p): n for (s, _), (p, _, n) in pending.items()}.values()) <= _KEYS_ON_DRIVER:
            keys = {}
            for row in hot.collect():
                keys.setdefault((row["s"], row["h"][:digits]), []).append(row["h"])
            for (s, rank), (p, left, _) in pending.items():
                cutoffs[s][rank] = sorted(keys[(s, p)])[left - 1]
            break
        digits = min(32, digits + 3)
        table, previous, pending = prefix_counts(hot, digits), pending, {}
        for (s, rank), (p, left, _) in previous.items():
            locate(s, rank, left, [e for e in table[s] if e[0].startswith(p)])
    return counts, {s: [cutoffs[s][r] for r in goals[s]] for s in goals}


def largest_remainder(counts: dict, total: int) -> dict:
    """Share ``total`` draws among classes in proportion to their counts, exactly."""
    n = sum(counts.values())
    if not n:
        return {s: 0 for s in counts}
    exact = {s: total * c / n for s, c in counts.items()}
    out = {s: math.floor(v) for s, v in exact.items()}
    order = sorted(counts, key=lambda s: (-(exact[s] - out[s]), str(s)))
    for s in order[: total - sum(out.values())]:
        out[s] += 1
    return out


def below(id_col: str, stratum: str | None, seed: int, cutoffs: dict, index: int = 0) -> Column:
    """True for the rows whose hash is at or below their stratum's cutoff."""
    key, cond = hash_key(id_col, seed), F.lit(False)
    for s, cuts in cutoffs.items():
        cond = cond | (_same(stratum, s) & (key <= F.lit(cuts[index])))
    return cond
