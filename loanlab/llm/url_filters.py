"""URL filters: host-suffix and path-prefix expressions joined with the rules by hash prefix.

A rule (host, path) fits its host and all subdomains when the URL's path starts with the
rule's path. Every distinct URL is expanded into the (host suffix, path prefix) strings a
rule could have: as many labels and characters as some rule has. An equality join on the
first digits of the strings' SHA-256 finds candidates, the full digests confirm them, and
the longest rule wins (then the longer host, then block before allow).

All of it is DataFrame expressions. URLs are folded before the expansion, so a URL that many
pages share is judged once. The rules are broadcast only when they are few
(``BROADCAST_RULES``); otherwise the same join shuffles.

Defined results: a null URL, or one without ``://``, has empty host and path and no rule; an
empty rule list gives every page the default verdict; repeated rows come out as they came
in; an empty table gives no rows; other columns are ignored unless kept, and a kept column
with the name of a result column gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlab.llm.common import col, kept
from loanlab.session import durable

PREFIX_DIGITS = 8          # hex digits of the digest in the join key
BROADCAST_RULES = 100_000  # rules of at most a few hundred bytes: tens of megabytes
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _expression(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple = ("page_id",),
               default: str = "allow") -> DataFrame:
    """Kept columns, ``host``, ``path``, ``rule`` (host and path of the rule that won, or null), ``verdict``.

    ``rules`` has host, path and verdict ('allow' or 'block'). Rules that are equal but for
    the verdict: block wins. Nulls in rules count as empty and an empty host fits nothing.
    """
    ready = rules.select(
        F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("r_host"),
        F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")).where("r_host <> ''")
    ready = durable(ready.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict")).select(
        "*", F.size(F.split("r_host", r"\.")).alias("labels"), F.length("r_path").alias("chars"),
        F.sha2(_expression(F.col("r_host"), F.col("r_path")), 256).alias("r_digest")).withColumn(
        "key", F.substring("r_digest", 1, PREFIX_DIGITS)))
    n_rules = ready.count()
    # the shapes that occur: at most one per rule, in practice a few dozen
    shapes = ready.select("labels", "chars").distinct()

    address = col(url).cast("string")
    names = kept(keep, ("host", "path", "rule", "verdict"))
    parts = pages.select(*[col(k) for k in names], host_of(address).alias("host"), path_of(address).alias("path"))

    places = parts.select("host", "path").where("host <> ''").distinct()
    # of a host's suffixes those with as many labels as some rule has; of the paths, the prefixes some rule is as long as
    used = sorted(r["labels"] for r in shapes.select("labels").distinct().collect())  # a few small numbers
    n_labels = F.size(F.split("host", r"\."))
    suffixes = places.select("host", "path", F.explode(F.filter(
        F.array(*[F.lit(n) for n in used]).cast("array<int>"), lambda n: n <= n_labels)).alias("labels"))
    by_label = shapes.groupBy("labels").agg(F.collect_set("chars").alias("lengths"))
    if n_rules <= BROADCAST_RULES:  # there are no more shapes than rules
        by_label = F.broadcast(by_label)
    expanded = (suffixes.join(by_label, "labels").select(
        "host", "path", "labels", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("chars"))
        .select("host", "path", F.expr("substring_index(host, '.', -labels)").alias("suffix"),
                F.expr("substring(path, 1, chars)").alias("prefix"))
        .withColumn("digest", F.sha2(_expression(F.col("suffix"), F.col("prefix")), 256))
        .withColumn("key", F.substring("digest", 1, PREFIX_DIGITS)))
    side = F.broadcast(ready) if n_rules <= BROADCAST_RULES else ready
    fits = expanded.join(side, "key").where("digest = r_digest").select(
        "host", "path", F.struct((F.length("r_host") + F.length("r_path")).alias("size"), F.length("r_host").alias("h"),
                                 F.col("r_verdict").alias("verdict"), "r_host", "r_path").alias("fit"))
    won = durable(fits.groupBy("host", "path").agg(F.max("fit").alias("fit")).select(
        "host", "path", F.concat("fit.r_host", "fit.r_path").alias("rule"), F.col("fit.verdict").alias("verdict")))
    return parts.join(won, ["host", "path"], "left").select(
        *[col(k) for k in names], "host", "path", "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"))
