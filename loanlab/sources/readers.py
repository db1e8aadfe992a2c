"""Scans: CSV and parquet tables, missing-value normalisation, schema check."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlab.fixed_values import NULL_TOKENS
from loanlab.functions.scalars import nan_to_null, rows_from_one
from loanlab.operators import profile
from loanlab.roles import LOAN_ROLES, LOAN_SCHEMA, Roles
from loanlab.session import path_exists

log = logging.getLogger(__name__)

DEFAULT_PATH = "data/loan_applications.csv"


class SchemaError(ValueError):
    """Expected columns are absent."""


@dataclass(frozen=True)
class LoadedTable:
    """A scanned table with its roles, and the profile reports of the overview page."""

    df: DataFrame
    roles: Roles
    path: str
    loaded_at: str

    def summary(self) -> DataFrame:
        return profile.table_summary(self.df, self.roles, self.loaded_at)

    def feature_info(self, exact: bool = True) -> DataFrame:
        return profile.feature_info(self.df, exact)

    def numeric_stats(self) -> DataFrame:
        return profile.describe_numeric(self.df, self.roles.present(self.df, self.roles.numeric))

    def categorical_stats(self) -> DataFrame:
        return profile.value_counts(self.df, self.roles.present(self.df, self.roles.categorical))

    def target_analysis(self) -> DataFrame:
        return profile.target_analysis(self.df, self.roles.target)


def _infer_types(raw: DataFrame) -> T.StructType:
    """Types that every non-missing token of a column casts to: BIGINT, else DOUBLE, else STRING.

    An integer column with missing values becomes DOUBLE, as it does in pandas.
    """
    facts = raw.agg(*[
        F.struct(
            F.count(c).alias("n"),
            F.count(F.when(F.col(c).rlike(r"^\s*[+-]?\d+\s*$"), F.expr(f"try_cast(`{c}` AS BIGINT)"))).alias("ints"),
            F.count(F.expr(f"try_cast(`{c}` AS DOUBLE)")).alias("floats"),
            F.count_if(F.col(c).isNull()).alias("missing"),
        ).alias(c) for c in raw.columns
    ]).first()

    def kind(f):
        if f["n"] and f["ints"] == f["n"] and not f["missing"]:
            return T.LongType()
        return T.DoubleType() if f["floats"] == f["n"] else T.StringType()

    return T.StructType([T.StructField(c, kind(facts[c])) for c in raw.columns])


def _headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """``{header line: files}`` of the files at ``path``; only the first lines are read."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    out: dict[str, list[str]] = {}
    for status in fs.globStatus(at) or []:
        files = fs.listFiles(status.getPath(), True)
        while files.hasNext():
            file = files.next().getPath()
            if file.getName().startswith(("_", ".")):
                continue
            stream, codec = fs.open(file), codecs.getCodec(file)
            lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(
                codec.createInputStream(stream) if codec is not None else stream, "UTF-8"))
            line = lines.readLine()
            lines.close()
            if line is not None:
                out.setdefault(line.lstrip("\ufeff").rstrip("\r"), []).append(file.toString())
    return out


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             multi_line: bool = False) -> DataFrame:
    """CSV with a header. Columns are matched by name, so their order may differ from file to file.

    A column that some files lack is NULL in their rows. Spark's reader knows one
    ``nullValue``; the whole token list is applied here, then the text columns are cast to the
    declared (or inferred) types. Line breaks inside quotes need ``multi_line=True`` (files
    are then not split); without it they end the row.
    """
    reader = spark.read.options(header=True, emptyValue="", quote='"', escape='"', multiLine=multi_line)
    parts = [reader.csv(files) for files in _headers(spark, path).values()]
    raw = parts[0] if parts else reader.csv(path)
    for part in parts[1:]:
        raw = raw.unionByName(part, allowMissingColumns=True)
    raw = raw.select(*[
        F.when(~F.col(f"`{c}`").isin(*NULL_TOKENS), F.col(f"`{c}`")).alias(c) for c in raw.columns
    ])
    if schema is None:
        schema = _infer_types(raw)
    declared = {f.name: f.dataType for f in schema}
    return raw.select(*[F.col(f"`{c}`").cast(declared.get(c, T.StringType())).alias(c) for c in raw.columns])


def validate_schema(df: DataFrame, roles: Roles = LOAN_ROLES, strict: bool = False) -> DataFrame:
    """(column, expected, present) for every expected column; warns, or raises if strict."""
    have = set(df.columns)
    absent = [c for c in roles.expected if c not in have]
    if absent:
        if strict:
            raise SchemaError(f"missing expected columns: {absent}")
        log.warning("missing expected columns: %s", absent)
    return df.sparkSession.createDataFrame(
        [(c, True, c in have) for c in roles.expected], "column string, expected boolean, present boolean")


def validate_values(raw: DataFrame, schema: T.StructType = LOAN_SCHEMA, roles: Roles = LOAN_ROLES) -> DataFrame:
    """(column, expected, present, type, n_values, n_unreadable): do the texts of a scan fit the declared types?

    ``raw`` holds texts as they stand in the files. One aggregate over the rows; columns that are
    declared or found in the files are listed, absent ones without counts.
    """
    kinds, have = {f.name: f.dataType for f in schema}, set(raw.columns)
    names = list(dict.fromkeys([*roles.expected, *kinds, *raw.columns]))

    def readable(c):
        text, kind = F.trim(F.col(f"`{c}`")), kinds.get(c, T.StringType())
        value = text.try_cast(kind)
        if isinstance(kind, T.IntegralType):  # a cast alone would cut off fractions
            value = F.when(text.rlike(r"^[+-]?\d+$"), value)
        return value
    found = [c for c in names if c in have]
    facts = raw.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(found)],
                    *[F.count_if(F.col(f"`{c}`").isNotNull() & readable(c).isNull()).alias(f"b{i}") for i, c in enumerate(found)])
    place = {c: i for i, c in enumerate(found)}
    none = F.lit(None).cast("bigint")
    return rows_from_one(facts, [F.struct(
        F.lit(c).alias("column"), F.lit(c in roles.expected).alias("expected"), F.lit(c in have).alias("present"),
        F.lit(kinds.get(c, T.StringType()).simpleString()).alias("type"),
        (F.col(f"n{place[c]}") if c in have else none).alias("n_values"),
        (F.col(f"b{place[c]}") if c in have else none).alias("n_unreadable")) for c in names])


def load_table(spark: SparkSession, path: str, roles: Roles = LOAN_ROLES,
               schema: T.StructType | None = LOAN_SCHEMA, validate: bool = True) -> LoadedTable:
    """Read a CSV or parquet table; ``FileNotFoundError`` if the path is absent."""
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    is_parquet = path.rstrip("/").endswith((".parquet", ".pq"))
    df = nan_to_null(spark.read.parquet(path) if is_parquet else read_csv(spark, path, schema))
    if validate:
        validate_schema(df, roles)
    return LoadedTable(df, roles, path, datetime.now(timezone.utc).isoformat())


def load_loans(spark: SparkSession, path: str = DEFAULT_PATH) -> DataFrame:
    """The default table with the default roles and schema."""
    return load_table(spark, path).df
