"""Typed readers of the five business tables.

A contract is the table's schema: names, types, and which columns must hold a value.  A reader
checks the files against it once, in the scan stage: columns that are absent fail at once, by name;
values that are not of their column's type, and missing values where one is needed, reject their
row.  ``Checked.rows`` has exactly the contract's columns and types, ``Checked.rejected`` the raw
values of the others with their problems, ``Checked.report()`` the number of rows per problem.
Nothing is collected and no row is lost: every row of the files is in one of the two.

Receipts may be kept by calendar period (:func:`write_cheques`, :func:`read_cheques`): a period
filter then reads only the folders of its months or days.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmenta.operators.filters import _as_date, apply_filters, date_range_predicate
from segmenta.sources.tables import require_columns


def _contract(*columns: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*column) for column in columns])


_TIME = T.TimestampNTZType()
CONTRACTS: dict[str, T.StructType] = {
    "bonuscheques": _contract(
        ("card", T.StringType(), False), ("doc_id", T.LongType(), False), ("shop", T.StringType(), False),
        ("datetime", _TIME, False), ("summ_with_disc", T.DecimalType(18, 4), True),
    ),
    "shops": _contract(("name", T.StringType(), False)),
    "users": _contract(("id", T.LongType(), True), ("date_joined", _TIME, True)),
    "userentry": _contract(("user_id", T.LongType(), False), ("entry_at", _TIME, False)),
    "stat": _contract(
        ("uid", T.LongType(), True), ("event", T.StringType(), False),
        ("created_at", _TIME, False), ("url_params", T.StringType(), True),
    ),
}


@dataclass(frozen=True)
class Checked:
    """Rows that keep a contract, and those that do not."""

    rows: DataFrame
    rejected: DataFrame

    def report(self) -> DataFrame:
        """problem, rows — how many rows have each problem (a row may have several)."""
        problems = self.rejected.select(F.explode("problems").alias("problem"))
        return problems.groupBy("problem").agg(F.count(F.lit(1)).alias("rows"))


def _exact(raw: Column, made: Column, have: T.DataType, want: T.DataType) -> Column:
    """Whether a value kept its meaning: a number must not lose digits."""
    if isinstance(want, T.DecimalType) and isinstance(have, T.DecimalType):
        return made.cast(have).eqNullSafe(raw)
    if isinstance(want, T.IntegralType) and isinstance(have, (T.FractionalType, T.DecimalType)):
        return made.cast(have).eqNullSafe(raw)
    return F.lit(True)


def check(raw: DataFrame, table: str, *, keep: tuple[str, ...] = ()) -> Checked:
    """``raw`` held against the contract of ``table``; ``keep`` names further columns to pass on."""
    contract = CONTRACTS[table]
    require_columns(raw, [*contract.names, *keep], table)
    typed, problems = [], []
    for field in contract:
        have = raw.schema[field.name].dataType
        value = F.col(field.name)
        made = value if have == field.dataType else value.try_cast(field.dataType)
        typed.append(made.alias(field.name))
        wrong = value.isNotNull() & (made.isNull() | ~_exact(value, made, have, field.dataType))
        problems.append(F.when(wrong, F.lit(f"{field.name}: not a {field.dataType.simpleString()}")))
        if not field.nullable:
            problems.append(F.when(value.isNull(), F.lit(f"{field.name}: missing")))
    found = F.filter(F.array(*problems), lambda p: p.isNotNull())
    judged = raw.withColumn("_problems", found)
    good = judged.where(F.size("_problems") == 0).select(*typed, *keep)
    bad = judged.where(F.size("_problems") > 0)
    raws = [F.col(c) for c in raw.columns]
    return Checked(good, bad.select(*raws, F.col("_problems").alias("problems")))


def read(spark: SparkSession, table: str, path: str, *, format: str = "parquet", **options) -> Checked:
    """The files of one business table.  Formats without types (CSV, JSON) are read as text and
    converted here, so a bad value rejects its row instead of the file."""
    reader = spark.read.format(format).options(**options)
    if format in ("csv", "json"):
        text = T.StructType([T.StructField(c, T.StringType(), True) for c in CONTRACTS[table].names])
        if format == "csv":
            reader = reader.option("header", options.get("header", True)).option("enforceSchema", False)
        raw = reader.schema(text).load(path)
        if format == "csv":
            _require_header(spark, table, path, options)
    else:
        raw = reader.load(path)
    return check(raw, table)


def _require_header(spark: SparkSession, table: str, path: str, options: dict) -> None:
    if str(options.get("header", True)).lower() == "true":
        named = spark.read.options(**{**options, "header": True}).csv(path)
        require_columns(named, CONTRACTS[table].names, table)


# --- receipts by calendar period ------------------------------------------------------------

#: Folder name and the day or month a time belongs to, as text that sorts by time.
GRAINS = {"day": "yyyy-MM-dd", "month": "yyyy-MM"}


def write_cheques(cheques: DataFrame, path: str, *, grain: str = "day") -> None:
    """Keep receipt lines in one folder per day or month.  Only the periods present in ``cheques``
    are replaced, each as a whole, so writing the same period again changes nothing else.  The
    period's rows are spread over as many files as their size asks for."""
    period = F.date_format("datetime", GRAINS[grain])
    rows = cheques.withColumn(grain, F.coalesce(period, F.lit("none")))
    rows.hint("rebalance", F.col(grain)).write.partitionBy(grain).option("partitionOverwriteMode", "dynamic").mode(
        "overwrite"
    ).parquet(path)


def read_cheques(spark: SparkSession, path: str, *, grain: str = "day", date_range=None) -> Checked:
    """Receipt lines of a period (inclusive dates; either end may be open).  The folders outside
    it are not read."""
    contract = CONTRACTS["bonuscheques"]
    stored = T.StructType([*contract.fields, T.StructField(grain, T.StringType(), True)])
    raw = spark.read.schema(stored).parquet(path)
    if date_range is not None:
        width = len(GRAINS[grain])
        start, end = (_as_date(v) for v in date_range)
        bounds = [F.col(grain) >= start.isoformat()[:width]] if start else []
        bounds += [F.col(grain) <= end.isoformat()[:width]] if end else []
        # The folders of rows without a time sort last and belong to no period.
        raw = raw.where(reduce(lambda a, b: a & b, bounds, F.col(grain) != "none"))
        raw = apply_filters(raw, date_range_predicate("datetime", date_range))
    return check(raw.drop(grain), "bonuscheques")
