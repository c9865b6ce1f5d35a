"""Readers for the driver's Parquet tables and the views that map them onto
the five business tables the operators expect.

Business tables (schemas in FIXTURES.md):

* ``bonuscheques`` — loyalty-card receipt lines: card, doc_id, shop, datetime,
  summ_with_disc
* ``shops``        — name
* ``users``        — id, date_joined
* ``userentry``    — user_id, entry_at
* ``stat``         — uid, event, created_at, url_params, and the log's own event_id

On a real deployment these are tables of their own (``spark.table`` or
``spark.read.parquet``); here they are derived from the TPC-H-style test data
with the same view definitions the DuckDB oracle inlines, so both engines see
equal rows.  Every view is a lazy DataFrame: column pruning and filters from
the operators reach the Parquet scans.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_SCHEMAS: dict[tuple, object] = {}


def _local_version(path: str) -> int | None:
    try:
        return os.stat(path).st_mtime_ns
    except OSError:  # not a local path
        return None


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, e.g. ``read_table(spark, '/root/testdata/sf0.01', 'orders')``.

    The Parquet schema of a local file is inferred once per file version and then
    passed explicitly, so repeated reads skip the footer-inference job.  In a
    store whose file versions are not known, it is inferred at every read.
    """
    path = os.path.join(sf_dir, f"{name}.parquet")
    version = _local_version(path)
    if version is None:
        return spark.read.parquet(path)
    schema = _SCHEMAS.get((path, version))
    if schema is None:
        schema = _SCHEMAS[path, version] = spark.read.parquet(path).schema
    return spark.read.schema(schema).parquet(path)


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "input") -> DataFrame:
    """Fail early, with the missing names, when a table lacks a used column."""
    present = set(df.columns)
    missing = [c for c in columns if c not in present]
    if missing:
        raise ValueError(f"{what} is missing columns {missing}; has {sorted(present)}")
    return df


# ---------------------------------------------------------------------------
# Fixture mapping views (same definitions as the oracle CTEs).
# ---------------------------------------------------------------------------


def shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four of the five order priorities act as shop names, so the join filters."""
    orders = read_table(spark, sf_dir, "orders")
    return (
        orders.select(F.col("o_orderpriority").alias("name"))
        .where(F.col("name") != "4-NOT SPECIFIED")
        .distinct()
    )


#: Receipt lines that one task sorts to join them with their orders.
JOIN_ROWS = 1_200_000


def bonuscheques(spark: SparkSession, sf_dir: str, join_rows: int = JOIN_ROWS) -> DataFrame:
    """Receipt lines: several lines per doc_id, several shops per client and
    one card prefix ('100', MACHINERY customers) that the card filter rejects.

    The clients meet the orders, not their lines.  Tables of more than eight tasks'
    lines are dealt to as many tasks as they have ``join_rows`` lines (counted in the
    files' footers), so that a task's memory does not grow with the tables."""
    orders = read_table(spark, sf_dir, "orders")
    lineitem = read_table(spark, sf_dir, "lineitem")
    customer = read_table(spark, sf_dir, "customer")
    prefix = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("100")).otherwise(F.lit("200"))
    amount = F.col("l_extendedprice").cast("decimal(12,2)") * (
        F.lit(1) - F.col("l_discount").cast("decimal(4,2)")
    )
    owned = orders.join(customer, F.col("c_custkey") == F.col("o_custkey"))
    tasks = -(-lineitem.count() // join_rows)
    if tasks > 8:
        owned, lineitem = owned.repartition(tasks, "o_orderkey"), lineitem.repartition(tasks, "l_orderkey")
    return (
        owned.join(lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.concat(prefix, F.lpad(F.col("c_custkey").cast("string"), 10, "0")).alias("card"),
            F.col("o_orderkey").alias("doc_id"),
            F.col("o_orderpriority").alias("shop"),
            F.col("o_orderdate").alias("datetime"),
            amount.alias("summ_with_disc"),
        )
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrations: one per order, every tenth id NULL."""
    orders = read_table(spark, sf_dir, "orders")
    return orders.select(
        F.when(F.col("o_orderkey") % 10 == 0, F.lit(None).cast("bigint"))
        .otherwise(F.col("o_orderkey"))
        .alias("id"),
        F.col("o_orderdate").alias("date_joined"),
    )


def userentry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site entries from ``events``: one month, sub-second times."""
    events = read_table(spark, sf_dir, "events")
    return events.select("user_id", F.col("ts").alias("entry_at"))


def userentry_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site entries from ``orders``: many monthly cohorts over several years."""
    orders = read_table(spark, sf_dir, "orders")
    return orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("entry_at"))


def stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click-stream with the six funnel events and assorted query strings
    (NULL, absent, empty, single, double and overlapping parameters)."""
    events = read_table(spark, sf_dir, "events")
    eid, uid = F.col("event_id"), F.col("user_id")
    event = (
        F.when(F.col("event_type") == "view", "enter_site")
        .when(F.col("event_type") == "click", "open_page")
        .when(F.col("event_type") == "signup", "request_consultation")
        .when(F.col("event_type") == "purchase", "go_to__payment")
        .when(eid % 2 == 0, "request_demo")
        .otherwise("get_test_results")
    )
    src = F.concat(F.lit("src"), (uid % 4).cast("string"))
    url = (
        F.when(eid % 7 == 0, F.lit(None).cast("string"))
        .when(eid % 7 == 1, F.concat(F.lit("?utm_source="), src))
        .when(
            eid % 7 == 2,
            F.concat(
                F.lit("?discount="),
                ((eid % 3) * 10).cast("string"),
                F.lit("&funnel=f"),
                (uid % 2).cast("string"),
            ),
        )
        .when(
            eid % 7 == 3,
            F.concat(F.lit("?source=s"), (uid % 3).cast("string"), F.lit("&utm_source="), src),
        )
        .when(eid % 7 == 4, F.lit("?utm_source=src1&source=s2"))
        .when(eid % 7 == 5, F.lit("?page=1"))
        .otherwise(F.lit("?discount=&funnel=f9"))
    )
    return events.select(
        uid.alias("uid"),
        event.alias("event"),
        F.col("ts").alias("created_at"),
        url.alias("url_params"),
        "event_id",
    )


def stat_irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same click-stream with a third of the rows anonymous, many of them at
    the same instant (midnight) and some without a time."""
    eid = F.col("event_id")
    return stat(spark, sf_dir).withColumns(
        {
            "uid": F.when(eid % 3 != 0, F.col("uid")),
            "created_at": F.when(eid % 11 != 0, F.when(eid % 2 == 0, F.col("created_at").cast("date").cast("timestamp_ntz")).otherwise(F.col("created_at"))),
        }
    )


FIXTURE_VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "shops": shops,
    "bonuscheques": bonuscheques,
    "users": users,
    "userentry": userentry,
    "userentry_months": userentry_months,
    "stat": stat,
    "stat_irregular": stat_irregular,
}


def load_fixtures(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All fixture views as lazy DataFrames."""
    return {name: build(spark, sf_dir) for name, build in FIXTURE_VIEWS.items()}

