"""Small literal frames for the micro tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import types as T

CHEQUES = T.StructType(
    [
        T.StructField("card", T.StringType(), False),
        T.StructField("doc_id", T.LongType(), False),
        T.StructField("shop", T.StringType(), False),
        T.StructField("datetime", T.TimestampNTZType(), False),
        T.StructField("summ_with_disc", T.DecimalType(18, 4), True),
    ]
)
SHOPS = T.StructType([T.StructField("name", T.StringType(), False)])
TX = T.StructType(
    [
        T.StructField("client_id", T.StringType(), False),
        T.StructField("doc_id", T.LongType(), False),
        T.StructField("shop", T.StringType(), False),
        T.StructField("transaction_date", T.DateType(), False),
        T.StructField("purchase_amount", T.DecimalType(18, 4), True),
    ]
)
SEGMENTS = T.StructType(
    [
        T.StructField("client_id", T.StringType(), False),
        T.StructField("shop", T.StringType(), False),
        T.StructField("rfm_group", T.StringType(), False),
        T.StructField("current_dt", T.DateType(), False),
    ]
)
STAT = T.StructType(
    [
        T.StructField("uid", T.LongType(), True),
        T.StructField("event", T.StringType(), False),
        T.StructField("created_at", T.TimestampNTZType(), False),
        T.StructField("url_params", T.StringType(), True),
    ]
)
ENTRIES = T.StructType(
    [
        T.StructField("user_id", T.LongType(), False),
        T.StructField("entry_at", T.TimestampNTZType(), False),
    ]
)
USERS = T.StructType(
    [
        T.StructField("id", T.LongType(), True),
        T.StructField("date_joined", T.TimestampNTZType(), True),
    ]
)


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def money(x) -> Decimal | None:
    return None if x is None else Decimal(str(x))
