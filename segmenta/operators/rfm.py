"""RFM scoring: transactions -> (client, shop) measures -> quartile thresholds
-> 0..3 ranks -> three-digit code -> named segment, plus the client report.

Grain: one row per (client, shop).  Plan shape at scale:

* the receipt scan is filtered (card prefix, period, shop) in the Parquet reader;
* the shop dimension is broadcast only after a bounded row-count check;
* receipt lines are exchanged once, combined before the shuffle, to one row per
  (client, shop, doc_id): a client with a huge share of receipts is spread over
  tasks, and COUNT(DISTINCT doc_id) is a plain count of these rows;
* "today" (``current_dt``) is a global aggregate (partial per task) read back
  as a literal, not a window over all receipts;
* quartiles are exact and distributed (``functions.quantiles``);
* ranks, code and segment name are narrow expressions on the nine threshold
  literals and a constant map: no join, no shuffle.
"""

from __future__ import annotations

import threading
import weakref
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segmenta.functions.columns import days_between
from segmenta.functions.joins import DEFAULT_BROADCAST_MAX_ROWS, broadcast_if_small, literal, one_row
from segmenta.functions.quantiles import DEFAULT_ACCURACY, exact_percentiles
from segmenta.operators.filters import apply_filters, date_range_predicate, in_predicate
from segmenta.sources.tables import require_columns

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's): segment label -> RFM codes, in the
# reference's order.  Code = recency rank, frequency rank, monetary rank; 0 best.
# ---------------------------------------------------------------------------
SEGMENT_CODES: dict[str, list[str]] = {
    "Чемпионы": ["000"],
    "Потенциальные лидеры": ["001", "110", "111", "101", "011", "100", "010"],
    "Лояльные": ["122", "123", "023", "013", "022", "112", "113", "012", "002", "003", "102", "103"],
    "Перспективные": ["021", "031", "020", "030", "121", "131", "120", "130", "201"],
    "Низкоактивные крупные покупатели": ["210", "220", "211", "221", "230"],
    "Растущие": ["222", "212", "213", "223", "202", "203"],
    "Новички": ["133", "132", "033", "032"],
    "Требуют внимания": ["330", "331", "320", "310", "321", "311", "200", "300", "301", "231"],
    "Сомневаются": ["303", "302"],
    "В зоне риска": ["313", "312"],
    "Спящие": ["322", "323", "232", "233"],
    "Потерянные": ["332", "333"],
}
FALLBACK_SEGMENT = "Прочие"

# English identifiers for the same segments (label='id').
SEGMENT_IDS: dict[str, str] = {
    "Чемпионы": "champions",
    "Потенциальные лидеры": "potential_leaders",
    "Лояльные": "loyal",
    "Перспективные": "promising",
    "Низкоактивные крупные покупатели": "low_activity_big_spenders",
    "Растущие": "growing",
    "Новички": "newcomers",
    "Требуют внимания": "need_attention",
    "Сомневаются": "doubting",
    "В зоне риска": "at_risk",
    "Спящие": "sleeping",
    "Потерянные": "lost",
    "Прочие": "other",
}

# The threshold columns' names.
THRESHOLD_NAMES = {
    ("recency", 0.25): "r25",
    ("recency", 0.5): "recency_median",
    ("recency", 0.75): "r75",
    ("frequency", 0.25): "f25",
    ("frequency", 0.5): "frequency_median",
    ("frequency", 0.75): "f75",
    ("monetary", 0.25): "m25",
    ("monetary", 0.5): "monetary_median",
    ("monetary", 0.75): "m75",
}


def segment_of_code(code_table: dict[str, list[str]] | None = None, label: str = "ru") -> dict[str, str]:
    """Code -> segment name, validated to be a function (each code listed once)."""
    table = code_table or SEGMENT_CODES
    out: dict[str, str] = {}
    for name, codes in table.items():
        shown = SEGMENT_IDS.get(name, name) if label == "id" else name
        for code in codes:
            if code in out:
                raise ValueError(f"code {code} listed for both {out[code]!r} and {shown!r}")
            out[code] = shown
    return out


# ---------------------------------------------------------------------------
# Q01 transactions
# ---------------------------------------------------------------------------


def transactions(
    cheques: DataFrame,
    shops: DataFrame,
    *,
    date_range=None,
    shop_in=None,
    card_prefix: str = "200",
    with_current_dt: bool = False,
    broadcast_max_rows: int = DEFAULT_BROADCAST_MAX_ROWS,
) -> DataFrame:
    """Receipt lines of loyalty cards starting with ``card_prefix`` in a known shop.

    Columns: client_id, doc_id, shop, transaction_date (date), purchase_amount
    (+ current_dt, the newest date of the *filtered* set, when asked for).
    Period and shop filters apply before "today" is taken, as in the reference.
    """
    require_columns(cheques, ["card", "doc_id", "shop", "datetime", "summ_with_disc"], "bonuscheques")
    require_columns(shops, ["name"], "shops")
    lines = apply_filters(
        cheques,
        F.col("card").startswith(card_prefix),  # prefix match -> StringStartsWith pushdown
        date_range_predicate("datetime", date_range),
        in_predicate("shop", shop_in),
    )
    known = apply_filters(shops.select(F.col("name").alias("_shop_name")), in_predicate("_shop_name", shop_in))
    known = broadcast_if_small(known, broadcast_max_rows)
    tx = lines.join(known, F.col("shop") == F.col("_shop_name")).select(
        F.col("card").alias("client_id"),
        "doc_id",
        "shop",
        F.to_date("datetime").alias("transaction_date"),
        F.col("summ_with_disc").alias("purchase_amount"),
    )
    if with_current_dt:
        today = one_row(tx.agg(F.max("transaction_date").alias("current_dt")))["current_dt"]
        tx = tx.withColumn("current_dt", literal(today, "date"))
    return tx


# ---------------------------------------------------------------------------
# Receipt grain
# ---------------------------------------------------------------------------


DOC = ["client_id", "shop", "doc_id"]


def receipts(tx: DataFrame) -> DataFrame:
    """Pre-aggregate receipt lines to (client_id, shop, doc_id, transaction_date)
    with ``lines`` (rows represented) and ``purchase_amount`` (their sum).

    Every later measure is a sum of these two or a distinct count of the keys,
    so this grain answers them all exactly.  The aggregate is combined
    map-side, and its shuffle key includes doc_id, so a client holding a large
    share of the receipts is spread over many tasks.
    """
    return tx.groupBy(*DOC, "transaction_date").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("purchase_amount").alias("purchase_amount"),
    )


def receipt_totals(tx: DataFrame) -> DataFrame:
    """One row per (client_id, shop, doc_id): ``first_date``, ``last_date``, ``split``
    (whether its lines differ in date), ``lines``, ``purchase_amount``.  ``tx`` = lines
    or :func:`receipts` output."""
    day = F.col("transaction_date")
    some_dated = (F.count(day) > 0) & (F.count(day) < F.count(F.lit(1)))
    return as_receipts(tx).groupBy(*DOC).agg(
        F.min(day).alias("first_date"),
        F.max(day).alias("last_date"),
        (F.coalesce(F.min(day) < F.max(day), F.lit(False)) | some_dated).alias("split"),
        F.sum("lines").alias("lines"),
        F.sum("purchase_amount").alias("purchase_amount"),
    )


def receipts_of_totals(totals: DataFrame, tx: DataFrame, any_split: bool) -> DataFrame:
    """:func:`receipts` from :func:`receipt_totals` without another look at the
    lines, but for those of receipts that lie on several days, if there are any."""
    one_day = totals.where(~F.col("split")).select(
        *DOC, F.col("first_date").alias("transaction_date"), "lines", "purchase_amount"
    )
    if not any_split:
        return one_day
    split = totals.where("split").select(*[F.col(c).alias("_" + c) for c in DOC])
    same = [F.col(c).eqNullSafe(F.col("_" + c)) for c in DOC]
    return one_day.unionByName(receipts(tx.join(split, same, "left_semi")))


def as_receipts(tx: DataFrame) -> DataFrame:
    """Accept raw receipt lines (one row = one line) or :func:`receipts` output."""
    return tx if "lines" in tx.columns else tx.withColumn("lines", F.lit(1).cast("bigint"))


# ---------------------------------------------------------------------------
# Q02 rfm_base
# ---------------------------------------------------------------------------


def _group_measures(totals: DataFrame) -> DataFrame:
    """(client_id, shop, last_date, frequency, monetary, split) from :func:`receipt_totals`;
    ``split`` tells whether a receipt lies on several days.  Each receipt is one row, so
    its distinct count is a count (a missing doc_id counts as none)."""
    return totals.groupBy("client_id", "shop").agg(
        F.max("last_date").alias("last_date"),
        F.count("doc_id").cast("bigint").alias("frequency"),
        F.sum("purchase_amount").alias("monetary"),
        F.max("split").alias("split"),
    )


def _with_today(grouped: DataFrame, today) -> DataFrame:
    t = literal(today, "date")
    return grouped.select(
        "client_id",
        "shop",
        days_between(t, "last_date").alias("recency"),
        "frequency",
        "monetary",
        "last_date",
        t.alias("current_dt"),
    )


def rfm_base(tx: DataFrame) -> DataFrame:
    """recency (days since the group's last purchase, against the newest date of
    all filtered receipts), frequency (distinct receipts), monetary (sum, NULL
    amounts skipped) per (client_id, shop).  ``tx`` = lines or receipts.

    "Today" is the max of the per-group last dates (= the newest receipt): a
    global aggregate, partial per task, read back as a literal."""
    grouped = _group_measures(receipt_totals(tx))
    today = one_row(grouped.agg(F.max("last_date").alias("d")))["d"]
    return _with_today(grouped, today)


# ---------------------------------------------------------------------------
# Q03 rfm_thresholds
# ---------------------------------------------------------------------------


def rfm_thresholds(
    base: DataFrame,
    *,
    probs=(0.25, 0.5, 0.75),
    method: str = "exact",
    accuracy: int = DEFAULT_ACCURACY,
    counts: dict[str, int] | None = None,
) -> DataFrame:
    """One row: r25, recency_median, r75, f25, frequency_median, f75, m25,
    monetary_median, m75 (continuous percentiles over all (client, shop) rows).
    ``counts`` = non-NULL values per measure when already known.

    ``method='exact'`` (default) matches PERCENTILE_CONT; ``'approx'`` uses
    ``percentile_approx`` (one bounded sketch per measure, not interpolated).
    """
    measures = {
        "recency": F.col("recency"),
        "frequency": F.col("frequency"),
        "monetary": F.col("monetary").cast("double"),
    }
    if tuple(probs) != (0.25, 0.5, 0.75):
        raise ValueError("RFM thresholds are quartiles: probs must be (0.25, 0.5, 0.75)")
    if method == "exact":
        return exact_percentiles(base, measures, probs, names=THRESHOLD_NAMES, accuracy=accuracy, counts=counts)
    if method == "approx":
        cols = []
        for m, c in measures.items():
            arr = F.percentile_approx(c.cast("double"), list(probs), accuracy)
            for i, p in enumerate(probs):
                cols.append(arr[i].cast("double").alias(THRESHOLD_NAMES[(m, p)]))
        return base.agg(*cols)
    raise ValueError(f"unknown method {method!r}")


# ---------------------------------------------------------------------------
# Q04 rfm_ranks
# ---------------------------------------------------------------------------


def _rank(value: str, q25, q50, q75, best_low: bool):
    v = F.col(value)
    ranks = (0, 1, 2, 3) if best_low else (3, 2, 1, 0)
    t25, t50, t75 = (literal(q, "double") for q in (q25, q50, q75))
    # NULL compares unknown and falls through to the last branch, as in SQL CASE.
    return (
        F.when(v <= t25, ranks[0])
        .when(v <= t50, ranks[1])
        .when(v <= t75, ranks[2])
        .otherwise(ranks[3])
    )


def rfm_ranks(base: DataFrame, thresholds: DataFrame) -> DataFrame:
    """0..3 per measure, 0 best: recency ascending, frequency and monetary inverted.
    Keeps the measures so later operators need no join back.

    ``thresholds`` is the one-row result of :func:`rfm_thresholds`; its nine
    values enter the plan as literals (narrow, no join)."""
    th = one_row(thresholds)
    return base.select(
        "client_id",
        "shop",
        "recency",
        "frequency",
        "monetary",
        "current_dt",
        _rank("recency", th["r25"], th["recency_median"], th["r75"], best_low=True).alias("r_rank"),
        _rank("frequency", th["f25"], th["frequency_median"], th["f75"], best_low=False).alias("f_rank"),
        _rank("monetary", th["m25"], th["monetary_median"], th["m75"], best_low=False).alias("m_rank"),
    )


# ---------------------------------------------------------------------------
# Q05 rfm_segments
# ---------------------------------------------------------------------------


def rfm_segments(
    ranks: DataFrame,
    *,
    code_table: dict[str, list[str]] | None = None,
    label: str = "ru",
) -> DataFrame:
    """rfm_code = r||f||m and rfm_group = its segment name (fallback for unlisted codes).

    The code -> name table is a constant map literal: a narrow lookup inside
    whole-stage codegen, no join."""
    mapping = segment_of_code(code_table, label)
    fallback = SEGMENT_IDS[FALLBACK_SEGMENT] if label == "id" else FALLBACK_SEGMENT
    lookup = F.create_map(*[x for code, name in mapping.items() for x in (F.lit(code), F.lit(name))])
    code = F.concat(
        F.col("r_rank").cast("string"), F.col("f_rank").cast("string"), F.col("m_rank").cast("string")
    )
    return ranks.withColumn("rfm_code", code).withColumn(
        "rfm_group", F.coalesce(F.try_element_at(lookup, F.col("rfm_code")), F.lit(fallback))
    )


# ---------------------------------------------------------------------------
# Q06 rfm_report
# ---------------------------------------------------------------------------


#: Measure rows of one client that one task joins with the client's segments.
PAIR_BLOCK = 64


def _report_rows(df: DataFrame) -> DataFrame:
    money = F.col("monetary").cast("double").alias("monetary")
    return df.select("rfm_group", "shop", money, "recency", "frequency", "client_id", "rfm_code")


def rfm_report(
    base: DataFrame,
    segments: DataFrame,
    *,
    rfm_group=None,
    join_on=("client_id",),
    block: int = PAIR_BLOCK,
) -> DataFrame:
    """Client table: rfm_group, shop, monetary, recency, frequency, client_id, rfm_code.

    Faithful default joins measures to segments on client_id only, so a client
    in n shops yields n*n rows that pair one shop's measures with another shop's
    code; ``join_on=('client_id', 'shop')`` gives the one-row-per-shop variant
    (no join: the segments carry the measures).  The segment filter applies
    after scoring (thresholds do not move).

    Clients of at most ``block`` shops are joined where they lie.  The measures
    of a client with more are numbered and cut into blocks, its segment rows
    are repeated once per block, and the two meet on (client, block): the n*n
    rows of one client are made by n / block tasks.
    """
    if set(join_on) == {"client_id", "shop"}:
        rows = apply_filters(segments, in_predicate("rfm_group", rfm_group))
        return _report_rows(rows)
    by_client = Window.partitionBy("client_id")
    shops_of = F.count(F.lit(1)).over(by_client)
    seg = apply_filters(
        segments.select("client_id", "shop", "rfm_code", "rfm_group", shops_of.alias("_n")),
        in_predicate("rfm_group", rfm_group),
    )
    # Both sides derive from the same grouped table: rename the measure side's
    # keys so the self-join resolves unambiguously.
    measures = base.select("client_id", "monetary", "recency", "frequency", "shop", shops_of.alias("_m_n"))
    number = F.row_number().over(by_client.orderBy("shop"))
    light = measures.where(F.col("_m_n") <= block).withColumnRenamed("client_id", "_m_client").drop("shop")
    heavy = measures.where(F.col("_m_n") > block).select(
        F.col("client_id").alias("_m_client"), "monetary", "recency", "frequency", F.floor((number - 1) / block).alias("_m_block")
    )
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / block))
    # Dealt to all tasks before the join, however few rows they are and whichever join is planned.
    slots = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    repeated = seg.where(F.col("_n") > block).withColumn("_block", F.explode(blocks)).repartition(slots, "client_id", "_block")
    same_client = F.col("_m_client") == F.col("client_id")
    joined = light.join(seg.where(F.col("_n") <= block), same_client)
    pairs = heavy.join(repeated, same_client & (F.col("_m_block") == F.col("_block")))
    return _report_rows(joined).unionByName(_report_rows(pairs))


class Scoring:
    """The shared front half of every RFM card.

    The (client, shop) measures behind ``base`` and ``segments`` are persisted
    (memory, spilling to disk): several branches of one plan read them (today's
    date, the exact quartiles, ranks, weights, joins), and Catalyst prunes those
    branches differently, so without persisting each branch would re-scan and
    re-shuffle the receipt lines.  The receipts are persisted as well, if they
    are to be read again (``keep_receipts``).  Lost blocks are recomputed from
    lineage.  ``thresholds`` and ``segments`` are computed on first use only
    (cards that need neither skip the quartile jobs).

    A scoring owns its cached tables.  They go with ``with score(...) as s:``,
    with :meth:`unpersist`, or with the result they are lent to (:meth:`lend`).
    """

    def __init__(self, tx, totals, grouped, base, today, any_split, counts, threshold_method="exact", label="ru"):
        self.tx = tx
        self.totals = totals
        self.any_split = any_split
        self.grouped = grouped
        self.base = base
        self.today = today  # newest receipt date of the filtered set (datetime.date)
        self._counts = counts
        self._threshold_method = threshold_method
        self._label = label

    @cached_property
    def receipts(self) -> DataFrame:
        return receipts_of_totals(self.totals, self.tx, self.any_split)

    @cached_property
    def thresholds(self) -> DataFrame:
        return rfm_thresholds(self.base, method=self._threshold_method, counts=self._counts)

    @cached_property
    def segments(self) -> DataFrame:
        # A narrow projection (ranks, code, name) of the persisted (client,
        # shop) table: recomputed per branch instead of cached twice.
        return rfm_segments(rfm_ranks(self.base, self.thresholds), label=self._label)

    def __iter__(self):
        # (receipts, base, segments) unpacking for the operators.
        return iter((self.receipts, self.base, self.segments))

    def __enter__(self) -> Scoring:
        return self

    def __exit__(self, *exc) -> None:
        self.unpersist()

    def unpersist(self) -> None:
        _free(self.grouped, self.totals)

    def lend(self, result: DataFrame) -> DataFrame:
        """``result``, a plan over the cached tables, which are freed when nothing
        refers to it any more (a frame derived from it then still gives the same
        rows, from the sources)."""
        weakref.finalize(result, _free_apart, self.grouped, self.totals).atexit = False
        return result


def _free_apart(*cached: DataFrame) -> None:
    """:func:`_free` in a thread of its own: the last reference may go at any time, even while
    this thread is speaking to the JVM."""
    threading.Thread(target=_free, args=cached, daemon=True).start()


def _free(*cached: DataFrame) -> None:
    for df in cached:
        if df.sparkSession.sparkContext._jsc is not None:  # the session still runs
            df.unpersist()


def score(
    cheques: DataFrame,
    shops: DataFrame,
    *,
    date_range=None,
    shop_in=None,
    threshold_method: str = "exact",
    label: str = "ru",
    persist: bool = True,
    keep_receipts: bool = True,
) -> Scoring:
    """Receipts, (client, shop) measures, quartile thresholds and segments for
    one set of dashboard filters.

    ``segments`` carries the measures, ranks, code and group per (client, shop)
    (and ``current_dt``), which is everything the value / lifecycle / average
    operators need; ``receipts`` replaces the receipt lines for them.  With
    ``keep_receipts=False`` the receipts are not cached: for results that read
    the segments alone.
    """
    level = StorageLevel.MEMORY_AND_DISK
    keep = (lambda df: df.persist(level)) if persist else (lambda df: df)
    tx = transactions(cheques, shops, date_range=date_range, shop_in=shop_in)
    totals = receipt_totals(tx)
    if keep_receipts:
        totals = keep(totals)
    # Hash the (client, shop) table by client before persisting: it has at most
    # one row per shop per client (no hot key), and every later join or
    # aggregate keyed by client (report self-join, segment weights, per-client
    # sums) then reads it without another exchange.
    grouped = keep(_group_measures(totals).repartition("client_id"))
    # One global aggregate gives "today" and the value counts the exact
    # quartiles need (recency and frequency are never NULL per group).
    stats = one_row(
        grouped.agg(
            F.max("last_date").alias("today"),
            F.count(F.lit(1)).alias("n"),
            F.count("monetary").alias("n_monetary"),
            F.max("split").alias("any_split"),
        )
    )
    counts = {"recency": stats["n"], "frequency": stats["n"], "monetary": stats["n_monetary"]}
    return Scoring(
        tx=tx,
        totals=totals,
        any_split=bool(stats["any_split"]),
        grouped=grouped,
        base=_with_today(grouped, stats["today"]),
        today=stats["today"],
        counts=counts,
        threshold_method=threshold_method,
        label=label,
    )
