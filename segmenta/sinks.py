"""Publishing results as files, so that writing again gives the same files' content.

A result lives in ``<root>/card=<name>/``.  Writing replaces that folder, or only the partitions
that the result has, when the job commits: a run that fails or loses executors leaves the old files
as they are, and other cards are never touched.  Ordered results are cut into a fixed number of
sorted files of equal size; the order is made total by the remaining columns and files are cut by
position, so a rerun gives the same files, however its input is dealt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.functions.limits import total_order, with_positions

CARD = "card"


def publish(
    df: DataFrame,
    root: str,
    card: str,
    *,
    partition_by: Sequence[str] = (),
    order_by: Sequence[str | tuple[str, bool]] = (),
    files: int | None = None,
) -> None:
    """Write ``df`` as the result of ``card``.

    ``partition_by`` keeps a folder per value and replaces only the folders of values present
    (an empty result then replaces nothing).  ``order_by`` (names, or ``(name, ascending)``) gives
    sorted files, ``files`` of them (default: the shuffle partitions)."""
    if CARD in df.columns:
        raise ValueError(f"a result must not have a column {CARD!r}")
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if order_by:
        placed, total = with_positions(df, order_by, "_position")
        file = F.floor(F.col("_position") * n / max(total, 1)).cast("int")
        dealt = placed.withColumn("_file", file).repartitionById(n, F.col("_file"))
        df = dealt.sortWithinPartitions(*partition_by, "_position").drop("_position", "_file")
    elif files:
        df = df.repartition(files, *df.columns)
    writer = df.withColumn(CARD, F.lit(card)).write.option("partitionOverwriteMode", "dynamic").mode("overwrite")
    writer.partitionBy(CARD, *partition_by).parquet(root)


def published(spark: SparkSession, root: str, card: str, schema=None, order_by: Sequence[str | tuple[str, bool]] = ()) -> DataFrame:
    """The result of ``card``, as written.  With ``schema`` (that of the written frame) columns come
    back in their order and types, partition columns too; with ``order_by`` sorted."""
    rows = spark.read.option("basePath", root).option("inferSchema", False).parquet(f"{root}/{CARD}={card}").drop(CARD)
    if schema is not None:
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    return rows.orderBy(*total_order(rows, order_by)) if order_by else rows
