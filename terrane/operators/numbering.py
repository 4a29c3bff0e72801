"""Places in an order, without bringing a whole group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.session import cut


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "place") -> DataFrame:
    """`rows` with their place, from 0, among those of the same `keys` in ascending `order`; rows that tie are in any order.

    Rows are put in ranges by keys and order, so a large group spans several. Each range numbers its own rows, and
    begins where the ranges before it, of which one row each is compared, end.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = cut(rows.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    own = r.withColumn("_own", F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order)) - 1)
    sizes = r.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*(f"_k{i}" for i in range(len(keys)))).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return own.join(sizes, on).select(*rows.columns, (F.col("_base") + F.col("_own")).alias(name))
