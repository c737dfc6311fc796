"""Row positions of a large sorted set without sorting it in one task.

``row_number() over (order by key)`` moves every row to one partition. When the keys are
distinct they can be cut at approximate quantiles into even buckets instead: each bucket is
numbered on its own and shifted by the sizes of the buckets before it. The cut points decide
how even the buckets are, not the numbers.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

BUCKET_ROWS = 500_000
BROADCAST_BUCKETS = 4_000


def with_position(df: DataFrame, key: str, order: Column, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``position`` (0-based, by key). Keys are distinct; ``order`` is a double that never
    decreases as the key grows."""
    total = df.count()
    buckets = -(-total // bucket_rows)      # a bucket is ordered in one task, so their number follows the rows
    if buckets <= 1:
        return df.withColumn("position", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(key)) - 1)
    cuts = df.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)])).first()[0]
    edges = [float("-inf"), *sorted(set(cuts)), float("inf")]
    cut = Bucketizer(splits=edges, inputCol="_order", outputCol="_bucket").transform(df.withColumn("_order", order))
    cut = cut.withColumn("_bucket", F.col("_bucket").cast("int"))
    sizes = {r["_bucket"]: r["count"] for r in cut.groupBy("_bucket").count().collect()}
    starts = [0, *accumulate(sizes.get(b, 0) for b in range(len(edges) - 1))]
    start = df.sparkSession.createDataFrame(
        [(b, starts[b]) for b in range(len(edges) - 1)], "_bucket int, _start bigint")
    numbered = cut.withColumn("_rank", F.row_number().over(W.partitionBy("_bucket").orderBy(key)) - 1)
    return (
        numbered.join(F.broadcast(start) if buckets <= BROADCAST_BUCKETS else start, "_bucket")
        .withColumn("position", F.col("_start") + F.col("_rank"))
        .drop("_bucket", "_order", "_rank", "_start")
    )
