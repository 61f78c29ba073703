"""What the two vector searches share: which rows take part, and the merge of partial rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries are the rows whose id this divides.
QUERY_STEP = 100
K = 10


def usable(vector: str = "embedding") -> Column:
    """Neither null, empty nor zero, and no component null or not finite."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(pairs: DataFrame, k: int, measure: str) -> DataFrame:
    """The k rows of least (measure, vec_id) of each query, with their rank. Spark limits the ranks before its shuffle too."""
    best = Window.partitionBy("query_id").orderBy(measure, "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
