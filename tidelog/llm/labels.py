"""A bounded sample of labelled documents, for the classifiers to be fitted on.

Rows are sampled, whatever the length of their texts. Labels are sampled by a hash of
their id and place before the join, so what is broadcast is bounded, and the joined rows
once more, so an id that very many documents or labels share adds no more than the bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import only, row_key, steady

WHOLE = 1 << 30


def below(share: float) -> int:
    return int(min(1.0, share) * WHOLE)


def dice(salt: str, *columns: str) -> F.Column:
    return F.pmod(F.xxhash64(*columns, F.lit(salt)), F.lit(WHOLE))


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int, salt: str, each: bool = False) -> tuple[DataFrame, dict[int, float]]:
    """(row, text, n0, n1): documents with how often they have label 0 and 1, at most
    about `bound` sampled labels, of either kind if `each`, and as many documents; and
    the share of the labels of either kind that was sampled."""
    known = only(steady(labels), "doc_id", label).toDF("id", "y").withColumn("place", row_key()).where(F.col("id").isNotNull() & F.col("y").isin(0, 1))
    known = known.select(F.col("id").cast("long").alias("id"), F.col("y").cast("int").alias("y"), dice(salt, "id", "place").alias("h"))
    sizes = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    total = sum(sizes.values())
    share = {y: min(1.0, bound / (n if each else total)) for y, n in sizes.items()}
    limit = F.lit(0)
    for y, s in share.items():
        limit = F.when(F.col("y") == y, F.lit(below(s))).otherwise(limit)
    chosen = known.where(F.col("h") < limit).groupBy("id").agg(F.count(F.when(F.col("y") == 0, 1)).alias("n0"), F.count(F.when(F.col("y") == 1, 1)).alias("n1"))
    rows = only(steady(docs), "doc_id", "text").withColumn("row", row_key())
    joined = rows.join(F.broadcast(chosen), rows.doc_id == chosen.id)
    found, most = joined.select("row").count(), bound * (2 if each else 1)
    kept = joined.where(dice(salt, "row") < below(1.5 * most / max(found, 1)))
    return kept.select("row", "text", "n0", "n1"), share
