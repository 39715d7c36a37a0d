"""Per-key distinct counts where a few keys hold most rows.

1. A frequent-items sketch over all rows (map-side partials of fixed size, merged) names every key whose share
   can reach ``share``; at most ``1 / share`` keys can, so the list that is broadcast has a proven bound.
2. Rows of heavy keys meet that list in a broadcast join and are counted in two steps, the first spread over
   ``salts`` parts of each key by the hash of the counted id, so that distinct counts of the parts just add up.
3. All other rows are counted by an ordinary shuffle on the key.
4. The union of both is the result; no row is sampled away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy from this share of the rows on.
HEAVY_SHARE = 0.005
SALTS = 64


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> DataFrame:
    """Keys that hold at least ``share`` of df's rows, as one column ``key``: at most 1 / share rows; null is no key.

    ``approx_top_k`` keeps counters of fixed number for each task. Its estimate is never below the true count, so no
    heavy key is missed; a key listed in excess only takes the other, equally exact path.
    """
    k = int(1 / share)
    counted = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k")).agg(F.expr(f"approx_top_k(k, {k}, {max(10_000, 20 * k)})").alias("top"), F.count("*").alias("n"))
    return counted.select(F.explode("top").alias("t"), "n").where(F.col("t.count") >= F.col("n") * F.lit(share)).select(F.col("t.item").alias(key))


def distinct_counts(df: DataFrame, key: str, by: list[str], kind: str, kinds: dict[str, str], item: str, share: float = HEAVY_SHARE, salts: int = SALTS) -> DataFrame:
    """Distinct values of ``item`` for each key and ``by``, one column for each kind.

    kinds: value of the column ``kind`` -> name of the result column. A null key is a group of its own and is spread
    like a heavy one; null items count nowhere, but their key and ``by`` still give a row of zeros. An empty table
    gives no rows. Columns besides those named play no part, whatever their names.
    """
    rows = df.select(key, *by, kind, item)
    heavy = F.broadcast(heavy_keys(rows, key, share).withColumn("_heavy", F.lit(True)))
    tagged = rows.join(heavy, key, "left")
    is_heavy = F.col("_heavy").isNotNull() | F.col(key).isNull()
    one: list[Column] = [F.count_distinct(item).alias("_n")]
    group = [key, *by, kind]
    light = tagged.where(~is_heavy).groupBy(*group).agg(*one)
    # pre-aggregated for each salt; a salt is a function of the item, so equal items share one
    hot = tagged.where(is_heavy).withColumn("_salt", F.pmod(F.xxhash64(item), F.lit(salts)).cast("int")).groupBy(*group, "_salt").agg(*one).groupBy(*group).agg(F.sum("_n").alias("_n"))
    return light.unionByName(hot).groupBy(key, *by).agg(*[F.coalesce(F.sum(F.when(F.col(kind) == k, F.col("_n"))), F.lit(0)).cast("bigint").alias(name) for k, name in kinds.items()])
