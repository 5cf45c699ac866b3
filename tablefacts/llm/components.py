"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """Links (u, v) to one row (u, v) per node u that is not the least of its component v.

    Each round hangs every node's larger neighbours, then its smaller ones, on the least
    neighbour. A round is aggregates and joins on the links, which shrink to stars; the
    number of rounds grows with the logarithm of the nodes."""
    links = materialize(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = None
    while True:
        now = _fingerprint(links)
        if now == before or not now[0]:
            return links
        before = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = small.unionByName(least.select("u", F.col("m").alias("v")))
        links = materialize(stars.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
