"""Connected components over a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): component is the smallest node reachable. Null ends and loops are ignored.

    Alternating large-star and small-star steps (Kiveris et al., 2014) turn the links into stars; the rounds grow with the logarithm
    of the table. Each round is written to the shared folder and replaces the one before. Neighbours are reduced by
    min() with partial aggregates and joined back, never listed.
    """
    a, b = F.col("a"), F.col("b")
    links = links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    now = scratch.save(links, f"{name}-0")
    k = 0
    while True:
        k += 1
        # large star: every neighbour larger than a node is linked to the node's smallest neighbour (itself included)
        both = now.select("a", "b").union(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(b > a).join(least, "a").select(F.col("m").alias("a"), "b")
        # small star: a node and its smaller neighbours are linked to the smallest of these
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select("m", "a", "b")
        after = small.select(F.col("m").alias("a"), "b").union(small.select(F.col("m").alias("a"), a.alias("b"))).where("a != b").distinct()
        now = scratch.save(after, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        rows, leaves = now.agg(F.count("*"), F.count_distinct("b")).first()
        # stars: every leaf has one centre, and no centre is another's leaf
        if rows == leaves and now.select("a").distinct().join(now.select(b.alias("a")), "a", "left_semi").isEmpty():
            break
    # only the last round is still read
    stars = now.select(b.alias("node"), a.alias("component"))
    return stars.union(now.select(a.alias("node"), a.alias("component")).distinct())


#: Rows from which a class counts as hot, at least; above that, a thousandth of all rows.
HOT = 1_000


def labelled_rows(rows: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns that ``labels`` has for their keys; ``labels`` also has ``copies``, the rows of each key, and a label for every key.

    The labels of hot keys, a thousand at most, are broadcast, so a common key is no large task; the others are joined by sort-merge. Rows with a null key are joined with nothing and keep nulls.
    """
    known = rows.where(" and ".join(f"{k} is not null" for k in keys))
    hot = F.col("copies") >= max(HOT, rows.count() // 1000 + 1)
    new = [c for c in labels.columns if c not in (*keys, "copies")]
    first = known.join(F.broadcast(labels.where(hot).drop("copies").withColumn("_hot", F.lit(True))), keys, "left")
    cold = first.where("_hot is null").drop("_hot", *new).join(labels.where(~hot).drop("copies").hint("merge"), keys)
    return first.where("_hot").drop("_hot").unionByName(cold).unionByName(rows.where(" or ".join(f"{k} is null" for k in keys)), allowMissingColumns=True)
