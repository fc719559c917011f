"""Connected components by repeated contraction, all on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwarden.llm.common import written


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``, one root per component.

    Each round every node takes the name of the neighbour (or itself) that comes first in a
    hashed order of that round; links between names remain. Names die out by a constant
    share per round whatever the shape of the graph, so a path ends in log rounds as a star
    does. A node with very many links is a hot key of pre-aggregated minima and of joins
    between written tables only.
    """
    links = written(links.select("a", "b").filter("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    names: list[DataFrame] = []
    while not links.isEmpty():
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
            links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        order = F.struct(F.xxhash64("other", F.lit(len(names))).alias("h"), F.col("other").alias("v"))
        own = F.struct(F.xxhash64("node", F.lit(len(names))).alias("h"), F.col("node").alias("v"))
        name = written(ends.groupBy("node").agg(F.min(order).alias("first")).select(
            "node", F.least("first", own)["v"].alias("name")), "names")
        names.append(name)
        first = links.join(name.withColumnsRenamed({"node": "a", "name": "x"}), "a")
        both = first.join(name.withColumnsRenamed({"node": "b", "name": "y"}), "b")
        links = written(both.filter("x <> y").select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if not names:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = names[0].withColumnRenamed("name", "root")
    for later in names[1:]:
        step = later.withColumnsRenamed({"node": "root", "name": "next"})
        roots = written(roots.join(step, "root", "left").select(
            "node", F.coalesce("next", "root").alias("root")), "roots")
    return roots
