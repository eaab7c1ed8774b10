"""Components and reachable nodes of tables of links, found by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.sources.shared import kept


def connected(edges: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """The smallest node that can be reached from each node that has a link: columns node, component.

    In a round each node takes the smallest label among its neighbours', then that label's own label, so a chain is covered
    in about the logarithm of its length. Labels are written each round; nodes of any type that has an order will do. Still
    changing after ``max_rounds`` is an error.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    links = kept(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = links.groupBy("u").agg(F.min("v").alias("least"))
    labels = kept(labels.select(F.col("u").alias("node"), F.least("u", "least").alias("component")), "labels")
    for _ in range(max_rounds):
        near = links.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("component").alias("least"))
        step = kept(labels.join(near, F.col("node") == F.col("u")).select("node", F.col("component").alias("old"), F.least("component", "least").alias("label")), "labels")
        heads = step.select(F.col("node").alias("head"), F.col("label").alias("next"))
        moved = kept(step.join(heads, F.col("label") == F.col("head"), "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("component")), "labels")
        labels = moved.select("node", "component")
        if not moved.filter("component <> old").limit(1).count():
            return labels
    raise RuntimeError(f"components still change after {max_rounds} rounds")


def reachable(edges: DataFrame, start: DataFrame, source: list[str], target: list[str], max_rounds: int = 1000) -> DataFrame:
    """Nodes that links lead to from the nodes of ``start``, in any number of steps, with the least number as ``steps``.

    Nodes have as many columns as ``source`` and ``target``, which name the two ends of a link. The start itself is among
    them only if a cycle leads back. Each round joins only what the round before has found, and drops what was known.
    """
    names = [f"n{i}" for i in range(len(source))]
    links = kept(edges.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(source, names, strict=True)], *[F.col(f"`{c}`").alias(f"to_{n}") for c, n in zip(target, names, strict=True)]).distinct(), "links")
    front = start.toDF(*names).distinct()
    found = None
    for step in range(1, max_rounds + 1):
        ahead = links.join(front, names, "left_semi").select(*[F.col(f"to_{n}").alias(n) for n in names]).distinct()
        if found is not None:
            ahead = ahead.join(found, names, "left_anti")
        front = kept(ahead.withColumn("steps", F.lit(step)), "reached")
        if not front.limit(1).count():
            return front if found is None else found
        found = front if found is None else found.unionByName(front)
        front = front.drop("steps")
    raise RuntimeError(f"more links than {max_rounds} in a row")
