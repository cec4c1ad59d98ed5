"""Connected components of link tables, by contraction rounds on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); label: a smallest-node name shared by a component.

    Each round gives every node its smallest neighbour or itself, and contracts the
    links to those names, until no link is left; the rounds' names are then
    composed. Nodes with a hot neighbour are aggregated before the shuffle, and the
    joins read written tables, so adaptive execution can split a hot name.
    """
    now, rounds = scratch.write(links.where("a <> b").select("a", "b").distinct(), f"{name}-links0"), []
    while not now.isEmpty():
        level = len(rounds)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        names = scratch.write(both.groupBy("a").agg(F.min("b").alias("b")).select(
            F.col("a").alias("node"), F.least("a", "b").alias("label")), f"{name}-names{level}")
        rounds.append(names)
        left = names.select(F.col("node").alias("a"), F.col("label").alias("x"))
        right = names.select(F.col("node").alias("b"), F.col("label").alias("y"))
        merged = now.join(left, "a").join(right, "b").where("x <> y").select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        now = scratch.write(merged, f"{name}-links{level + 1}")
        scratch.drop(f"{name}-links{level}")
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("a").alias("label")).where(F.lit(False))
    found = rounds[0]
    for names in rounds[1:]:
        step = names.select(F.col("node").alias("label"), F.col("label").alias("next"))
        found = found.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return found
