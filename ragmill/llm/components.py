"""Connected components of a link table, by hooking and pointer jumping over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragmill.session import materialize


def _roots(parents: DataFrame) -> DataFrame:
    """Follow ``parent`` until every node points at its root; each step doubles the distance."""
    while True:
        step = parents
        for _ in range(2):
            up = step.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            step = step.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"))
        moved = materialize(
            step.join(parents.withColumnRenamed("parent", "old"), "node").select(
                "node", "parent", (F.col("parent") != F.col("old")).alias("moved")
            )
        )
        parents = moved.select("node", "parent")
        if moved.filter("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the links ``(a, b)``.

    Nodes without links do not come out. Each round hooks every node to its smallest neighbour, jumps to the
    roots and contracts the links; rounds are logarithmic in practice. Links and nodes stay in written
    tables; the driver sees only whether something is left.
    """
    links = materialize(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
        .distinct()
    )
    labels = None
    while not links.isEmpty():
        roots = _roots(materialize(links.groupBy("node").agg(F.min("other").alias("parent"))))
        if labels is None:
            # Nodes that only ever are the smaller end are roots of themselves.
            ends = links.select(F.col("other").alias("node")).distinct()
            labels = materialize(
                roots.unionByName(
                    ends.join(roots, "node", "left_anti").select("node", F.col("node").alias("parent"))
                ).withColumnRenamed("parent", "component")
            )
        else:
            up = roots.select(F.col("node").alias("component"), F.col("parent").alias("above"))
            labels = materialize(
                labels.join(up, "component", "left").select("node", F.coalesce("above", "component").alias("component"))
            )
        left = roots.select("node", F.col("parent").alias("x"))
        right = roots.select(F.col("node").alias("other"), F.col("parent").alias("y"))
        mapped = (
            links.join(left, "node", "left").join(right, "other", "left")
            .select(F.coalesce("x", "node").alias("p"), F.coalesce("y", "other").alias("q"))
            .filter("p <> q")
        )
        links = materialize(
            mapped.select(F.greatest("p", "q").alias("node"), F.least("p", "q").alias("other")).distinct()
        )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    return labels
