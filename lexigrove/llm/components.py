"""Connected components by contraction: hooking to smaller names, and a union-find over what is left."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import store

#: Most edges that one task joins (some tens of bytes each); more of them are first hooked in rounds over all executors.
LEFT = 500_000


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root) for the nodes of all edges (a, b) of a task; the root is the smallest node."""
    up: dict = {}

    def find(x):
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    for batch in batches:
        for a, b in zip(batch["a"], batch["b"], strict=True):
            p, q = find(a), find(b)
            if p < q:
                up[q] = p
            elif q < p:
                up[p] = q
    nodes = list(up)
    yield pd.DataFrame({"node": nodes, "root": [find(x) for x in nodes]})


def roots(edges: DataFrame) -> DataFrame | None:
    """(node, root) for every node of ``edges`` (a, b; of one type with an order): the smallest node that is reachable.

    Each round hooks every name to the smallest name beside it, follows the hooks once and replaces both ends
    of the edges, which leaves few of them; a hub is a join that adaptive execution can split, and minima
    are combined before they are shuffled. As soon as no more than ``LEFT`` edges are left, one task
    joins them. Every round is a written table. Loops are allowed; without any other edge the result is None.
    """
    kind = dict(edges.dtypes)["a"]
    known: DataFrame | None = None
    while True:
        now = store.materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "cc-edges")
        left = now.count()
        if not left:
            return known
        few = left <= LEFT
        if few:
            found = now.coalesce(1).mapInPandas(_forest, f"node {kind}, root {kind}")
        else:
            ends = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            hooked = store.materialise(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")), "cc-hooked")
            onward = hooked.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = hooked.join(onward, "root").select("node", F.col("next").alias("root"))
        found = store.materialise(found, "cc-roots")
        if known is None:
            known = found
        else:
            step = found.select(F.col("node").alias("root"), F.col("root").alias("next"))
            known = store.materialise(known.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "cc-roots")
        if few:
            return known
        at = lambda end: found.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        edges = now.join(at("a"), "a").join(at("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
