"""Connected components by contraction: each node goes to its neighbour of the least hash, until few links are left, which are joined on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierloom.llm.shared import Scratch, attach, counted


#: So many links at most, 4 MB, are joined on the driver, which takes no shuffle; more are contracted first.
ON_DRIVER = 1 << 18


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of all ends of the links; the root is the least node of the component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _renamed(rows: DataFrame, col: str, spread: str, parents: DataFrame, n_rows: int) -> DataFrame:
    """Replace a node by its parent; `parents` has a node's number of links in n."""
    found = attach(rows, parents.withColumnRenamed("node", col), [col], [spread], n_rows, how="inner")
    return found.drop(col, "n").withColumnRenamed("parent", col)


def components(work: Scratch, links: DataFrame) -> DataFrame:
    """(id, label) of all ends of the links (a, b); ends of one component have one label, which is one of them.

    Hashes make the order of nodes random, so at most a fixed share of them is left after each pass on average, and the
    number of passes grows with the logarithm of the longest chain. Each pass is a minimum by key, summed up before the
    shuffle, and two joins in which nodes with many links are split. The last ON_DRIVER links take one step.
    """
    step = 0
    edges, n = work.measured(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges0", F.count(F.lit(1)))
    passes: list[DataFrame] = []
    while n:
        if n <= ON_DRIVER:
            rest = edges.toArrow()
            node, root = roots(*(rest.column(c).to_numpy() for c in ("a", "b")))
            last = work.spark.createDataFrame(pa.table({"node": node, "parent": root}), "node long, parent long")
            passes.append(work.save(last, f"parents{step}"))
            break
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("e")).select("e.*")
        rank = lambda c: F.struct(F.xxhash64(c).alias("hash"), F.col(c).alias("id"))
        least = ends.groupBy("node").agg(F.min(rank("to")).alias("to"), F.count(F.lit(1)).alias("n"))
        parents = work.save(least.select("node", F.least(rank("node"), F.col("to"))["id"].alias("parent"), "n"), f"parents{step}")
        passes.append(parents)
        step += 1
        moved = _renamed(_renamed(edges, "a", "b", parents, n), "b", "a", parents, n).where("a <> b")
        edges, n = work.measured(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"edges{step}", F.count(F.lit(1)))
    if not passes:
        return work.spark.createDataFrame([], "id long, label long")
    # a node's label is its parent's label: from the last pass back
    label = passes[-1].select("node", F.col("parent").alias("label"))
    for k, parents in enumerate(reversed(passes[:-1])):
        of_parent = counted(parents, ["parent"]).withColumnRenamed("n", "size").join(label.withColumnRenamed("node", "parent"), "parent", "left")
        up = attach(parents.select("node", "parent"), of_parent, ["parent"], ["node"], n_rows=max(1, parents.count()), size="size")
        label = work.save(up.select("node", F.coalesce("label", "parent").alias("label")), f"labels{k}")
    return label.select(F.col("node").alias("id"), "label")
