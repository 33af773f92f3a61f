"""Connected components by minimum labels and pointer jumping, in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.llm.common import Scratch


#: Links that one task joins up, at most; beyond them rounds of joins do.
TOGETHER = 1_000_000


def labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and, for each, the smallest node that it is linked with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        if (label[x] == label[y]).all():
            return nodes, nodes[label]
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (the smallest node reachable) for all nodes of ``links`` (a, b) that are linked with another one.

    Up to TOGETHER links, as counted first, are joined up by one task.
    """
    links = links.where("a <> b")
    if links.count() > TOGETHER:
        return by_rounds(links, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
        if held:
            nodes, label = labels(*(np.concatenate([h[k] for h in held]) for k in range(2)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(label)], names=["node", "component"])

    return scratch.keep(links.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).mapInArrow(run, "node long, component long"))


def by_rounds(links: DataFrame, scratch: Scratch) -> DataFrame:
    """The same for any number of links.

    Each round gives a node the smallest label among its own and its neighbours', hooks the old labels to the new, and then follows labels of
    labels, so the number of rounds grows with the logarithm of a component's diameter in practice. The minima are
    summed up before each shuffle, so a node with very many links is no task's burden.
    """
    both = scratch.keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    state = scratch.keep(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        far = state.select(F.col("node").alias("b"), F.col("label").alias("theirs"))
        nearest = both.join(far, "b").groupBy("a").agg(F.min("theirs").alias("theirs")).withColumnRenamed("a", "node")
        seen = state.join(nearest, "node").select("node", "label", F.least("label", "theirs").alias("best"))
        hooked = seen.select(F.col("label").alias("node"), "best").unionByName(seen.select("node", "best")).groupBy("node").agg(F.min("best").alias("best"))
        hooked = scratch.keep(hooked)
        root = hooked.select(F.col("node").alias("best"), F.col("best").alias("further"))
        jumped = hooked.join(root, "best", "left").select("node", F.least("best", "further").alias("label"))
        after = scratch.keep(jumped)
        changed = after.join(state.withColumnRenamed("label", "old"), "node").where("label <> old").isEmpty()
        state = after
        if changed:
            return state.withColumnRenamed("label", "component")
