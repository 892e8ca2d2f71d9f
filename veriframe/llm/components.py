"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import materialise

EDGES_AT_ONCE = 1 << 18


def least_labels(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the nodes 0 to n - 1 that edges (x, y) reach from each."""
    label = np.arange(n)
    while True:
        a, b = label[x], label[y]
        if (a == b).all():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def contracted(edges: DataFrame) -> DataFrame:
    """(a, b): of the edges that a task holds, up to ``EDGES_AT_ONCE`` at a time, the least node of each component and each other one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nodes, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
            held.clear()
            x, y = at.reshape(2, -1)
            label = least_labels(x, y, len(nodes))
            own = label == np.arange(len(nodes))
            keep = ~own | (np.bincount(label, minlength=len(nodes)) == 1)  # a node beside itself alone stays a node
            return pa.RecordBatch.from_arrays([pa.array(nodes[label[keep]]), pa.array(nodes[keep])], names=["a", "b"])

        for b in batches:
            if b.num_rows:
                held.append(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]))
            if sum(x.shape[1] for x in held) >= EDGES_AT_ONCE:
                yield flush()
        if held:
            yield flush()

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(run, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): label is the smallest node reachable.

    Each task first makes stars of its own edges, so chains within a task cost no rounds. Each round takes the least label of a node's neighbours and then that label's own label, so a
    path of length n needs about log n rounds. Every round is written to the shared folder.
    Messages are pre-aggregated. In a large component many rows share one label; the other side of
    that join has one row a key, so adaptive execution splits the hot partition. Labels only fall,
    so the rounds end.
    """
    edges = contracted(edges)
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        near = labels.join(heard, "node", "left").select("node", "label", F.least("label", F.coalesce("heard", "label")).alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("jumped"))
        new = materialise(near.join(jump, "low", "left").select("node", F.least("low", F.coalesce("jumped", "low")).alias("label"), F.col("label").alias("was")))
        changed = new.filter("label <> was").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
