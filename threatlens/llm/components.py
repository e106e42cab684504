"""Connected components of a graph of links, as DataFrame rounds.

Links are first contracted slice by slice, twice: the nodes that a slice of about
``SLICE`` links connect become a star around the smallest of them.  Then every
node takes the smallest label among its neighbours, tells it to the node that
was its label, and takes the label of its label, until nothing changes.  So
groups move as a whole, and chains of groups are halved: rounds grow with the
logarithm of the longest chain.  Each round is written to the shared folder, in
tasks by its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlens.llm import shared

SLICE = 1 << 20     # links that a task holds at a time


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links and the smallest node they connect it to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        nearer = root.copy()
        for end in (x, y):
            np.minimum.at(nearer, end, least)
            np.minimum.at(nearer, root[end], least)     # the old label moves too, and with it all that have it
        nearer = nearer[nearer]
        if (nearer == root).all():
            return nodes, nodes[root]
        root = nearer


def _contracted(links: DataFrame) -> DataFrame:
    """Links that connect the same nodes: a star for what a slice of ``links`` connects, no node left out."""
    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in _stars(
            table["a"].to_numpy(), table["b"].to_numpy())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= SLICE:
                yield star(held)
                held, rows = [], 0
        if rows:
            yield star(held)
    return links.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, label): label is the smallest node of the component.

    Links of long integers may come in either direction, repeated or as loops;
    nodes without a link are not part of the result.  No link, no row.
    """
    read = links.count()
    stars = _contracted(shared.dealt(links.select("a", "b"), read))
    # A node is now once in a slice; dealt out by node, the stars around different centres meet in their nodes.
    stars = shared.staged(_contracted(shared.dealt(stars.repartition("a"), read)), "stars")
    both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    read = 2 * stars.count()
    both = shared.staged(both.distinct(), "links", read)
    labels = shared.staged(both.groupBy("a").agg(F.min("b").alias("b")).select(
        F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels", read)
    nodes = labels.count()
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("least")))
        # The old label, itself a node, hears of what its nodes met: else a group is passed on node by node.
        told = labels.join(near, "node").select(F.inline(F.array(
            F.struct("node", F.col("label").alias("old"), F.least("label", "least").alias("label")),
            F.struct(F.col("label").alias("node"), F.lit(None).alias("old"), F.least("label", "least").alias("label")))))
        nearer = told.groupBy("node").agg(F.max("old").alias("old"), F.min("label").alias("label"))
        nearer = shared.staged(nearer, "labels", read)
        sizes = nearer.groupBy("label").agg(F.count("*").alias("size"))
        of_label = nearer.select(F.col("node").alias("label"), F.col("label").alias("next")).join(sizes, "label")
        labels = shared.staged(shared.look_up(nearer, of_label, "label", "size", nodes).select(
            "node", "old", F.least("label", "next").alias("label")), "labels", nodes)
        if not labels.where("label <> old").limit(1).count():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
