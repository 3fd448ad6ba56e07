"""Connected components of a table of links.

Up to LINKS links are joined up by one task. A larger table is contracted first,
round by round: each node takes the least of itself and its neighbours by a hash of
their numbers, so that chains of consecutive numbers shrink as well, then that
one's own choice; links between nodes of one choice go, the others are distinct
links of choices. The size changes the way only, not the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Links (16 bytes each) that one task takes up.
LINKS = 1 << 20


def roots(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of the links, ascending, and the least end that links lead each to."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    up = np.arange(len(nodes))
    while (up[a] != up[b]).any():
        p, q = up[a], up[b]
        low = np.minimum(p, q)
        np.minimum.at(up, p, low)
        np.minimum.at(up, q, low)
        while (up[up] != up).any():
            up = up[up]
    return nodes, nodes[up]


def _joined_up(batches):
    found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if len(b)]
    if found:
        node, label = roots(*(np.concatenate(c) for c in zip(*found, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(label)], names=["node", "label"])


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """node, label for each end of the links (x, y): those that links join up have one label. Nulls are not links."""
    most = LINKS if most is None else most
    links = materialize(links.select("x", "y").where("x IS NOT NULL AND y IS NOT NULL"))
    steps: list[DataFrame] = []
    while links.count() > most:
        both = links.unionAll(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("rank"), F.col(c).alias("node"))
        near = both.groupBy(F.col("x").alias("node")).agg(F.min(rank("y")).alias("near"))
        hooked = materialize(near.select("node", F.least(rank("node"), "near").getItem("node").alias("to")))
        far = hooked.select(F.col("node").alias("to"), F.col("to").alias("far"))
        step = materialize(hooked.join(far, "to").select("node", F.col("far").alias("to")))
        x, y = (step.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "xy")
        moved = links.join(x, "x").join(y, "y").where("to_x != to_y")
        links = materialize(moved.select(F.least("to_x", "to_y").alias("x"), F.greatest("to_x", "to_y").alias("y")).distinct())
        steps.append(step)
    labels = materialize(links.coalesce(1).mapInArrow(_joined_up, "node bigint, label bigint"))
    for step in reversed(steps):
        last = labels.select(F.col("node").alias("to"), "label")
        labels = materialize(step.join(last, "to", "left").select("node", F.coalesce("label", "to").alias("label")))
    return labels
