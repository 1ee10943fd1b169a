"""Connected components, within a task and across the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the least node that the links (a, b) connect it with."""
    out = np.arange(n)
    while True:
        least = np.minimum(out[a], out[b])
        new = out.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, out[a], least)
        np.minimum.at(new, out[b], least)
        new = new[new]
        if np.array_equal(new, out):
            return out
        out = new


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step: each node's larger (or its smaller) neighbours are linked with its least one.
    The least neighbours are a table of their own, so that the join may split a hot node."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    side = both if large else both.where("b < a")
    least = stage(side.groupBy("a").agg(F.min("b").alias("least")), "least").withColumn("least", F.least("a", "least"))
    rows = side.where("b > a") if large else side
    joined = rows.join(least, "a")
    out = joined.select(F.col("least").alias("a"), "b")
    if not large:
        out = out.union(least.select(F.col("least").alias("a"), F.col("a").alias("b")))
    return out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the least node that it is connected with) for all nodes of
    the links (a, b), by alternating large and small stars until every link leads to the least
    node. Each step is written before the next begins; only counts reach the driver."""
    links = stage(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        links = stage(_star(links, True), "large")
        links = stage(_star(links, False), "small")
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        links.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()
