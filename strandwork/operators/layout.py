"""A force-directed layout of the graph that is drawn, one group at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Nodes whose distances to all others are held at once.
ROWS = 256


def placed(n: int, edges: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """Positions in [-1, 1] after ``rounds`` of repulsion between all nodes and attraction along edges, cooling down."""
    rng = np.random.default_rng(seed)
    xy = rng.uniform(-1, 1, (n, 2))
    ideal = (4.0 / max(1, n)) ** 0.5
    for step in range(rounds):
        move = np.empty_like(xy)
        for at in range(0, n, ROWS):
            gap = xy[at : at + ROWS, None] - xy[None]
            far = np.maximum(np.hypot(gap[..., 0], gap[..., 1]), 1e-3)
            move[at : at + ROWS] = (gap * (ideal**2 / far**2)[..., None]).sum(axis=1)
        if len(edges):
            along = xy[edges[:, 0]] - xy[edges[:, 1]]
            pull = along * (np.hypot(along[:, 0], along[:, 1]) / ideal)[:, None]
            np.add.at(move, edges[:, 0], -pull)
            np.add.at(move, edges[:, 1], pull)
        size = np.maximum(np.hypot(move[:, 0], move[:, 1]), 1e-9)
        heat = 0.2 * (1 - step / rounds)
        xy = xy + move / size[:, None] * np.minimum(size, heat)[:, None]
    most = np.abs(xy).max() if n else 1.0
    return xy / max(most, 1e-9)


def layout(nodes: DataFrame, edges: DataFrame, group: str, seed: int = 42) -> DataFrame:
    """``group, node, x, y`` for every node of ``nodes`` (``group, node``), pulled by ``edges`` (``group, a, b``) among them.

    A group is one task, so callers give the graph that is drawn. Groups of over 600 nodes take 30 rounds, others 50.
    """
    every = nodes.select(group, "node").distinct()
    pairs = edges.select(group, "a", "b").distinct()
    for end in ("a", "b"):
        pairs = pairs.join(every.select(group, F.col("node").alias(end)), [group, end], "left_semi")
    rows = every.select(group, "node", F.lit(None).cast("long").alias("other")).unionByName(pairs.select(group, F.col("a").alias("node"), F.col("b").alias("other")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = np.sort(pdf.loc[pdf.other.isna(), "node"].to_numpy())
        links = pdf.dropna(subset=["other"]).sort_values(["node", "other"])
        ends = np.stack([np.searchsorted(nodes, links.node), np.searchsorted(nodes, links.other.astype("int64"))], axis=1) if len(links) else np.zeros((0, 2), int)
        xy = placed(len(nodes), ends, 50 if len(nodes) <= 600 else 30, seed)
        return pd.DataFrame({group: pdf[group].iloc[0], "node": nodes, "x": xy[:, 0], "y": xy[:, 1]})

    return rows.groupBy(group).applyInPandas(run, f"{group} string, node long, x double, y double")
