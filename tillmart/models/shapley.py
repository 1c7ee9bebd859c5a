"""Exact Shapley values of tree ensembles, path-dependent: an absent feature follows both branches by their weight.

For one leaf the game is a product: each feature on its path contributes 1 or 0 when present (does the row satisfy
the feature's interval) and the share of training weight kept when absent. With d features a row falls into one of
2^d patterns per leaf, so the values are tabulated per pattern and looked up per row.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import factorial

import numpy as np
import pandas as pd

LEAF_CHUNK = 256

#: A forest as rows. A leaf has no feature; ``node`` counts from 0 in each tree, whose root it is; ``level`` is the node's
#: distance from the root; ``weight`` and ``churned`` are the training weights of all rows and of the churned ones.
TREES = ("tree int, node int, level int, feature string, threshold double, left int, right int, weight double, "
         "churned double")


def leaves_of_trees(nodes: pd.DataFrame, n_features: int) -> dict[str, np.ndarray]:
    """Leaves of all trees from stored node rows: value, and per feature the interval (low, high] and kept share."""
    out = {"value": [], "low": [], "high": [], "kept": []}
    n_trees = nodes["treeID"].nunique()
    for _, tree in nodes.groupby("treeID"):
        node = {r.id: r for r in tree.itertuples(index=False)}
        start = (0, np.full(n_features, -np.inf), np.full(n_features, np.inf), np.ones(n_features))
        stack = [start]
        while stack:
            at, low, high, kept = stack.pop()
            r = node[at]
            weight = float(sum(r.impurityStats))
            if r.leftChild < 0:
                out["value"].append(r.impurityStats[1] / weight / n_trees)
                out["low"].append(low)
                out["high"].append(high)
                out["kept"].append(kept)
                continue
            f, threshold = r.split["featureIndex"], r.split["leftCategoriesOrThreshold"][0]
            for child, is_left in ((r.leftChild, True), (r.rightChild, False)):
                lo, hi, share = low.copy(), high.copy(), kept.copy()
                share[f] *= sum(node[child].impurityStats) / weight
                if is_left:
                    hi[f] = min(hi[f], threshold)
                else:
                    lo[f] = max(lo[f], threshold)
                stack.append((child, lo, hi, share))
    return {k: np.array(v) for k, v in out.items()}


def tree_arrays(nodes: pd.DataFrame) -> list[tuple[np.ndarray, ...]]:
    """Each tree of stored node rows as arrays by node: feature (-1 at a leaf), threshold, left, right, churned share."""
    out = []
    for _, tree in nodes.groupby("treeID"):
        rows = {r.id: r for r in tree.itertuples(index=False)}
        feature, left, right = (np.full(max(rows) + 1, -1) for _ in range(3))
        threshold, share = np.zeros(max(rows) + 1), np.zeros(max(rows) + 1)
        for i, r in rows.items():
            share[i] = r.impurityStats[1] / float(sum(r.impurityStats))
            if r.leftChild >= 0:
                feature[i], threshold[i] = r.split["featureIndex"], r.split["leftCategoriesOrThreshold"][0]
                left[i], right[i] = r.leftChild, r.rightChild
        out.append((feature, threshold, left, right, share))
    return out


def tree_scores(trees: list[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    """For each row of ``x`` the mean share at the leaves it reaches."""
    total, every = np.zeros(len(x)), np.arange(len(x))
    for feature, threshold, left, right, share in trees:
        at = np.zeros(len(x), dtype=int)
        inner = every
        while len(inner := inner[feature[at[inner]] >= 0]):
            node = at[inner]
            at[inner] = np.where(x[inner, feature[node]] <= threshold[node], left[node], right[node])
        total += share[at]
    return total / max(len(trees), 1)


def as_rows(nodes: pd.DataFrame, features: Sequence[str]) -> list[tuple]:
    """Stored nodes of a fitted forest as rows of ``TREES``."""
    out = []
    for number, (_, tree) in enumerate(nodes.groupby("treeID")):
        node, level = {r.id: r for r in tree.itertuples(index=False)}, {0: 0}
        for i in sorted(node):  # a child's number is above its parent's
            r = node[i]
            leaf = r.leftChild < 0
            if not leaf:
                level[r.leftChild] = level[r.rightChild] = level[i] + 1
            out.append((number, int(i), level[i], None if leaf else features[r.split["featureIndex"]],
                        None if leaf else float(r.split["leftCategoriesOrThreshold"][0]), int(r.leftChild),
                        int(r.rightChild), float(sum(r.impurityStats)), float(r.impurityStats[1])))
    return out


def as_nodes(trees: pd.DataFrame, features: Sequence[str]) -> pd.DataFrame:
    """Rows of ``TREES`` as the nodes that ``leaves_of_trees`` reads."""
    leaf = trees["feature"].isna()
    return pd.DataFrame({
        "treeID": trees["tree"], "id": trees["node"],
        "impurityStats": [np.array([w - c, c]) for w, c in zip(trees["weight"], trees["churned"])],
        "leftChild": np.where(leaf, -1, trees["left"]), "rightChild": np.where(leaf, -1, trees["right"]),
        "split": [{"featureIndex": -1 if end else list(features).index(f), "leftCategoriesOrThreshold": [] if end else [t]}
                  for f, t, end in zip(trees["feature"], trees["threshold"], leaf)]})


def _pattern_values(value: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Shapley values for every leaf and pattern: array [leaves, 2^d, d]."""
    n_leaves, d = kept.shape
    bits = ((np.arange(2 ** d)[:, None] >> np.arange(d)) & 1).astype(float)
    size_weight = np.array([factorial(t) * factorial(d - 1 - t) / factorial(d) for t in range(d)])
    phi = np.empty((n_leaves, 2 ** d, d))
    for j in range(d):
        # Coefficients in s of prod over the others of (kept + present * s): sums over coalitions by size.
        poly = np.zeros((n_leaves, 2 ** d, d))
        poly[:, :, 0] = 1.0
        for k in range(d):
            if k != j:
                grown = poly * kept[:, k, None, None]
                grown[:, :, 1:] += poly[:, :, :-1] * bits[None, :, k, None]
                poly = grown
        phi[:, :, j] = value[:, None] * (bits[None, :, j] - kept[:, j, None]) * (poly @ size_weight)
    return phi


def attributions(leaves: dict[str, np.ndarray], x: np.ndarray) -> tuple[float, np.ndarray]:
    """(base value, Shapley values [rows, features]); base plus the row sum is the ensemble's prediction."""
    d = x.shape[1]
    phi = np.zeros(x.shape)
    for i in range(0, len(leaves["value"]), LEAF_CHUNK):
        part = slice(i, i + LEAF_CHUNK)
        table = _pattern_values(leaves["value"][part], leaves["kept"][part])
        code = np.zeros((len(x), table.shape[0]), dtype=np.int64)
        for j in range(d):
            inside = (x[:, j, None] > leaves["low"][None, part, j]) & (x[:, j, None] <= leaves["high"][None, part, j])
            code |= inside.astype(np.int64) << j
        for leaf in range(table.shape[0]):
            phi += table[leaf, code[:, leaf]]
    return float((leaves["value"] * leaves["kept"].prod(axis=1)).sum()), phi
