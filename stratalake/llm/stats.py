"""Small models that several operators fit on the driver, from bounded tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(design: np.ndarray, label: np.ndarray, weight: np.ndarray, penalty: float) -> np.ndarray:
    """Penalised maximum likelihood by Newton's method, each step halved until the likelihood rises; labels may be probabilities."""

    def loss(w: np.ndarray) -> float:
        x = design @ w
        return float(weight @ (np.logaddexp(0, x) - label * x) + penalty / 2 * w @ w)

    w = np.zeros(design.shape[1])
    now = loss(w)
    for _ in range(100):
        p = sigmoid(design @ w)
        gradient = design.T @ (weight * (p - label)) + penalty * w
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        scale = 1.0
        while (after := loss(w - scale * step)) > now and scale > 1e-9:
            scale /= 2
        if after > now or np.abs(scale * step).max() < 1e-9:
            break
        w, now = w - scale * step, after
    return w


@dataclass
class Node:
    """A split (go left where feature <= bound) or, without children, the share of positive rows."""

    share: float
    feature: int = -1
    bound: float = 0.0
    left: Node | None = None
    right: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1) -> Node:
    """A decision tree by Gini impurity; the first best feature and bound win ties."""
    node = Node(float(y.mean()))
    if depth == 0 or node.share in (0.0, 1.0):
        return node
    best, parent = None, node.share * (1 - node.share) * len(y)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for bound in (values[:-1] + values[1:]) / 2:
            left = x[:, f] <= bound
            n = int(left.sum())
            if min(n, len(y) - n) < least:
                continue
            a, b = y[left].mean(), y[~left].mean()
            cost = a * (1 - a) * n + b * (1 - b) * (len(y) - n)
            if cost < parent - 1e-12 and (best is None or cost < best[0] - 1e-12):
                best = (cost, f, bound, left)
    if best is None:
        return node
    _, node.feature, node.bound, left = best
    node.left, node.right = grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least)
    return node


def shares(node: Node, x: np.ndarray) -> np.ndarray:
    """The share of positive rows in each row's leaf."""
    if node.left is None:
        return np.full(len(x), node.share)
    left = x[:, node.feature] <= node.bound
    out = np.empty(len(x))
    out[left], out[~left] = shares(node.left, x[left]), shares(node.right, x[~left])
    return out
