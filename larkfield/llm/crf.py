"""A two-label linear-chain conditional random field in numpy: training and Viterbi decoding."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Crf:
    """Weights: unary (features x 2), transition (2 x 2), start (2). Label 1 is the wanted one."""

    unary: np.ndarray
    transition: np.ndarray
    start: np.ndarray

    def decode(self, x: np.ndarray) -> list[int]:
        """The most likely labels of one sequence; x has a row of features for each element."""
        if not len(x):
            return []
        scores = (x @ self.unary).tolist()
        (t00, t01), (t10, t11) = self.transition.tolist()
        a, b = scores[0][0] + float(self.start[0]), scores[0][1] + float(self.start[1])
        back = []
        for u, v in scores[1:]:
            to_a, to_b = (a + t00 >= b + t10), (a + t01 > b + t11)
            back.append((0 if to_a else 1, 0 if to_b else 1))
            a, b = (a + t00 if to_a else b + t10) + u, (a + t01 if to_b else b + t11) + v
        label = 0 if a > b else 1
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def fit(sequences: list[tuple[np.ndarray, list[int]]], l2: float = 1e-3, steps: int = 200, rate: float = 0.15) -> Crf:
    """Maximises the conditional likelihood with Adam over all sequences at once (padded to the longest)."""
    sequences = [s for s in sequences if len(s[1])]
    n, length, width = len(sequences), max(len(y) for _, y in sequences), sequences[0][0].shape[1]
    x = np.zeros((n, length, width))
    y = np.zeros((n, length), dtype=int)
    mask = np.zeros((n, length))
    for i, (features, labels) in enumerate(sequences):
        x[i, : len(labels)], y[i, : len(labels)], mask[i, : len(labels)] = features, labels, 1
    onehot = np.eye(2)[y] * mask[..., None]
    total = mask.sum()
    seen_unary = np.einsum("nlf,nlk->fk", x, onehot)
    seen_pairs = np.einsum("nli,nlj->ij", onehot[:, :-1], onehot[:, 1:])
    seen_start = onehot[:, 0].sum(0)
    params = [np.zeros((width, 2)), np.zeros((2, 2)), np.zeros(2)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        node, pairs = _marginals(x @ params[0], params[1], params[2], mask)
        grads = [
            (np.einsum("nlf,nlk->fk", x, node) - seen_unary) / total + l2 * params[0],
            (pairs - seen_pairs) / total + l2 * params[1],
            (node[:, 0].sum(0) - seen_start) / total + l2 * params[2],
        ]
        for p, g, (m, v) in zip(params, grads, moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Crf(*params)


def _marginals(unary: np.ndarray, transition: np.ndarray, start: np.ndarray, mask: np.ndarray):
    """Posterior of each label at each element, and the summed posterior of neighbouring labels."""
    n, length, _ = unary.shape
    forward, backward = np.zeros_like(unary), np.zeros_like(unary)
    forward[:, 0] = unary[:, 0] + start
    for i in range(1, length):
        step = np.logaddexp.reduce(forward[:, i - 1, :, None] + transition, axis=1) + unary[:, i]
        forward[:, i] = np.where(mask[:, i, None] > 0, step, forward[:, i - 1])
    for i in range(length - 2, -1, -1):
        step = np.logaddexp.reduce(transition + (unary[:, i + 1] + backward[:, i + 1])[:, None, :], axis=2)
        backward[:, i] = np.where(mask[:, i + 1, None] > 0, step, 0.0)
    log_z = np.logaddexp.reduce(forward[:, -1], axis=1)
    node = np.exp(forward + backward - log_z[:, None, None]) * mask[..., None]
    joint = forward[:, :-1, :, None] + transition + (unary[:, 1:] + backward[:, 1:])[:, :, None, :]
    pairs = (np.exp(joint - log_z[:, None, None, None]) * mask[:, 1:, None, None]).sum((0, 1))
    return node, pairs
