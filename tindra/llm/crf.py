"""A linear-chain conditional random field over sparse binary features, in numpy."""

from __future__ import annotations

import numpy as np


class LinearChain:
    """Labels are 0..n-1; a position is the list of its feature names."""

    def __init__(self, labels: int, l2: float = 0.02, rounds: int = 80, rate: float = 0.15) -> None:
        self.labels, self.l2, self.rounds, self.rate = labels, l2, rounds, rate
        self.index: dict[str, int] = {}
        self.weights = np.zeros((1, labels))
        self.steps = np.zeros((labels, labels))
        self.first = np.zeros(labels)

    def _ids(self, positions: list[list[str]]) -> list[list[int]]:
        get = self.index.get
        return [[k for f in features if (k := get(f)) is not None] for features in positions]

    def fit(self, sequences: list[list[list[str]]], labels: list[list[int]], least: int = 2) -> LinearChain:
        """Maximum likelihood with an L2 penalty by full-batch Adam; features that occur less than ``least`` times are dropped.

        All sequences are padded to one length and go through the recursions at once.
        """
        counts: dict[str, int] = {}
        for sequence in sequences:
            for features in sequence:
                for f in features:
                    counts[f] = counts.get(f, 0) + 1
        self.index = {f: k for k, f in enumerate(sorted(f for f, n in counts.items() if n >= least))}
        n, width, height = self.labels, max(map(len, sequences), default=1), len(sequences)
        self.weights = np.zeros((max(len(self.index), 1), n))
        if not height:
            return self
        gold = np.full((height, width), -1)
        row, column = [], []
        for s, (sequence, own) in enumerate(zip(sequences, labels, strict=True)):
            gold[s, : len(own)] = own
            for t, ids in enumerate(self._ids(sequence)):
                row.extend([s * width + t] * len(ids))
                column.extend(ids)
        row, column = np.array(row, dtype=np.int64), np.array(column, dtype=np.int64)
        there = gold >= 0
        lengths = there.sum(1)
        one = np.eye(n)[np.maximum(gold, 0)] * there[..., None]
        real = lambda x, size: np.stack([np.bincount(row if size else column, x[:, k], minlength=size or len(self.index)) for k in range(n)], 1)
        gold_steps = np.einsum("sti,stj->ij", one[:, :-1], one[:, 1:])
        gold_first = one[:, 0].sum(0)
        parameters = [self.weights, self.steps, self.first]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
        for k in range(1, self.rounds + 1):
            scores = real(self.weights[column], height * width).reshape(height, width, n)
            alpha, beta = np.zeros((height, width, n)), np.zeros((height, width, n))
            alpha[:, 0] = scores[:, 0] + self.first
            for t in range(1, width):
                new = scores[:, t] + _logsumexp(alpha[:, t - 1, :, None] + self.steps, 1)
                alpha[:, t] = np.where(there[:, t, None], new, alpha[:, t - 1])
            for t in range(width - 2, -1, -1):
                new = _logsumexp(self.steps + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
                beta[:, t] = np.where(there[:, t + 1, None], new, 0.0)
            norm = _logsumexp(alpha[np.arange(height), lengths - 1], 1)
            belief = np.exp(alpha + beta - norm[:, None, None]) * there[..., None]
            pairs = np.zeros((n, n))
            for t in range(width - 1):
                joint = np.exp(alpha[:, t, :, None] + self.steps + (scores[:, t + 1] + beta[:, t + 1])[:, None, :] - norm[:, None, None])
                pairs += (joint * there[:, t + 1, None, None]).sum(0)
            error = (belief - one).reshape(height * width, n)
            gradients = [real(error[row], 0) + self.l2 * self.weights, pairs - gold_steps + self.l2 * self.steps, belief[:, 0].sum(0) - gold_first + self.l2 * self.first]
            for p, g, (a, b) in zip(parameters, gradients, moments, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= self.rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)
        return self

    def score(self, features: list[str]) -> np.ndarray:
        """What a position's features say for each label."""
        get = self.index.get
        ids = [k for f in features if (k := get(f)) is not None]
        return self.weights[ids].sum(0) if ids else np.zeros(self.labels)

    def decode(self, positions: list[list[str]]) -> list[int]:
        """The most probable labels (Viterbi)."""
        return self.viterbi(np.array([self.score(f) for f in positions]))

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """The most probable labels of a sequence from the scores of its positions."""
        return self.viterbi_all([scores])[0]

    def viterbi_all(self, sequences: list[np.ndarray]) -> list[list[int]]:
        """The most probable labels of many sequences, all of them a step at a time, the long ones first."""
        order = sorted((k for k, x in enumerate(sequences) if len(x)), key=lambda k: -len(sequences[k]))
        result: list[list[int]] = [[] for _ in sequences]
        if not order:
            return result
        lengths = np.array([len(sequences[k]) for k in order])
        width = int(lengths[0])
        scores = np.zeros((width, len(order), self.labels))
        for row, k in enumerate(order):
            scores[: lengths[row], row] = sequences[k]
        active = np.searchsorted(-lengths, -np.arange(1, width + 1), side="right")  # how many have more than t positions
        best = scores[0] + self.first
        back = np.zeros((width, len(order), self.labels), dtype=np.int8)
        for t in range(1, width):
            n = active[t]
            through = best[:n, :, None] + self.steps
            back[t, :n] = through.argmax(1)
            best[:n] = through.max(1) + scores[t, :n]
        path = np.zeros((width, len(order)), dtype=np.int8)
        label, rows = best.argmax(1), np.arange(len(order))
        for t in range(width - 1, -1, -1):
            n = active[t]
            path[t, :n] = label[:n]
            if t:
                label[:n] = back[t, rows[:n], label[:n]]
        for row, k in enumerate(order):
            result[k] = path[: lengths[row], row].tolist()
        return result


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)
