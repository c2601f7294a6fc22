"""Linear-chain conditional random fields in numpy, many chains at a time.

A chain is a run of positions with a score for each label (``emissions``, one row per
position); ``trans[a, b]`` is the score of label b after label a and ``start`` that of
the first label. Chains of like length are padded to blocks and take their steps
together, so a long chain costs its own length and short ones no Python loop each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK_CELLS = 1 << 20


def blocks(lengths: np.ndarray, cells: int = BLOCK_CELLS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chains in blocks of like length: their numbers, the rows of their positions padded
    with row 0, and which cells are positions. Empty chains are in no block."""
    firsts = np.cumsum(lengths) - lengths
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    begin = 0
    while begin < len(order):
        end = begin + 1
        # Chains of up to a quarter more than the shortest, as long as the block is small enough.
        most = lengths[order[begin]] * 5 // 4 + 4
        end = begin + int(np.searchsorted(lengths[order[begin:]], most, side="right"))
        end = min(end, begin + max(1, cells // int(most)))
        chosen = order[begin:end]
        width = int(lengths[chosen].max())
        used = np.arange(width) < lengths[chosen, None]
        rows = np.where(used, firsts[chosen, None] + np.arange(width), 0)
        yield chosen, rows, used
        begin = end


def viterbi(emissions: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The best label of each position, rows of ``emissions`` in chain order."""
    best = np.zeros(len(emissions), dtype=np.int64)
    for chosen, rows, used in blocks(lengths):
        scores = emissions[rows]
        count, width, labels = scores.shape
        score, back = start + scores[:, 0], np.zeros((width, count, labels), dtype=np.int16)
        for t in range(1, width):
            ways = score[:, :, None] + trans
            back[t] = ways.argmax(axis=1)
            step = np.take_along_axis(ways, back[t][:, None, :].astype(np.int64), axis=1)[:, 0] + scores[:, t]
            score = np.where(used[:, t, None], step, score)
        label, each = score.argmax(axis=1), np.arange(count)
        for t in range(width - 1, -1, -1):
            # Padding keeps the last label until the chain's own end is reached.
            best[rows[:, t][used[:, t]]] = label[used[:, t]]
            label = np.where(used[:, t], back[t][each, label], label)
    return best


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray
                     ) -> tuple[np.ndarray, np.ndarray, float]:
    """Label marginals of each position, expected label pairs, and the log partition sum."""
    marginals = np.zeros_like(emissions, dtype=np.float64)
    pairs, total = np.zeros_like(trans, dtype=np.float64), 0.0
    step = np.exp(trans - trans.max())
    for chosen, rows, used in blocks(lengths):
        scores = emissions[rows]
        count, width, labels = scores.shape
        top = scores.max(axis=2, keepdims=True)
        local = np.where(used[:, :, None], np.exp(scores - top), 1.0)
        ahead, norm = np.zeros_like(local), np.ones((count, width))
        now = np.exp(start - start.max()) * local[:, 0]
        for t in range(width):
            if t:
                now = np.where(used[:, t, None], (ahead[:, t - 1] @ step) * local[:, t], ahead[:, t - 1])
            norm[:, t] = now.sum(axis=1)
            ahead[:, t] = now / norm[:, t, None]
        behind = np.ones((count, labels))
        for t in range(width - 1, -1, -1):
            own = ahead[:, t] * behind
            own /= own.sum(axis=1, keepdims=True)
            marginals[rows[:, t][used[:, t]]] = own[used[:, t]]
            if t:
                inner = behind * local[:, t]
                joint = ahead[:, t - 1][:, :, None] * step * inner[:, None, :]
                joint /= joint.sum(axis=(1, 2), keepdims=True)
                pairs += joint[used[:, t]].sum(axis=0)
                back = inner @ step.T
                behind = np.where(used[:, t, None], back / back.sum(axis=1, keepdims=True), behind)
        total += float((np.log(norm) * used).sum() + (top[:, :, 0] * used).sum())
        total += float(start.max()) * count + trans.max() * float(used[:, 1:].sum())
    return marginals, pairs, total


class Adam:
    """Gradient ascent with the usual running moments; the same steps on every run."""

    def __init__(self, rate: float):
        self.rate, self.turn, self.moments = rate, 0, {}

    def step(self, parameters: dict[str, np.ndarray], gradients: dict[str, np.ndarray]) -> None:
        self.turn += 1
        for name, gradient in gradients.items():
            first, second = self.moments.get(name, (0.0, 0.0))
            first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient ** 2
            self.moments[name] = first, second
            first, second = first / (1 - 0.9 ** self.turn), second / (1 - 0.999 ** self.turn)
            parameters[name] += self.rate * first / (np.sqrt(second) + 1e-8)


def pair_counts(labels: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Observed label pairs, and labels of first positions."""
    firsts = (np.cumsum(lengths) - lengths)[lengths > 0]
    inner = np.ones(len(labels), dtype=bool)
    inner[firsts] = False
    at = np.flatnonzero(inner)
    pairs = np.zeros((size, size))
    np.add.at(pairs, (labels[at - 1], labels[at]), 1.0)
    return pairs, np.bincount(labels[firsts], minlength=size).astype(np.float64)
