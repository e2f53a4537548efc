"""A linear-chain conditional random field over words described by small whole numbers.

Training and decoding are numpy over batches of sequences.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Crf:
    """``groups``: number of values of each feature of a word. A word's score for a label is
    the sum of one weight per feature; a pair of neighbouring labels adds ``moves``."""

    groups: tuple[int, ...]
    weights: np.ndarray  # (sum of groups, labels)
    moves: np.ndarray  # (labels, labels)

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.groups)[:-1]])

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """Scores (words, labels) of features (words, groups)."""
        return self.weights[features + self.offsets].sum(axis=-2)

    def certain(self, emissions: np.ndarray) -> np.ndarray:
        """Words that are label 0 in the best path whatever stands around them: no pair of
        moves can make up for what another label would lose there."""
        m = self.moves
        swing = (m[:, None, :] + m.T[None, :, :]) - (m[:, :1].T[0][:, None, None] + m[0][None, :, None])
        most = np.maximum(swing.max(axis=(0, 1)), 0)
        ends = np.maximum(m.max(axis=0) - m[:, 0].min(), m.max(axis=1) - m[0].min())
        slack = np.maximum(most, ends) + 1e-9
        return (emissions[:, :1] > (emissions + slack)[:, 1:]).all(axis=1)


def train(
    features: np.ndarray, labels: np.ndarray, mask: np.ndarray, groups: tuple[int, ...], n_labels: int,
    penalty: float = 0.02, steps: int = 200, rate: float = 0.2,
) -> Crf:
    """Maximises the regularised likelihood of sequences, padded to (sequences, length).

    ``features`` has a last axis of groups, ``mask`` tells real words, which come first. Full
    passes of Adam from zero: the same table gives the same model.
    """
    crf = Crf(groups, np.zeros((sum(groups), n_labels)), np.zeros((n_labels, n_labels)))
    # Words with the same features are scored and added up together.
    kinds, kind_of = np.unique(features[mask] + crf.offsets, axis=0, return_inverse=True)
    order = np.argsort(kind_of, kind="stable")
    starts = np.searchsorted(kind_of[order], np.arange(len(kinds)))
    has = np.zeros((len(kinds), len(crf.weights)))
    np.put_along_axis(has, kinds, 1, axis=1)
    place = np.zeros(mask.shape, np.int64)
    place[mask] = kind_of
    hot = np.eye(n_labels)[labels]
    pairs = mask[:, 1:] & mask[:, :-1]
    want = has.T @ np.add.reduceat(hot[mask][order], starts)
    want_moves = np.einsum("bti,btj->ij", hot[:, :-1] * pairs[..., None], hot[:, 1:])
    n = max(len(features), 1)
    first = [np.zeros_like(crf.weights), np.zeros_like(crf.moves)]
    second = [np.zeros_like(crf.weights), np.zeros_like(crf.moves)]
    for step in range(1, steps + 1):
        node, edge = expectations((has @ crf.weights)[place], crf.moves, mask)
        have = has.T @ np.add.reduceat(node[mask][order], starts)
        for i, (value, gradient) in enumerate(
            ((crf.weights, (want - have) / n), (crf.moves, (want_moves - edge) / n))
        ):
            gradient = gradient - penalty * value / n
            first[i] = 0.9 * first[i] + 0.1 * gradient
            second[i] = 0.99 * second[i] + 0.01 * gradient**2
            scaled = first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
            value += rate * scaled
    return crf


def expectations(e: np.ndarray, moves: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of labels (sequences, length, labels) and expected moves, summed.

    Forward and backward weights are scaled to a sum of one at each word.
    """
    b, t, n = e.shape
    local, step = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(moves - moves.max())
    ahead, back = np.zeros((b, t, n)), np.full((b, t, n), 1 / n)
    ahead[:, 0] = local[:, 0] / local[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, t):
        new = (ahead[:, i - 1] @ step) * local[:, i]
        ahead[:, i] = np.where(mask[:, i, None], new / new.sum(axis=1, keepdims=True), ahead[:, i - 1])
    for i in range(t - 2, -1, -1):
        new = (local[:, i + 1] * back[:, i + 1]) @ step.T
        back[:, i] = np.where(mask[:, i + 1, None], new / new.sum(axis=1, keepdims=True), 1 / n)
    node = ahead * back
    node *= mask[..., None] / node.sum(axis=2, keepdims=True)
    edge = np.zeros((n, n))
    for i in range(1, t):
        before, after = ahead[:, i - 1][mask[:, i]], (local[:, i] * back[:, i])[mask[:, i]]
        total = ((before @ step) * after).sum(axis=1, keepdims=True)
        edge += step * ((before / total).T @ after)
    return node, edge


def viterbi(e: np.ndarray, moves: np.ndarray, lengths: np.ndarray, outer: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best labels (sequences, length) of padded sequences, and by how much their score
    exceeds that of label 0 throughout.

    ``outer`` says whether a word of label 0 stands before and after each sequence.
    """
    b, t, n = e.shape
    before, after = outer
    score = e[:, 0] + before[:, None] * moves[0]
    zero = score[:, 0].copy()
    came = np.zeros((b, t, n), np.int16)
    for i in range(1, t):
        options = score[:, :, None] + moves
        best = options.argmax(axis=1)
        step = np.take_along_axis(options, best[:, None, :], 1)[:, 0] + e[:, i]
        on = i < lengths
        came[:, i] = np.where(on[:, None], best, np.arange(n))
        score = np.where(on[:, None], step, score)
        zero = np.where(on, zero + moves[0, 0] + e[:, i, 0], zero)
    score = score + after[:, None] * moves[:, 0]
    zero = zero + after * moves[0, 0]
    path = np.zeros((b, t), np.int64)
    path[:, -1] = score.argmax(axis=1)
    for i in range(t - 1, 0, -1):
        path[:, i - 1] = np.take_along_axis(came[:, i], path[:, i, None], 1)[:, 0]
    return path, score.max(axis=1) - zero
