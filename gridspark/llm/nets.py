"""What the two recurrent networks share: Adam, windows over texts, inputs of both directions."""

from __future__ import annotations

import numpy as np


class Adam:
    """Adam over a dict of arrays, updated in place."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float = 0.02):
        self.weights, self.rate, self.step = weights, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in weights.items()}

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        scale = min(1.0, 5.0 / (norm + 1e-12))
        for k, g in grads.items():
            g = g * scale
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.01 * (g * g - self.square[k])
            m = self.mean[k] / (1 - 0.9**self.step)
            v = self.square[k] / (1 - 0.99**self.step)
            self.weights[k] -= (self.rate * m / (np.sqrt(v) + 1e-8)).astype(self.weights[k].dtype)


def byte_inputs(table: np.ndarray, x: np.ndarray, step: int, out: np.ndarray) -> None:
    """What the symbols add to the gates at a step; the first half of ``out`` reads from the left, the second from the right."""
    np.take(table[0], x[step], axis=1, out=out[0], mode="clip")
    np.take(table[1], x[len(x) - 1 - step], axis=1, out=out[1], mode="clip")


def input_gradients(grad: np.ndarray, x: np.ndarray, step: int, d: np.ndarray) -> None:
    """Adds a step's gate gradients ``d`` (2, gates, windows) to those of the table, given as (2, symbols, gates)."""
    np.add.at(grad[0], x[step], d[0].T)
    np.add.at(grad[1], x[len(x) - 1 - step], d[1].T)


def window_starts(lengths: np.ndarray, width: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and start of each window; windows cover every position, texts of length 0 have none."""
    counts = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - width) // stride)), 0)
    text = np.repeat(np.arange(len(lengths)), counts)
    first = np.cumsum(counts) - counts
    return text, (np.arange(len(text)) - first[text]) * stride


def cut_windows(symbols: np.ndarray, edges: np.ndarray, text: np.ndarray, start: np.ndarray, width: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """``(width, windows)`` symbols, padded behind the end of a text, and the windows' lengths."""
    size = np.minimum(width, edges[text + 1] - edges[text] - start)
    at = edges[text] + start + np.arange(width)[:, None]
    inside = np.arange(width)[:, None] < size
    return np.where(inside, symbols[np.minimum(at, len(symbols) - 1)], pad), size
