"""The older dense network on sparse rows: rectified layers with dropout, small steps, averaged over tasks.

Each task trains a copy of the network on its own rows in mini-batches (Adam); after a share of an epoch the copies are
averaged by their rows, as one sum over the tasks. The first layer multiplies a plain matrix of the features that a batch
holds, and its gradient is computed for these alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.config import LABEL, SEED
from caseloom.operators.blocks import Block, Blocks

BATCH = 64
SPREAD = 256  # rows that are scored at a time
MOVED = 32  # rows of weights that are moved at a time, so that they stay in a core's cache
DECAY, DECAY_SQUARE, TINY = 0.9, 0.999, 1e-7  # usual values of Adam


class Network:
    """Weights of the layers in one vector; ``shape`` is (features, hidden ..., classes)."""

    def __init__(self, shape: tuple[int, ...], flat: np.ndarray):
        self.shape, self.flat = shape, flat
        self.layers = []
        at = 0
        for a, b in zip(shape[:-1], shape[1:], strict=True):
            self.layers.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
            at += a * b + b

    @classmethod
    def fresh(cls, shape: tuple[int, ...], seed: int) -> Network:
        rng = np.random.default_rng(seed)
        parts = []
        for a, b in zip(shape[:-1], shape[1:], strict=True):
            bound = np.sqrt(6.0 / (a + b))
            parts += [rng.uniform(-bound, bound, a * b), np.zeros(b)]
        return cls(shape, np.concatenate(parts))

    def forward(self, starts: np.ndarray, idx: np.ndarray, val: np.ndarray, n: int, keep: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """Outputs of the hidden layers, and the probabilities. ``keep``: what dropout multiplies each hidden layer by."""
        w, b = self.layers[0]
        z = np.zeros((n, w.shape[1]))
        ends = np.append(starts[1:], len(idx))
        for first in range(0, n, SPREAD):
            stop = min(first + SPREAD, n)
            part = slice(int(starts[first]), int(ends[stop - 1]))
            asked, x = spread(starts[first:stop] - starts[first], idx[part], val[part], stop - first)
            z[first:stop] = x @ w[asked]
        return self.upper(z + b, keep)

    def upper(self, z: np.ndarray, keep: list[np.ndarray] | None) -> list[np.ndarray]:
        """The same from what enters the first hidden layer."""
        out = []
        for k, (w, b) in enumerate(self.layers[1:]):
            h = np.maximum(z, 0.0)
            out.append(h if keep is None else h * keep[k])
            z = out[-1] @ w + b
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return [*out, e / e.sum(axis=1, keepdims=True)]


def spread(starts: np.ndarray, idx: np.ndarray, val: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The different features of some rows, and a plain matrix [row, feature] of them."""
    asked, place = np.unique(idx, return_inverse=True)
    x = np.zeros(n * len(asked))
    np.add.at(x, np.repeat(np.arange(n) * len(asked), np.diff(np.append(starts, len(idx)))) + place, val)
    return asked, x.reshape(n, len(asked))


def gradients(net: Network, starts: np.ndarray, idx: np.ndarray, val: np.ndarray, y: np.ndarray, keep: list[np.ndarray] | None):
    """(features asked, gradient of their weights, gradient of the first offsets, gradients of the other layers), of the mean loss."""
    n = len(y)
    asked, x = spread(starts, idx, val, n)
    w, b = net.layers[0]
    out = net.upper(x @ w[asked] + b, keep)
    delta = out[-1].copy()
    delta[np.arange(n), y] -= 1.0
    delta /= n
    rest = []
    for k in range(len(net.layers) - 1, 0, -1):
        w, _ = net.layers[k]
        rest.append((out[k - 1].T @ delta, delta.sum(axis=0)))
        delta = (delta @ w.T) * (out[k - 1] > 0)
        if keep is not None:
            delta = delta * keep[k - 1]
    return asked, x.T @ delta, delta.sum(axis=0), rest[::-1]


class Adam:
    """Steps of a task's own copy. First-layer rows move only when asked for."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.t = net, rate, 0
        self.m, self.v = [Network(net.shape, np.zeros_like(net.flat)) for _ in range(2)]

    def _move(self, value, m, v, g, where=None):
        scale = self.rate * np.sqrt(1 - DECAY_SQUARE**self.t) / (1 - DECAY**self.t)
        for a in range(0, len(g), MOVED):
            part = slice(a, a + MOVED) if where is None else where[a : a + MOVED]
            step = g[a : a + MOVED]
            new_m, new_v = m[part] * DECAY, v[part] * DECAY_SQUARE
            new_m += (1 - DECAY) * step
            new_v += (1 - DECAY_SQUARE) * step * step
            m[part], v[part] = new_m, new_v
            np.sqrt(new_v, out=new_v)
            new_v += TINY
            new_m *= scale
            new_m /= new_v
            value[part] -= new_m

    def step(self, asked, first_layer, first_offset, rest) -> None:
        self.t += 1
        trios = list(zip(self.net.layers, self.m.layers, self.v.layers, strict=True))
        (w, b), (mw, mb), (vw, vb) = trios[0]
        self._move(w, mw, vw, first_layer, asked)
        self._move(b, mb, vb, first_offset)
        for ((w, b), (mw, mb), (vw, vb)), (gw, gb) in zip(trios[1:], rest, strict=True):
            self._move(w, mw, vw, gw)
            self._move(b, mb, vb, gb)


def _trained(block: Block, state: dict) -> np.ndarray:
    """Weights after a pass over part of a block's rows, times their number, and that number."""
    net = Network(state["shape"], state["flat"].copy())
    rng = np.random.default_rng([state["seed"], state["turn"], block.n, int(block.idx.sum()) & 0x7FFFFFFF])
    order = np.random.default_rng([state["seed"], state["epoch"], block.n]).permutation(block.n)
    mine = order[state["part"] :: state["parts"]]
    ends = np.append(block.starts[1:], len(block.idx))
    adam, hidden = Adam(net, state["rate"]), state["shape"][1:-1]
    for a in range(0, len(mine), BATCH):
        rows = mine[a : a + BATCH]
        lengths = ends[rows] - block.starts[rows]
        entries = np.repeat(block.starts[rows] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        keep = [(rng.random((len(rows), width)) >= p) / (1 - p) for width, p in zip(hidden, state["dropout"], strict=True)]
        adam.step(*gradients(net, np.cumsum(lengths) - lengths, block.idx[entries], block.val[entries], block.y[rows].astype("i8"), keep))
    return np.append(net.flat * len(mine), len(mine))


def train_network(
    train: DataFrame, labels: list[str], label: str = LABEL, hidden: tuple[int, ...] = (512, 256), epochs: int = 5, dropout: tuple[float, ...] = (0.5, 0.3),
    rate: float = 1e-3, averages: int = 1, seed: int = SEED,
) -> Network:
    """A network for ``labels``; ``dropout`` is the share left out of each hidden layer, ``averages`` is how often an epoch the copies are averaged."""
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label)) - 1
    blocks = Blocks(train, {"y": place})
    shape = (blocks.width, *hidden, len(labels))
    net = Network.fresh(shape, seed)
    for epoch in range(epochs):
        for part in range(averages):
            state = {
                "shape": shape, "flat": net.flat, "seed": seed, "turn": epoch * averages + part, "epoch": epoch, "part": part, "parts": averages,
                "dropout": dropout, "rate": rate,
            }
            total = blocks.add_up(_trained, state, len(net.flat) + 1)
            if total[-1]:
                net = Network(shape, total[:-1] / total[-1])
    blocks.release()
    return net


def network_scores(shared: tuple, starts: np.ndarray, idx: np.ndarray, val: np.ndarray) -> np.ndarray:
    """Probabilities [row, class] of (shape, weights)."""
    return Network(*shared).forward(starts, idx, val, len(starts))[-1]
