"""Trust-region Newton for linear models over packed rows, many columns at once.

The state is a block [feature, column] with a last row of intercepts. A step is one pass that adds up losses and gradients
of all columns, or products with their Hessians; the driver only does vector arithmetic. The columns of ``svm_fit`` are
problems of their own (a class in a fold) that advance together, those of ``softmax_fit`` are one problem.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from caseloom.operators.blocks import Block, Blocks

# Step control of the trust region, as is usual: shares of the predicted decrease, and factors of the radius.
ACCEPT, POOR, GOOD = 1e-4, 0.25, 0.75
SHRINK, HALVE, GROW = 0.25, 0.5, 4.0
INNER = 0.1  # conjugate gradients end at this share of the gradient


@dataclass
class Fit:
    """Coefficients [feature, column] with intercepts last, and how the solver ended."""

    weights: np.ndarray
    loss: np.ndarray  # the objective of each column, its penalty included
    steps: int
    passes: int
    converged: bool

    def info(self) -> dict:
        return {"loss": [float(v) for v in self.loss], "steps": self.steps, "passes": self.passes, "converged": self.converged}


def newton(
    loss: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], product: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray],
    shape: tuple[int, int], penalised: np.ndarray, joint: bool, max_iter: int, tolerance: float,
) -> Fit:
    """Least loss plus half the squares of ``penalised`` rows.

    A column has converged when half its squared gradient is at most ``tolerance`` times its objective: where all rows
    are penalised, the objective then is that near to its least value. ``loss`` and ``product`` are told which columns
    are asked for and give these; columns that have ended cost nothing.
    """
    passes = 0
    weight = penalised[:, None].astype("f8")

    def dot(a, b):
        each = np.einsum("ij,ij->j", a, b)
        return np.full_like(each, each.sum()) if joint else each

    def value(w, asked):
        nonlocal passes
        passes += 1
        f, g = np.zeros(shape[1]), np.zeros(shape)
        f[asked], g[:, asked] = loss(w, asked)
        f = np.full_like(f, f.sum()) if joint else f
        return f + 0.5 * dot(weight * w, w), g + weight * w

    w = np.zeros(shape)
    f, g = value(w, np.arange(shape[1]))
    radius = np.sqrt(dot(g, g))
    done = 0.5 * dot(g, g) <= tolerance * f
    steps, stuck = 0, np.zeros(shape[1], bool)
    while not (done | stuck).all() and steps < max_iter:
        active = ~(done | stuck)
        s = np.zeros(shape)
        r = np.where(active, -g, 0.0)
        d = r.copy()
        rr = dot(r, r)
        goal = INNER * np.sqrt(dot(g, g))
        turning = active & (np.sqrt(rr) > goal)
        while turning.any():
            passes += 1
            asked = np.flatnonzero(turning)
            hd = weight * np.where(turning, d, 0.0)
            hd[:, asked] += product(w, d, asked)
            curve = dot(d, hd)
            alpha = np.where(turning, rr / np.where(curve > 0, curve, 1.0), 0.0)
            trial = s + alpha * d
            outside = turning & ((dot(trial, trial) > radius**2) | (curve <= 0))
            if outside.any():
                sd, ss, dd = dot(s, d), dot(s, s), np.maximum(dot(d, d), 1e-300)
                root = np.sqrt(np.maximum(sd**2 + dd * (radius**2 - ss), 0.0))
                alpha = np.where(outside, (root - sd) / dd, alpha)
                trial = s + alpha * d
            s = np.where(turning, trial, s)
            r = r - alpha * np.where(turning, hd, 0.0)
            new = dot(r, r)
            turning = turning & ~outside & (np.sqrt(new) > goal)
            d = np.where(turning, r + new / np.where(rr > 0, rr, 1.0) * d, d)
            rr = new
        gs = dot(g, s)
        expected = -0.5 * (gs - dot(s, r))
        f_new, g_new = value(w + s, np.flatnonzero(active))
        decrease = f - f_new
        length = np.sqrt(dot(s, s))
        if steps == 0:
            radius = np.minimum(radius, length)
        bend = f_new - f - gs
        factor = np.where(bend <= 0, GROW, np.maximum(SHRINK, -0.5 * gs / np.where(bend > 0, bend, 1.0)))
        near, far = np.maximum(factor, SHRINK) * length, factor * length
        radius = np.where(decrease < ACCEPT * expected, np.minimum(near, HALVE * radius), np.where(
            decrease < POOR * expected, np.maximum(SHRINK * radius, np.minimum(far, HALVE * radius)), np.where(
                decrease < GOOD * expected, np.maximum(SHRINK * radius, np.minimum(far, GROW * radius)),
                np.maximum(radius, np.minimum(far, GROW * radius)))))
        taken = active & (decrease > ACCEPT * expected)
        w = np.where(taken, w + s, w)
        f, g = np.where(taken, f_new, f), np.where(taken, g_new, g)
        done |= 0.5 * dot(g, g) <= tolerance * f
        stuck |= active & (np.abs(decrease) <= 1e-12 * np.abs(f)) & (np.abs(expected) <= 1e-12 * np.abs(f))
        steps += 1
    return Fit(w, f[:1] if joint else f, steps, passes, bool((done | stuck).all()))


def _both(block: Block, state: dict) -> tuple[np.ndarray, np.ndarray]:
    """Rows times weights and times a direction, which stand side by side, with intercepts."""
    z = block.times(state["both"]) + state["both"][-1]
    return z[:, : z.shape[1] // 2], z[:, z.shape[1] // 2 :]


def _hinge(block: Block, state: dict, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sign, cost and slack of each row in each column; rows of a column's own fold cost nothing."""
    hit = block.y[:, None] == state["classes"]
    sign = np.where(hit, 1.0, -1.0)
    cost = np.where(hit, state["hit_cost"], state["cost"]) * (block.fold[:, None] != state["folds"])
    return sign, cost, 1.0 - sign * z


def _hinge_loss(block: Block, state: dict) -> np.ndarray:
    w = state["w"]
    sign, cost, slack = _hinge(block, state, block.times(w) + w[-1])
    part = cost * np.maximum(slack, 0.0)
    return _flat((part * slack.clip(0)).sum(axis=0), _with_bias(block, -2.0 * part * sign, w))


def _hinge_product(block: Block, state: dict) -> np.ndarray:
    z, q = _both(block, state)
    _, cost, slack = _hinge(block, state, z)
    return _with_bias(block, 2.0 * cost * (slack > 0) * q, state["both"]).ravel()


def _with_bias(block: Block, r: np.ndarray, like: np.ndarray) -> np.ndarray:
    out = block.transposed_times(r, len(like))
    out[-1] += r.sum(axis=0)
    return out


def _flat(losses: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    return np.concatenate([losses, gradient.ravel()])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _softmax_loss(block: Block, state: dict) -> np.ndarray:
    w = state["w"]
    z = block.times(w) + w[-1]
    y = block.y.astype("i8")
    top = z.max(axis=1)
    each = np.log(np.exp(z - top[:, None]).sum(axis=1)) + top - z[np.arange(block.n), y]
    r = _softmax(z)
    r[np.arange(block.n), y] -= 1.0
    losses = np.zeros(w.shape[1])
    losses[0] = (block.w * each).sum()
    return _flat(losses, _with_bias(block, block.w[:, None] * r, w))


def _softmax_product(block: Block, state: dict) -> np.ndarray:
    z, q = _both(block, state)
    p = _softmax(z)
    return _with_bias(block, block.w[:, None] * p * (q - (p * q).sum(axis=1, keepdims=True)), state["both"]).ravel()


def _fit(blocks: Blocks, k: int, losses, products, fixed: dict, penalised, joint, max_iter, tolerance) -> Fit:
    """``fixed`` has an entry for each column in each of its arrays."""
    shape = (blocks.width + 1, k)

    def state(asked, name, *matrices):
        return {n: v[asked] for n, v in fixed.items()} | {name: np.ascontiguousarray(np.hstack([v[:, asked] for v in matrices]))}

    def loss(w, asked):
        n = len(asked)
        total = blocks.add_up(losses, state(asked, "w", w), n + shape[0] * n)
        return total[:n], total[n:].reshape(shape[0], n)

    def product(w, v, asked):
        return blocks.add_up(products, state(asked, "both", w, v), shape[0] * len(asked)).reshape(shape[0], len(asked))

    return newton(loss, product, shape, penalised, joint, max_iter, tolerance)


def svm_fit(
    blocks: Blocks, classes: np.ndarray, folds: np.ndarray, hit_cost: np.ndarray, cost: np.ndarray, max_iter: int = 100, tolerance: float = 1e-5
) -> Fit:
    """Linear machines with squared hinge loss: column j tells class ``classes[j]`` from the rest on rows not in fold ``folds[j]``.

    ``blocks`` has y and fold. Intercepts are penalised like coefficients.
    """
    fixed = {"classes": classes.astype("f8"), "folds": folds.astype("f8"), "hit_cost": hit_cost, "cost": cost}
    return _fit(blocks, len(classes), _hinge_loss, _hinge_product, fixed, np.ones(blocks.width + 1), False, max_iter, tolerance)


def softmax_fit(blocks: Blocks, k: int, c: float = 1.0, max_iter: int = 1000, tolerance: float = 1e-6) -> Fit:
    """Multinomial logistic regression of ``k`` classes; ``blocks`` has y and w. Intercepts are free."""
    penalised = np.full(blocks.width + 1, 1.0 / c)
    penalised[-1] = 0.0
    return _fit(blocks, k, _softmax_loss, _softmax_product, {}, penalised, True, max_iter, tolerance)


def _sigmoid_sums(block: Block, state: dict) -> np.ndarray:
    """Loss, gradient and Hessian of slope and offset of each column, on the rows of its own fold."""
    w = state["w"]
    margin = block.times(w) + w[-1]
    own = block.fold[:, None] == state["folds"]
    target = np.where(block.y[:, None] == state["classes"], state["high"], state["low"])
    z = state["a"] * margin + state["b"]
    p = 1.0 / (1.0 + np.exp(np.minimum(z, 700.0)))
    each = np.maximum(z, 0.0) + np.log1p(np.exp(-np.abs(z))) - (1.0 - target) * z
    g, h = (target - p) * own, p * (1.0 - p) * own
    parts = [each * own, g * margin, g, h * margin**2, h * margin, h]
    return np.concatenate([x.sum(axis=0) for x in parts])


def sigmoid_fit(
    blocks: Blocks, weights: np.ndarray, classes: np.ndarray, folds: np.ndarray, hits: np.ndarray, others: np.ndarray,
    max_iter: int = 50, tolerance: float = 1e-7,
) -> tuple[np.ndarray, np.ndarray, bool]:
    """Slope a and offset b of 1/(1 + exp(a m + b)) for each column's margins m on the rows of its fold, and whether all converged.

    Targets are drawn in from 0 and 1 by the numbers of ``hits`` and ``others``, as Platt proposed.
    """
    a, b = np.zeros(len(classes)), np.log((others + 1.0) / (hits + 1.0))
    da, db = np.zeros_like(a), np.zeros_like(a)
    loss, done = np.full(len(a), np.inf), np.zeros(len(a), bool)
    fixed = {
        "w": weights, "classes": classes.astype("f8"), "folds": folds.astype("f8"), "high": (hits + 1.0) / (hits + 2.0), "low": 1.0 / (others + 2.0)
    }
    for _ in range(max_iter):
        total = blocks.add_up(_sigmoid_sums, {**fixed, "a": a + da, "b": b + db}, 6 * len(a)).reshape(6, -1)
        new, ga, gb, haa, hab, hbb = total
        worse = ~done & (new > loss + 1e-12 * np.abs(loss))
        better = ~done & ~worse
        a, b, loss = np.where(better, a + da, a), np.where(better, b + db, b), np.where(better, new, loss)
        haa, hbb = haa + 1e-12, hbb + 1e-12
        det = haa * hbb - hab**2
        det = np.where(np.abs(det) > 1e-300, det, 1e-300)
        step_a, step_b = -(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det
        da = np.where(done, 0.0, np.where(worse, da / 2, step_a))
        db = np.where(done, 0.0, np.where(worse, db / 2, step_b))
        done |= np.abs(da) + np.abs(db) < tolerance
        da, db = np.where(done, 0.0, da), np.where(done, 0.0, db)
        if done.all():
            break
    return a, b, bool(done.all())
