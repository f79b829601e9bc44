"""Penalised fits of all penalties and folds side by side.

A pass over the entities brings the gradient of every fit that is not settled,
as products of one small matrix per fold with each piece of the table. The
curvature is rare: the first one is that of the full fit at each penalty, which
the left-out folds share, as they hold nearly the same rows. Fits that need
more get their own. Where a fit starts decides only how many passes it takes;
it ends when its conditions hold on all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np

from waveline.operators.path_steps import TOLERANCE, PathFit, descend, entity_effects_at, scales, start

#: Gradient passes with one curvature, and curvatures at most.
PASSES, CURVATURES = 8, 25
#: Fits that move go on to this share of the tolerance, as the last steps gain most, but not for ever.
AIM, AIMED_CURVATURES = 0.05, 4
#: Own curvatures of a pass.
CURVED_AT_ONCE = 128
FIRST_DAMPING, LEAST_DAMPING, MOST_DAMPING = 1e-7, 1e-9, 1e3
#: Share of a step that is tried after one that went too far.
SHORTER = 0.3
#: Rounding of an objective, in variances of the response.
SLACK = 1e-11
#: Sweeps of a step; the passes that follow mend what is left.
ROUNDS = 12


def slopes(penalties: np.ndarray, thetas: np.ndarray, train: np.ndarray, held: np.ndarray | None, base: np.ndarray, rows: float, alpha: float) -> np.ndarray:
    """Per fit, over the entities of ``train``: gain, four sums of the errors as in ``answer``, pull on each column."""
    n = train[:, :1]
    share = n / rows
    deviation = np.sqrt(np.maximum(share * (1 - share), 0.0))
    limit = rows * deviation * (penalties * alpha)
    size = np.where(n > 0, n + rows * deviation**2 * (penalties * (1 - alpha)), 1.0)
    residual = train[:, -1:] - train[:, :-1] @ thetas.T
    able = (n > 0) & (deviation > 0) & ~base[:, None]
    excess = np.where(able, np.maximum(np.abs(residual) - limit, 0.0), 0.0)
    effect = np.sign(residual) * excess / size
    square = effect**2
    sums = np.zeros((len(penalties), 5))
    sums[:, 0] = np.sum(excess**2 / size, axis=0) / 2
    sums[:, 1] = np.sum(effect * residual, axis=0)
    sums[:, 2] = n[:, 0] @ square
    if held is not None:
        sums[:, 3] = np.sum(effect * (held[:, -1:] - held[:, :-1] @ thetas.T), axis=0)
        sums[:, 4] = held[:, 0] @ square
    return np.hstack([sums, effect.T @ train[:, :-1]])


def curvature(penalty: float, theta: np.ndarray, train: np.ndarray, base: np.ndarray, rows: float, alpha: float) -> np.ndarray:
    """What the effects of the active entities of ``train`` take from the products."""
    _, active, _, _, _, size = entity_effects_at(train, theta, rows, penalty, alpha, base)
    z = train[active, :-1]
    return (z / size[active, None]).T @ z


#: Asks for sums per fold: penalties and coefficients of its fits.
AskSlopes = Callable[[dict[int, tuple[np.ndarray, np.ndarray]]], dict[int, np.ndarray]]
#: Asks for the curvature of fits, each a fold, penalty and coefficients.
AskCurvatures = Callable[[list[tuple[int, float, np.ndarray]]], list[np.ndarray]]


@dataclass
class _Side:
    """Numbers of one fold that all of its fits share."""

    products: np.ndarray
    held: np.ndarray | None
    n: float = field(init=False)
    s: np.ndarray = field(init=False)
    usable: np.ndarray = field(init=False)
    scale: np.ndarray = field(init=False)
    unit: float = field(init=False)

    def __post_init__(self) -> None:
        self.n = self.products[0, 0]
        self.s = scales(self.products)
        self.usable = self.s > 0
        self.scale = np.where(self.usable, self.s, 1.0)
        self.usable[0] = True
        self.unit = float(np.sqrt(max(self.products[-1, -1] / self.n - (self.products[-1, 0] / self.n) ** 2, 1e-300)))


@dataclass
class _Fit:
    """One fit: the best point so far, and the one that is tried next."""

    left_out: int
    at: int
    penalty: float
    theta: np.ndarray
    tried: np.ndarray
    cost: float = np.inf
    slope: np.ndarray | None = None
    damping: float = FIRST_DAMPING
    found: PathFit | None = None
    #: What is left of a step that went too far, and the share of it.
    step: np.ndarray | None = None
    length: float = 1.0

    def learn(self, taken: bool) -> None:
        """A step that went too far is cut; a cut one that served asks for more damping."""
        if not taken:
            self.step, self.length = (self.tried - self.theta) * SHORTER, self.length * SHORTER
            return
        self.damping = max(self.damping / 10, LEAST_DAMPING) if self.length == 1 else min(self.damping * 2, MOST_DAMPING)
        self.step, self.length = None, 1.0


def _rss(x: np.ndarray, p: np.ndarray) -> float:
    return float(p[-1, -1] - 2 * x @ p[:-1, -1] + x @ p[:-1, :-1] @ x)


def _judge(fit: _Fit, side: _Side, sums: np.ndarray, alpha: float) -> bool:
    """Take the tried point if it is no worse; tells whether it was."""
    theta, l1, l2 = fit.tried, fit.penalty * alpha, fit.penalty * (1 - alpha)
    rss = _rss(theta, side.products)
    weighed = theta * side.s
    cost = (rss / 2 - sums[0]) / side.n + l1 * np.abs(weighed).sum() + l2 / 2 * (weighed**2).sum()
    if not cost <= fit.cost + SLACK * side.unit**2:
        return False
    slope = (side.products[:-1, :-1] @ theta - side.products[:-1, -1] + sums[5:]) / side.n / side.scale
    full = slope + l2 * weighed
    off = np.where(theta != 0, np.abs(full + l1 * np.sign(theta)), np.maximum(np.abs(full) - l1, 0.0))
    violation = max(float(np.max(off[1:][side.usable[1:]], initial=0.0)), abs(float(slope[0])))
    test = _rss(theta, side.held) - 2 * sums[3] + sums[4] if side.held is not None else float("nan")
    fit.theta, fit.cost, fit.slope = theta, float(cost), slope
    fit.found = PathFit(fit.penalty, theta, float(rss - 2 * sums[1] + sums[2]), float(test), violation / side.unit, violation <= TOLERANCE * side.unit)
    return True


def _move(fits: list[_Fit], sides: dict[int, _Side], h: dict[tuple[int, int], np.ndarray], alpha: float) -> None:
    """Each fit tries the least point of its quadratic model, or what is left of the step there."""
    for f in fits:
        if f.step is not None:
            f.tried = f.theta + f.step
    fits = [f for f in fits if f.step is None]
    for left_out in sorted({f.left_out for f in fits}):
        side = sides[left_out]
        own = [f for f in fits if f.left_out == left_out]
        outer = np.outer(side.usable, side.usable)
        inner, pulls, ends = [], [], []
        for f in own:
            m = np.where(outer, h[f.left_out, f.at], 0.0) + f.damping * np.diag(side.usable.astype(float))
            c = m @ (f.theta * side.scale) - np.where(side.usable, f.slope, 0.0)
            ends.append((m, c))
            inner.append(m[1:, 1:] - np.outer(m[1:, 0], m[0, 1:]) / m[0, 0])
            pulls.append(c[1:] - m[1:, 0] * c[0] / m[0, 0])
        size = np.array([f.penalty for f in own])
        at = np.array([(f.theta * side.scale)[1:] for f in own])
        # In units of the response, so that tolerances mean the same.
        found = descend(np.array(inner), np.array(pulls) / side.unit, at / side.unit, size * alpha / side.unit, size * (1 - alpha), ROUNDS) * side.unit
        for f, (m, c), u in zip(own, ends, found, strict=True):
            u = np.concatenate([[(c[0] - m[0, 1:] @ u) / m[0, 0]], u])
            f.tried = u / side.scale
            f.tried[np.abs(u) < 1e-13 * side.unit] = 0.0


def fit_paths(
    training: dict[int, np.ndarray],
    held: dict[int, np.ndarray | None],
    penalties: Sequence[float],
    alpha: float,
    starts: dict[int, list[np.ndarray]],
    full: int,
    ask_slopes: AskSlopes,
    ask_curvatures: AskCurvatures,
) -> dict[int, list[PathFit]]:
    """Fits of every fold at every penalty; ``full`` names the fold that leaves no row out."""
    sides = {f: _Side(p, held[f]) for f, p in training.items()}
    fits = [_Fit(f, i, p, starts[f][i], starts[f][i]) for f in sides for i, p in enumerate(penalties)]
    if not fits:
        return {f: [] for f in sides}

    def look(open_: list[_Fit]) -> dict[tuple[int, int], bool]:
        by_fold = {f: [x for x in open_ if x.left_out == f] for f in sides}
        sums = ask_slopes({f: (np.array([x.penalty for x in own]), np.array([x.tried for x in own])) for f, own in by_fold.items() if own})
        return {(f, x.at): _judge(x, sides[f], sums[f][i], alpha) for f, own in by_fold.items() for i, x in enumerate(own)}

    def curved(some: list[_Fit]) -> dict[tuple[int, int], np.ndarray]:
        out = {}
        for first in range(0, len(some), CURVED_AT_ONCE):
            part = some[first : first + CURVED_AT_ONCE]
            for x, taken in zip(part, ask_curvatures([(x.left_out, x.penalty, x.theta) for x in part]), strict=True):
                side = sides[x.left_out]
                out[x.left_out, x.at] = (side.products[:-1, :-1] - taken) / side.n / np.outer(side.scale, side.scale)
        return out

    # A start that is worse than the empty model at its penalty is of no use.
    look(fits)
    for x in fits:
        x.tried = start(training[x.left_out])
    look([x for x in fits if not x.found.settled])
    open_ = [x for x in fits if not x.found.settled]
    for turn in range(CURVATURES):
        if not open_:
            break
        if turn == 0:
            of = curved([x for x in fits if x.left_out == full])
            raw = {i: of[full, i] * np.outer(sides[full].scale, sides[full].scale) for i in range(len(penalties))}
            h = {(x.left_out, x.at): raw[x.at] / np.outer(sides[x.left_out].scale, sides[x.left_out].scale) for x in open_}
        else:
            h = curved(open_)
            if turn == 1:
                for x in open_:
                    x.step, x.length = None, 1.0
        for _ in range(PASSES):
            before = {(x.left_out, x.at): x.found.violation for x in open_}
            _move(open_, sides, h, alpha)
            taken = look(open_)
            for x in open_:
                x.learn(taken[x.left_out, x.at])
            slow = [x for x in open_ if x.step is None and x.found.violation > 0.5 * before[x.left_out, x.at]]
            goal = TOLERANCE * (AIM if turn < AIMED_CURVATURES else 1.0)
            open_ = [x for x in open_ if x.found.violation > goal]
            if not open_ or len(slow) > 0.7 * len(open_):
                break
    out: dict[int, list[PathFit]] = {f: [] for f in sides}
    for x in fits:
        out[x.left_out].append(x.found)
    return out
