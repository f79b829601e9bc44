"""Steps along a penalised path, from products and sums alone.

``fit_path`` is written as a generator: it asks for sums over entities and goes
on with the answer. Who asks does not know whether a table in memory or a pass
over the cluster answers, so both give the same fits.

For each penalty it starts from the fit before. Columns that cannot matter yet
are left out by the sequential strong rule and come back if their condition is
violated. A step minimises a damped quadratic model on the columns in use; the
objective along the step is known exactly, so its best length is too.
"""

from __future__ import annotations

import math
from collections.abc import Generator, Sequence
from dataclasses import dataclass

import numpy as np

MAX_ROUNDS = 200
SWEEPS_PER_ROUND = 4
MOST_STEPS = 100
SMALLEST_PIVOT = 1e-9
#: Largest violation of an optimality condition, in standard deviations of the response.
TOLERANCE = 1e-6
#: Columns of the quadratic subproblem may enter down to this.
KKT_TOLERANCE = 1e-7
FIRST_DAMPING, LEAST_DAMPING, MOST_DAMPING = 1e-4, 1e-9, 1e3
LENGTHS = np.concatenate([[4.0, 2.0], 0.5 ** np.arange(12)])


@dataclass(frozen=True)
class Ask:
    """Sums over entities at ``theta``: the curvature on ``columns``, or the gains along ``direction``."""

    penalty: float
    theta: np.ndarray
    columns: np.ndarray | None = None
    direction: np.ndarray | None = None


@dataclass(frozen=True)
class PathFit:
    penalty: float
    theta: np.ndarray
    train_rss: float
    test_rss: float
    violation: float
    settled: bool


def entity_effects_at(train: np.ndarray, theta: np.ndarray, rows: float, penalty: float, alpha: float, base: np.ndarray):
    """Entity effects at given shared coefficients, and what they rest on."""
    n = train[:, 0]
    share = n / rows
    deviation = np.sqrt(np.maximum(share * (1 - share), 0.0))
    limit = rows * penalty * alpha * deviation
    size = n + rows * penalty * (1 - alpha) * deviation**2
    residual = train[:, -1] - train[:, :-1] @ theta
    able = (n > 0) & (deviation > 0) & ~base
    active = able & (np.abs(residual) > limit)
    shrunk = np.where(active, np.sign(residual) * (np.abs(residual) - limit), 0.0)
    effect = np.divide(shrunk, size, out=np.zeros_like(shrunk), where=size > 0)
    return effect, active, able, residual, limit, size


def answer(ask: Ask, train: np.ndarray, held: np.ndarray | None, base: np.ndarray, rows: float, alpha: float) -> np.ndarray:
    """The sums that ``ask`` wants, over the entities of ``train``; they may be added over parts.

    Curvature: gain, two sums for the training error, two for the left-out
    error, the pull on each column, the curvature row by row.
    """
    effect, active, able, residual, limit, size = entity_effects_at(train, ask.theta, rows, ask.penalty, alpha, base)
    if ask.direction is not None:
        along = residual[able, None] - (train[able, :-1] @ ask.direction)[:, None] * LENGTHS
        return np.sum(np.maximum(np.abs(along) - limit[able, None], 0.0) ** 2 / size[able, None], axis=0) / 2
    z, s = train[np.ix_(active, ask.columns)], size[active]
    gain = np.sum((np.abs(residual[active]) - limit[active]) ** 2 / s) / 2
    errors = [effect @ residual, np.sum(effect**2 * train[:, 0]), 0.0, 0.0]
    if held is not None:
        errors[2:] = effect @ (held[:, -1] - held[:, :-1] @ ask.theta), np.sum(effect**2 * held[:, 0])
    return np.concatenate([[gain], errors, effect @ train[:, :-1], ((z / s[:, None]).T @ z).ravel()])


def scales(products: np.ndarray) -> np.ndarray:
    """Standard deviation of each shared column (0 for the intercept)."""
    n = products[0, 0]
    mean = products[0, :-1] / n
    variance = np.diag(products)[:-1] / n - mean**2
    return np.sqrt(np.where(variance > 1e-12 * np.maximum(np.diag(products)[:-1] / n, 1e-300), variance, 0.0))


def start(products: np.ndarray) -> np.ndarray:
    theta = np.zeros(len(products) - 1)
    theta[0] = products[0, -1] / products[0, 0]
    return theta


def _settle(h: np.ndarray, c: np.ndarray, u: np.ndarray, l1: float, l2: float) -> tuple[np.ndarray, bool]:
    """Solve one problem exactly on the columns in use.

    Where a coefficient would change its sign it is stopped at zero. The flag
    tells whether no other column wants to enter.
    """
    u = u.copy()
    while u.any():
        used = np.flatnonzero(u)
        signs = np.sign(u[used])
        block = h[np.ix_(used, used)] + (l2 + 1e-12) * np.eye(len(used))
        target = np.linalg.solve(block, c[used] - l1 * signs)
        crossing = np.flatnonzero(np.sign(target) != signs)
        if len(crossing) == 0:
            u[used] = target
            break
        reach = u[used][crossing] / (u[used][crossing] - target[crossing])
        first = int(np.argmin(reach))
        u[used] += reach[first] * (target - u[used])
        u[used[crossing[first]]] = 0.0
    pull = np.abs(c - h @ u)[(u == 0) & (np.diag(h) > SMALLEST_PIVOT)]
    return u, bool(np.max(pull, initial=0.0) <= l1 + KKT_TOLERANCE)


def descend(h: np.ndarray, c: np.ndarray, u: np.ndarray, l1: np.ndarray, l2: np.ndarray, rounds: int = MAX_ROUNDS) -> np.ndarray:
    """Coordinate descent on many small problems side by side.

    Minimises u'Hu/2 - c'u + l1 |u| + l2 u^2/2 per problem. A few sweeps find
    the columns in use; the exact solution on those ends the search.
    """
    u = u.copy()
    diagonal = np.einsum("mii->mi", h)
    usable = diagonal > SMALLEST_PIVOT
    open_ = np.arange(len(u))
    for _ in range(rounds):
        ho, uo, lo, ridge = h[open_], u[open_], l1[open_], l2[open_]
        gradient = c[open_] - np.einsum("mij,mj->mi", ho, uo)
        for _ in range(SWEEPS_PER_ROUND):
            for j in range(u.shape[1]):
                size, ok = diagonal[open_, j], usable[open_, j]
                pull = gradient[:, j] + size * uo[:, j]
                new = np.sign(pull) * np.maximum(np.abs(pull) - lo, 0.0) / np.where(ok, size + ridge, 1.0)
                step = np.where(ok, new - uo[:, j], 0.0)
                if step.any():
                    gradient -= ho[:, j, :] * step[:, None]
                    uo[:, j] += step
        left = []
        for i, at in enumerate(open_):
            u[at], settled = _settle(h[at], c[at], uo[i], l1[at], l2[at])
            if not settled:
                left.append(at)
        if not left:
            break
        open_ = np.array(left)
    return u


def _model_minimum(h: np.ndarray, slope: np.ndarray, u: np.ndarray, l1: float, l2: float, unit: float) -> np.ndarray:
    """Where the quadratic model at ``u`` is least; the first coordinate is free of penalty."""
    c = h @ u - slope
    if len(u) == 1:
        return c / h[0, 0]
    inner = h[1:, 1:] - np.outer(h[1:, 0], h[0, 1:]) / h[0, 0]
    pull = c[1:] - h[1:, 0] * c[0] / h[0, 0]
    one = lambda x: np.array([x])
    # In units of the response, so that tolerances mean the same.
    found = descend(inner[None], pull[None] / unit, u[None, 1:] / unit, one(l1 / unit), one(l2))[0] * unit
    return np.concatenate([[(c[0] - h[0, 1:] @ found) / h[0, 0]], found])


def fit_path(
    products: np.ndarray, held: np.ndarray | None, penalties: Sequence[float], alpha: float
) -> Generator[Ask, np.ndarray, list[PathFit]]:
    """Fits along decreasing penalties, asking for the sums that they need.

    ``products`` are those of the training rows with the response last, ``held``
    those of the rows left out.
    """
    n, width = products[0, 0], len(products) - 1
    h0, c0, yy = products[:-1, :-1], products[:-1, -1], products[-1, -1]
    s = scales(products)
    usable = s > 0
    scale = np.where(usable, s, 1.0)
    unit = math.sqrt(max(yy / n - (c0[0] / n) ** 2, 1e-300))
    theta = start(products)
    slope = (h0 @ theta - c0) / n / scale
    out: list[PathFit] = []
    before = penalties[0] if len(penalties) else 0.0

    def rss(x: np.ndarray, p: np.ndarray) -> float:
        return p[-1, -1] - 2 * x @ p[:-1, -1] + x @ p[:-1, :-1] @ x

    for penalty in penalties:
        l1, l2 = penalty * alpha, penalty * (1 - alpha)
        damping = FIRST_DAMPING
        chosen = usable & (np.abs(slope) >= alpha * (2 * penalty - before))
        fit = None
        for _ in range(MOST_STEPS):
            columns = np.concatenate([[0], np.flatnonzero(usable & (chosen | (theta != 0)))])
            sums = yield Ask(penalty, theta, columns=columns)
            gain, errors, pull, taken = sums[0], sums[1:5], sums[5 : 5 + width], sums[5 + width :].reshape(len(columns), -1)
            slope = (h0 @ theta - c0 + pull) / n / scale
            full = slope + l2 * s * theta
            off = np.where(theta != 0, np.abs(full + l1 * np.sign(theta)), np.maximum(np.abs(full) - l1, 0.0))
            violation = max(float(np.max(off[usable], initial=0.0)), abs(float(slope[0])))
            test = rss(theta, held) - 2 * errors[2] + errors[3] if held is not None else math.nan
            fit = PathFit(penalty, theta, float(rss(theta, products) - 2 * errors[0] + errors[1]), float(test), violation / unit, violation <= TOLERANCE * unit)
            if fit.settled or damping > MOST_DAMPING:
                break
            chosen |= off > 0
            h = (h0[np.ix_(columns, columns)] - taken) / n / np.outer(scale[columns], scale[columns])
            h[np.diag_indices(len(h))] += damping
            u = theta[columns] * scale[columns]
            direction = np.zeros(width)
            direction[columns] = (_model_minimum(h, slope[columns], u, l1, l2, unit) - u) / scale[columns]
            gains = yield Ask(penalty, theta, direction=direction)
            points = theta + LENGTHS[:, None] * direction
            change = LENGTHS * (direction @ (h0 @ theta - c0)) + LENGTHS**2 / 2 * (direction @ h0 @ direction) - (gains - gain)
            cost = l1 * (np.abs(points * s).sum(1) - np.abs(theta * s).sum()) + l2 / 2 * (((points * s) ** 2).sum(1) - ((theta * s) ** 2).sum())
            change = change / n + cost
            best = int(np.argmin(change))
            if change[best] < 0:
                theta = points[best]
                # A full step ends exactly at zero where the model does.
                theta[np.abs(theta * scale) < 1e-13 * unit] = 0.0
            if change[best] >= 0 or LENGTHS[best] < 0.3:
                damping *= 4
            elif LENGTHS[best] >= 1:
                damping = max(damping / 4, LEAST_DAMPING)
        out.append(fit)
        before = penalty
    return out
