"""Logistic regression by reweighted least squares, one pass per step."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from waveline.operators.design import Design
from waveline.operators.moments import collect_matrices, cross_products, pieces, summed_matrices
from waveline.operators.ols import independent_columns
from waveline.operators.path_steps import descend


@dataclass(frozen=True)
class LogisticFit:
    design: Design
    kept: list[int]
    beta: np.ndarray
    deviance: float
    steps: int
    converged: bool
    rows: int

    def coefficients(self) -> list[tuple[str, float | None]]:
        place = {j: i for i, j in enumerate(self.kept)}
        return [(n, float(self.beta[place[j]]) if j in place else None) for j, n in enumerate(self.design.names)]


def _probability(eta: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))


def _step_sums(design: Design, response: str, beta: np.ndarray | None, keep: list[int] | None):
    """Batch sums at a coefficient vector: X'WX, X'Wz, deviance and rows."""

    def blocks(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        pdf = design.complete(pdf, response)
        x = design.matrix(pdf)
        y = pdf[response].to_numpy(dtype=float)
        if beta is None:
            mu = (y + 0.5) / 2.0
            eta = np.log(mu / (1 - mu))
        else:
            eta = x[:, keep] @ beta
            mu = _probability(eta)
        w = np.maximum(mu * (1 - mu), 1e-12)
        z = eta + (y - mu) / w
        xw = x * w[:, None]
        likelihood = np.where(y > 0.5, mu, 1 - mu)
        deviance = -2.0 * np.log(np.maximum(likelihood, 1e-300)).sum()
        tail = np.zeros((1, x.shape[1] + 1))
        tail[0, :2] = deviance, len(y)
        return {"": np.vstack([np.column_stack([x.T @ xw, xw.T @ z]), tail])}

    return blocks


def fit(
    df: DataFrame, design: Design, response: str, max_steps: int = 25, tolerance: float = 1e-8
) -> LogisticFit:
    """Fit a 0/1 response; ``df`` should be a stored table, it is read per step.

    Aliased columns, found at the first step, get a null coefficient.
    """
    rows = df.select(list(dict.fromkeys([*design.columns, response])))
    beta, keep, last = None, None, None
    for step in range(max_steps + 1):
        sums = collect_matrices(summed_matrices(rows, _step_sums(design, response, beta, keep)))[""]
        hessian, target = sums[:-1, :-1], sums[:-1, -1]
        deviance, n = float(sums[-1, 0]), int(sums[-1, 1])
        if beta is not None and last is not None and abs(deviance - last) < tolerance * (abs(deviance) + 0.1):
            return LogisticFit(design, keep, beta, deviance, step, True, n)
        if keep is None:
            keep = independent_columns(hessian, 1e-11)
        last = deviance if beta is not None else None
        h = hessian[np.ix_(keep, keep)]
        scale = np.sqrt(np.maximum(np.diag(h), 1e-300))
        scaled = h / np.outer(scale, scale)
        beta = np.linalg.lstsq(scaled, target[keep] / scale, rcond=1e-13)[0] / scale
    return LogisticFit(design, keep, beta, last, max_steps, False, n)


def predict(df: DataFrame, fit: LogisticFit, keep: Sequence[str], name: str = "probability") -> DataFrame:
    """The columns to keep with the probability of each row.

    The key travels with its row. The probability is null where a predictor
    is missing.
    """
    design, kept, beta = fit.design, fit.kept, fit.beta
    columns = list(dict.fromkeys([*keep, *design.columns]))
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(name, T.DoubleType())])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches):
            known = design.complete(pdf)
            p = pd.Series(np.nan, index=pdf.index)
            p.loc[known.index] = _probability(design.matrix(known)[:, kept] @ beta)
            yield pdf[list(keep)].assign(**{name: p})

    return df.select(columns).mapInPandas(score, schema)


ALL_ROWS = -1
#: Neighbours on the path that share a curvature, passes with one, and curvatures at most.
NEIGHBOURS, PASSES, CURVATURES = 10, 6, 25
#: Own curvatures of a pass, and rows of a batch that are worked on together.
CURVED_AT_ONCE, ROWS_AT_ONCE = 22, 1_024
#: Largest violation of an optimality condition, as a share of the largest penalty.
SETTLED = 1e-4
#: Added to the curvature, so that directions without any stay bounded, and rounds per step.
FIRST_DAMPING, LEAST_DAMPING, MOST_DAMPING, ROUNDS = 1e-5, 1e-8, 1e3, 12
#: Rounding of an objective.
SLACK = 1e-13


@dataclass(frozen=True)
class PenalisedPath:
    """Log loss on left-out folds and coefficients per penalty.

    ``violations`` are the largest ones of an optimality condition over all folds,
    as a share of the largest penalty.
    """

    design: Design
    penalties: list[float]
    log_loss: list[float]
    betas: list[np.ndarray]
    violations: list[float]
    passes: int
    rows: int

    @property
    def settled(self) -> list[bool]:
        return [v <= SETTLED for v in self.violations]

    def best_fit(self) -> LogisticFit:
        at = int(np.argmin(self.log_loss))
        kept = list(range(len(self.betas[at])))
        return LogisticFit(self.design, kept, self.betas[at], float("nan"), self.passes, self.settled[at], self.rows)


def _pieces(design: Design, response: str, fold: str, pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, slice]]]]:
    """Design and response of a batch in pieces, each sorted by fold, and where each fold lies."""
    pdf = design.complete(pdf, response, fold)
    for first in range(0, len(pdf), ROWS_AT_ONCE):
        piece = pdf.iloc[first : first + ROWS_AT_ONCE].sort_values(fold, kind="stable")
        folds, starts = np.unique(piece[fold].to_numpy(), return_index=True)
        ends = [*starts[1:], len(piece)]
        yield design.matrix(piece), piece[response].to_numpy(dtype=float), [(int(f), slice(a, b)) for f, a, b in zip(folds, starts, ends)]


def _add(found: dict[str, np.ndarray], key: str, matrix: np.ndarray) -> None:
    if key in found:
        found[key] += matrix
    else:
        found[key] = matrix


def _curvatures(design: Design, response: str, fold: str, asks: list[tuple[int, np.ndarray]]):
    """Per left-out fold and coefficients: X'WX of the other rows."""

    def blocks(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        found: dict[str, np.ndarray] = {}
        for x, _, parts in _pieces(design, response, fold, pdf):
            where = dict(parts)
            for i, (left_out, beta) in enumerate(asks):
                mu = _probability(x @ beta)
                w = np.maximum(mu * (1 - mu), 1e-6)
                if left_out in where:
                    w[where[left_out]] = 0.0
                _add(found, str(i), x.T @ (x * w[:, None]))
        return found

    return blocks


def _excess(x: np.ndarray, y: np.ndarray, betas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability less response, and log(1 + exp(eta)), a column per fit."""
    eta = x @ betas.T
    small = np.exp(-np.abs(eta))
    mu = np.where(eta >= 0, 1.0, small) / (1.0 + small)
    return mu - y[:, None], np.maximum(eta, 0.0) + np.log1p(small)


def _slopes(design: Design, response: str, fold: str, asks: dict[int, np.ndarray]):
    """Per left-out fold, a column per fit: X'(mu - y) and log(1 + exp(eta)) of the training rows, then the latter of the others."""
    betas = np.vstack(list(asks.values()))
    ends = np.cumsum([len(b) for b in asks.values()])
    columns = {f: slice(e - len(b), e) for (f, b), e in zip(asks.items(), ends, strict=True)}

    def blocks(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        found: dict[str, np.ndarray] = {}
        for x, y, parts in _pieces(design, response, fold, pdf):
            off, soft = _excess(x, y, betas)
            none = np.zeros((1, len(betas)))
            sums = np.vstack([x.T @ off, soft.sum(axis=0), none])
            for left_out, rows in parts:
                if left_out in columns:
                    at = columns[left_out]
                    held = soft[rows, at].sum(axis=0)
                    sums[:-2, at] -= x[rows].T @ off[rows, at]
                    sums[-2, at] -= held
                    sums[-1, at] += held
            _add(found, "", sums)
        return found

    def split(sums: np.ndarray) -> dict[int, np.ndarray]:
        return {f: sums[:, at] for f, at in columns.items()}

    return blocks, split


def _slopes_by_fold(design: Design, response: str, fold: str, betas: np.ndarray):
    """The sums of ``_slopes`` at the same coefficients for the rows of each fold."""

    def blocks(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        found: dict[str, np.ndarray] = {}
        for x, y, parts in _pieces(design, response, fold, pdf):
            off, soft = _excess(x, y, betas)
            for f, rows in parts:
                _add(found, str(f), np.vstack([x[rows].T @ off[rows], soft[rows].sum(axis=0)]))
        return found

    return blocks


@dataclass
class _Side:
    """What all fits of a fold share: rows, X'y of them and of those left out, and the scale of the columns."""

    n: float
    response: np.ndarray
    held: np.ndarray
    scale: np.ndarray
    usable: np.ndarray
    empty: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, p: np.ndarray, held: np.ndarray | None) -> _Side:
        n = float(p[0, 0])
        variance = np.diag(p)[:-1] / n - (p[0, :-1] / n) ** 2
        usable = variance > 1e-10
        scale = np.sqrt(np.where(usable, variance, 1.0))
        usable[0] = True
        share = min(max(p[0, -1] / n, 1e-6), 1 - 1e-6)
        empty = np.zeros(len(p) - 1)
        empty[0] = np.log(share / (1 - share))
        # The curvature of the empty model is known from the products.
        first = p[:-1, :-1] * (share * (1 - share))
        return cls(n, p[:-1, -1], np.zeros(len(p) - 1) if held is None else held[:-1, -1], scale, usable, empty, first)


@dataclass
class _Problem:
    """One fit, in columns of unit variance: its fold, place on the path, best coefficients and those tried next."""

    left_out: int
    at: int
    u: np.ndarray
    tried: np.ndarray
    cost: float = np.inf
    slope: np.ndarray | None = None
    violation: float = np.inf
    loss: float = np.nan
    damping: float = FIRST_DAMPING

    def judge(self, side: _Side, sums: np.ndarray, penalty: float, alpha: float) -> bool:
        """Take the tried coefficients if they are no worse; tells whether they were."""
        u, l1, l2 = self.tried, penalty * alpha, penalty * (1 - alpha)
        beta = u / side.scale
        cost = (sums[-2] - beta @ side.response) / side.n + l1 * np.abs(u[1:]).sum() + l2 / 2 * (u[1:] ** 2).sum()
        if not cost <= self.cost + SLACK:
            return False
        slope = np.where(side.usable, sums[:-2] / side.scale / side.n, 0.0)
        full = slope + l2 * np.where(np.arange(len(u)) > 0, u, 0.0)
        off = np.where(u != 0, np.abs(full + l1 * np.sign(u)), np.maximum(np.abs(full) - l1, 0.0))
        self.u, self.cost, self.slope = u, float(cost), slope
        self.violation = float(max(np.max(off[1:], initial=0.0), abs(full[0])))
        self.loss = float(sums[-1] - beta @ side.held)
        return True


def penalised_path(
    df: DataFrame,
    design: Design,
    response: str,
    alpha: float,
    fold: str,
    penalties: Sequence[float] | None = None,
    count: int = 100,
) -> PenalisedPath:
    """Elastic-net logistic fits for all penalties and left-out folds.

    The objective is the mean log loss plus the penalty of the lasso module.
    Without ``penalties`` there are ``count``, down from the one at which the
    empty model is best. A pass over the (stored) rows brings the gradients of
    all fits that are not settled. First all rows are fitted at all penalties,
    from the empty model and its curvature; the folds start there, with the same
    curvature. Fits that need more get a curvature of their own, which
    neighbours on the path share.
    """
    rows = df.select(list(dict.fromkeys([*design.columns, response, fold])))
    products = {int(k): v for k, v in collect_matrices(cross_products(rows, design, response, fold)).items()}
    total = sum(products.values())
    folds = sorted(products)
    sides = {ALL_ROWS: _Side.of(total, None)} | {f: _Side.of(total - products[f], products[f]) for f in folds}
    whole = sides[ALL_ROWS]
    pull = np.abs(total[:-1, -1] - total[0, -1] / total[0, 0] * total[:-1, 0]) / whole.n / whole.scale
    top = float(np.max(pull[1:][whole.usable[1:]], initial=1e-12)) / max(alpha, 1e-3)
    if penalties is None:
        penalties = np.geomspace(top, top * (1e-4 if whole.n > len(total) else 1e-2), count)
    ordered = np.array(sorted(map(float, penalties), reverse=True))
    tolerance = SETTLED * max(alpha, 1e-3) * top
    passes = 0

    def look(open_: list[_Problem]) -> None:
        nonlocal passes
        by_fold = {f: own for f in sides if (own := [p for p in open_ if p.left_out == f])}
        blocks, split = _slopes(design, response, fold, {f: np.array([p.tried / sides[f].scale for p in own]) for f, own in by_fold.items()})
        sums = split(collect_matrices(summed_matrices(rows, blocks))[""])
        passes += 1
        for f, own in by_fold.items():
            for i, p in enumerate(own):
                if p.judge(sides[f], sums[f][:, i], ordered[p.at], alpha):
                    p.damping = max(p.damping / 10, LEAST_DAMPING)
                else:
                    p.damping = min(max(p.damping, 1e-5) * 10, MOST_DAMPING)

    def curved(open_: list[_Problem]) -> dict[tuple[int, int], np.ndarray]:
        """X'WX for each fit, that of the first of its neighbours."""
        lead: dict[tuple[int, int], _Problem] = {}
        for p in open_:
            lead.setdefault((p.left_out, p.at // NEIGHBOURS), p)
        asks = [(p.left_out, p.u / sides[p.left_out].scale) for p in lead.values()]
        out = []
        for first in range(0, len(asks), CURVED_AT_ONCE):
            part = asks[first : first + CURVED_AT_ONCE]
            found = collect_matrices(summed_matrices(rows, _curvatures(design, response, fold, part)))
            out += [found[str(i)] for i in range(len(part))]
        shared = dict(zip(lead, out, strict=True))
        return {(p.left_out, p.at): shared[p.left_out, p.at // NEIGHBOURS] for p in open_}

    def settle(open_: list[_Problem], h: dict[tuple[int, int], np.ndarray]) -> None:
        for turn in range(CURVATURES):
            open_ = [p for p in open_ if p.violation > tolerance]
            if not open_:
                break
            if turn:
                h.update(curved(open_))
            for _ in range(PASSES):
                before = [p.violation for p in open_]
                _move(open_, sides, h, ordered, alpha)
                look(open_)
                slow = sum(p.violation > 0.5 * b for p, b in zip(open_, before, strict=True))
                open_ = [p for p in open_ if p.violation > tolerance]
                if not open_ or slow > 0.7 * len(open_):
                    break

    at = range(len(ordered))
    full = [_Problem(ALL_ROWS, k, whole.empty, whole.empty) for k in at]
    look(full)
    h = {(ALL_ROWS, k): whole.first for k in at}
    settle(full, h)
    parts = collect_matrices(summed_matrices(rows, _slopes_by_fold(design, response, fold, np.array([p.u / whole.scale for p in full]))))
    passes += 1
    everything = sum(parts.values())
    left_out = []
    for f in folds:
        rest = everything - parts[str(f)]
        for k, p in enumerate(full):
            own = p.u / whole.scale * sides[f].scale
            left_out.append(_Problem(f, k, own, own))
            left_out[-1].judge(sides[f], np.append(rest[:, k], parts[str(f)][-1, k]), ordered[k], alpha)
    settle(left_out, {(f, k): h[ALL_ROWS, k] * (sides[f].n / whole.n) for f in folds for k in at})
    done = {(p.left_out, p.at): p for p in [*full, *left_out]}
    losses = [sum(done[f, k].loss for f in folds) / whole.n for k in at]
    worst = [max(done[f, k].violation for f in sides) / (max(alpha, 1e-3) * top) for k in at]
    fits = [done[ALL_ROWS, k].u / whole.scale for k in at]
    return PenalisedPath(design, ordered.tolist(), losses, fits, worst, passes, int(round(whole.n)))


def _move(problems: list[_Problem], sides: dict[int, _Side], h: dict[tuple[int, int], np.ndarray], penalties: np.ndarray, alpha: float) -> None:
    """Every problem tries the least point of its quadratic model."""
    for left_out, side in sides.items():
        own = [p for p in problems if p.left_out == left_out]
        if not own:
            continue
        outer = np.where(np.outer(side.usable, side.usable), 1.0 / np.outer(side.scale, side.scale) / side.n, 0.0)
        inner, pulls, ends = [], [], []
        for p in own:
            m = h[p.left_out, p.at] * outer + p.damping * np.diag(side.usable.astype(float))
            c = m @ p.u - p.slope
            ends.append((m[0], c[0]))
            inner.append(m[1:, 1:] - np.outer(m[1:, 0], m[0, 1:]) / m[0, 0])
            pulls.append(c[1:] - m[1:, 0] * c[0] / m[0, 0])
        size = np.array([penalties[p.at] for p in own])
        # In units of the largest penalty, so that tolerances of the subproblem mean the same.
        unit = float(penalties[0]) * max(alpha, 1e-3)
        found = descend(np.array(inner), np.array(pulls) / unit, np.array([p.u[1:] for p in own]) / unit, size * alpha / unit, size * (1 - alpha), ROUNDS) * unit
        for p, (row, c), u in zip(own, ends, found, strict=True):
            p.tried = np.concatenate([[(c - row[1:] @ u) / row[0]], u])
