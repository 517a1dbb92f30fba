"""The forecast of one region worked out with numpy, for comparison."""

from __future__ import annotations

from collections import defaultdict
from datetime import date

import numpy as np


def shift(month: date, k: int) -> date:
    total = month.year * 12 + month.month - 1 + k
    return date(total // 12, total % 12 + 1, 1)


def gap(later: date, earlier: date) -> int:
    return (later.year - earlier.year) * 12 + later.month - earlier.month


def row(month, origin):
    t = 2 * np.pi * (month.month - 1) / 12
    harmonics = [f(k * t) for k in (1, 2, 3) for f in (np.sin, np.cos)]
    return [1.0, gap(month, origin) / 12, *harmonics]


class Series:
    def __init__(self, months, values):
        self.months, self.values = list(months), np.array(values, float)

    def last(self, n):
        return Series(self.months[-n:], self.values[-n:])

    def regression(self, targets):
        past = self.last(180)
        origin = past.months[0]
        x = np.array([row(m, origin) for m in past.months])
        ages = np.arange(len(past.months))[::-1]
        w = 0.5 ** (ages / 36)
        ridge = np.diag([0.0] + [0.12] * 7)
        beta = np.linalg.solve((x * w[:, None]).T @ x + ridge, x.T @ (w * np.log1p(past.values)))
        return np.clip(np.expm1(np.array([row(m, origin) for m in targets]) @ beta), 0, None)

    def seasonal(self, targets):
        level = 1.0
        if len(self.values) >= 24 and self.values[-24:-12].mean() > 0:
            level = min(1.35, max(0.65, self.values[-12:].mean() / self.values[-24:-12].mean()))
        result = []
        for target in targets:
            same = [v for m, v in zip(self.months, self.values) if m.month == target.month][-5:]
            base = (sum(v * (i + 1) for i, v in enumerate(same)) / sum(range(1, len(same) + 1))
                    if same else self.values[-12:].mean())
            result.append(max(0.0, base * level))
        return np.array(result)


def volume(months, values, first, horizon):
    """Model name, holdout error, and (estimate, lower, upper) per future month."""
    whole = Series(months, values)
    window = whole.last(180)
    name, error = "regression", None
    if len(window.months) >= 48:
        learn = Series(window.months[:-12], window.values[:-12])
        held, truth = window.months[-12:], window.values[-12:]
        errors = {m: np.abs(truth - getattr(learn, m)(held)).mean()
                  for m in ("regression", "seasonal")}
        name = "seasonal" if errors["seasonal"] < errors["regression"] else "regression"
        error = errors[name]
    future = [shift(first, k) for k in range(horizon)]
    estimate = getattr(whole, name)(future)
    if name == "seasonal":
        residual = window.values[12:] - window.values[:-12]
    else:
        residual = window.values - whole.regression(window.months)
    mad = np.median(np.abs(residual - np.median(residual)))
    scale = max(1.0, 1.4826 * mad, 0.65 * np.sqrt((residual**2).mean()))
    spread = 1.28 * scale * np.sqrt(1 + np.arange(1, horizon + 1) / 12)
    whole_number = lambda v: [int(round(max(0.0, x))) for x in v]
    return name, error, list(zip(whole_number(estimate), whole_number(estimate - spread),
                                 whole_number(estimate + spread)))


def shares(occurrences):
    """Share per category of (month, category, place, weight) tuples; places do not count."""
    totals = defaultdict(float)
    for (_, category), weight in {(m, c): w for m, c, _, w in occurrences}.items():
        totals[category] += weight
    whole = sum(totals.values())
    return {c: v / whole for c, v in totals.items()}


def scores(occurrences, target):
    """The score of every category for a calendar month, and the occurrences of it and around it."""
    near_months = {(target - 2) % 12 + 1, target % 12 + 1}
    exact = [o for o in occurrences if o[0].month == target]
    near = [o for o in occurrences if o[0].month in near_months]
    years = len({o[0].year for o in exact})
    a, b = next(w for least, w in [(8, (0.7, 0.2)), (4, (0.55, 0.25)), (1, (0.4, 0.3)),
                                   (0, (0.0, 0.45))] if years >= least)
    parts = [(exact, a), (near, b if near else 0.0)]
    parts.append((occurrences, 1 - sum(w for _, w in parts)))
    score = defaultdict(float)
    for group, weight in parts:
        for name, share in shares(group).items() if group else ():
            score[name] += weight * share
    whole = sum(score.values())
    return {name: value / whole for name, value in score.items()}, exact, near


def category(occurrences, target):
    """Likely category, support, confidence and places for a calendar month."""
    if not occurrences:
        return "Not enough history", 0.0, "Limited historical pattern", "Region-wide"
    score, exact, near = scores(occurrences, target)
    best = min(score, key=lambda c: (-round(score[c], 12), c))
    support = 100 * score[best]
    seen = len({o[0].year for o in exact if o[1] == best})
    strength = ("Strong" if support >= 50 and seen >= 5
                else "Moderate" if support >= 32 and seen >= 3 else "Limited")
    rows = [(o, 1.0) for o in exact if o[1] == best] + [(o, 0.35) for o in near if o[1] == best]
    rows = rows or [(o, 0.15) for o in occurrences if o[1] == best]
    places = defaultdict(float)
    for (_, _, place, weight), factor in rows:
        if place != "Region-wide":
            places[place] += weight * factor
    top = sorted(places, key=lambda p: (-round(places[p], 12), p))[:3]
    return best, round(support, 1), f"{strength} historical pattern", ", ".join(top) or "Region-wide"
