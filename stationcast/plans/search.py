"""Search for learner parameters over forward folds (M9): random or guided proposals, bad trials stopped early.

Folds are prepared once and written; every trial fits on them in turn. After a fold a trial is stopped if its mean
score so far lies below the median of the earlier trials' means over as many folds. What runs on the driver are a few
numbers per trial.

Guided proposals model the finished trials: the best quarter and the others each give a density per
parameter, a broad one mixed with one kernel per trial, and of a number of draws from the first the one is
tried whose density among the best is largest against that among the others. The first trials are random.
The same seed gives the same trials for the same scores. Ties go to the earlier trial.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Estimator
from pyspark.sql import DataFrame

from stationcast.operators import metrics, quantiles, scoring, training
from stationcast.plans.training import prepare, time_folds
from stationcast.schemas import FEATURES
from stationcast.session import workspace

STARTUP, DRAWS, BEST_SHARE = 6, 32, 0.25
# A trial is judged against at least so many earlier ones.
LEAST_JUDGES = 4


@dataclass(frozen=True)
class Real:
    """A number between two bounds, drawn evenly, or evenly in its logarithm."""

    low: float
    high: float
    log: bool = False

    def at(self, u: float) -> float:
        if self.log:
            return math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low)))
        return self.low + u * (self.high - self.low)


@dataclass(frozen=True)
class Whole:
    """A whole number between two bounds, both included."""

    low: int
    high: int

    def at(self, u: float) -> int:
        return min(self.high, self.low + int(u * (self.high - self.low + 1)))


@dataclass(frozen=True)
class Choice:
    """One of some values without an order."""

    values: tuple

    def at(self, u: float):
        return self.values[min(len(self.values) - 1, int(u * len(self.values)))]


Space = Mapping[str, Real | Whole | Choice]


@dataclass
class Trial:
    number: int
    place: dict[str, float]  # each parameter's position between 0 and 1
    params: dict
    scores: list[float] = field(default_factory=list)
    stopped: bool = False

    @property
    def score(self) -> float:
        return sum(self.scores) / len(self.scores) if self.scores else -math.inf


def _density(kind, at: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Density at positions ``at`` given trials at ``seen``, one part of it even."""
    if isinstance(kind, Choice):
        n = len(kind.values)
        counts = np.bincount(np.minimum((seen * n).astype(int), n - 1), minlength=n) + 1.0
        return (counts / counts.sum())[np.minimum((at * n).astype(int), n - 1)]
    width = max(0.05, 0.5 / math.sqrt(len(seen) + 1))
    kernels = np.exp(-0.5 * ((at[:, None] - seen[None, :]) / width) ** 2) / (width * math.sqrt(2 * math.pi))
    return (1.0 + kernels.sum(axis=1)) / (len(seen) + 1)


def _drawn(kind, seen: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Positions drawn from the density above."""
    even = rng.random(n)
    if isinstance(kind, Choice):
        size = len(kind.values)
        counts = np.bincount(np.minimum((seen * size).astype(int), size - 1), minlength=size) + 1.0
        return (rng.choice(size, n, p=counts / counts.sum()) + 0.5) / size
    width = max(0.05, 0.5 / math.sqrt(len(seen) + 1))
    centre = rng.integers(0, len(seen) + 1, n)
    near = np.clip(seen[np.minimum(centre, len(seen) - 1)] + width * rng.standard_normal(n), 0, 1 - 1e-9)
    return np.where(centre == len(seen), even, near)


def propose(space: Space, done: Sequence[Trial], rng: np.random.Generator, guided: bool) -> dict[str, float]:
    """Positions of the next trial."""
    if not guided or len(done) < STARTUP:
        return {name: float(rng.random()) for name in space}
    ranked = sorted(done, key=lambda t: (-t.score, t.number))
    n_best = max(2, math.ceil(BEST_SHARE * len(ranked)))
    gain, drawn = np.zeros(DRAWS), {}
    for name, kind in space.items():
        best, rest = (np.array([t.place[name] for t in part]) for part in (ranked[:n_best], ranked[n_best:]))
        drawn[name] = _drawn(kind, best, DRAWS, rng)
        gain += np.log(_density(kind, drawn[name], best)) - np.log(_density(kind, drawn[name], rest))
    pick = int(gain.argmax())
    return {name: float(x[pick]) for name, x in drawn.items()}


def run_trials(
    space: Space, score: Callable[[dict, int], float | None], folds: int, trials: int = 20, guided: bool = True, seed: int = 42, stop_early: bool = True
) -> list[Trial]:
    """Trials in order; ``score(params, fold)`` is called fold by fold, higher is better, None or NaN counts as the worst."""
    rng = np.random.default_rng(seed)
    done: list[Trial] = []
    for number in range(trials):
        place = propose(space, done, rng, guided)
        trial = Trial(number, place, {name: kind.at(place[name]) for name, kind in space.items()})
        for fold in range(folds):
            found = score(trial.params, fold)
            trial.scores.append(-math.inf if found is None or found != found else float(found))
            means = [sum(t.scores[: fold + 1]) / (fold + 1) for t in done if len(t.scores) > fold]
            if stop_early and fold + 1 < folds and len(means) >= LEAST_JUDGES and trial.score < float(np.median(means)):
                trial.stopped = True
                break
        done.append(trial)
    return done


def best_trial(done: Sequence[Trial]) -> Trial:
    """The best of the trials that saw all folds."""
    return min((t for t in done if not t.stopped), key=lambda t: (-t.score, t.number))


def search_space(
    readings: DataFrame, space: Space, learner: Callable[[dict], Estimator], trials: int = 20, folds: int = 3, guided: bool = True,
    seed: int = 42, stop_early: bool = True,
) -> DataFrame:
    """``trial, params, folds, f1, stopped``: weighted F1 of every trial over the forward folds it saw (M9).

    ``learner`` makes an estimator from one trial's parameters.
    """
    spark = readings.sparkSession
    kept = []
    for known, unseen in time_folds(prepare(readings), folds):
        medians = quantiles.median_values(known, FEATURES)
        pair = []
        for name, rows in (("known", training.impute(training.with_weights(known), medians)), ("unseen", training.impute(unseen, medians))):
            path = workspace(spark, name)
            rows.write.parquet(path)
            pair.append(spark.read.schema(rows.schema).parquet(path))
        kept.append(pair)

    def score(params: dict, fold: int) -> float | None:
        known, unseen = kept[fold]
        made = scoring.forecaster(training.fit(known, learner(params)))(unseen)
        found = metrics.overall_scores(made.withColumnRenamed("aqi_next", "actual")).select("f1").first()
        return found["f1"] if found else None

    done = run_trials(space, score, folds, trials, guided, seed, stop_early)
    rows = [(t.number, json.dumps(t.params), len(t.scores), None if math.isinf(t.score) else t.score, t.stopped) for t in done]
    return spark.createDataFrame(rows, "trial int, params string, folds int, f1 double, stopped boolean")


def forest_space() -> Space:
    """Bounds for ``random_forest``."""
    return {"trees": Whole(20, 120), "depth": Whole(3, 10)}
