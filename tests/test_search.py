"""Proposals and early stops on known response surfaces; one search with fits."""

import json
import math

import numpy as np
import pytest

from stationcast.operators import training
from stationcast.plans import search

SPACE = {"rate": search.Real(1e-4, 1.0, log=True), "depth": search.Whole(2, 12), "kind": search.Choice(("a", "b", "c")), "share": search.Real(0.0, 1.0)}
CALLS = []


def surface(params, fold):
    """Best at rate 0.03, depth 7, kind b, share 0.8; folds differ by a constant."""
    CALLS.append(fold)
    far = ((math.log10(params["rate"]) + 1.5) / 4) ** 2 + ((params["depth"] - 7) / 10) ** 2 + (params["share"] - 0.8) ** 2
    return 1 - far - (0.3 if params["kind"] != "b" else 0) - 0.05 * fold


def test_same_seed_same_trials():
    for guided in (True, False):
        a, b, c = (search.run_trials(SPACE, surface, 3, 20, guided, seed) for seed in (1, 1, 2))
        assert [t.params for t in a] == [t.params for t in b] != [t.params for t in c]
        assert [t.scores for t in a] == [t.scores for t in b] and len(a) == 20


def test_proposals_stay_inside_the_space():
    for t in search.run_trials(SPACE, surface, 1, 40):
        assert 1e-4 <= t.params["rate"] <= 1.0 and t.params["depth"] in range(2, 13) and t.params["kind"] in "abc" and 0 <= t.params["share"] < 1


def test_guided_beats_random():
    best = {g: [search.best_trial(search.run_trials(SPACE, surface, 1, 20, g, seed)).score for seed in range(40)] for g in (True, False)}
    assert np.mean(best[True]) > np.mean(best[False]) + 0.02
    assert np.mean(np.array(best[True]) >= np.array(best[False])) > 0.6


def test_bad_trials_stop_early_and_the_best_stays():
    CALLS.clear()
    done = search.run_trials(SPACE, surface, 3, 20, False, 3)
    calls = len(CALLS)
    whole = search.run_trials(SPACE, surface, 3, 20, False, 3, stop_early=False)
    assert calls < 60 == len(CALLS) - calls and any(t.stopped for t in done)
    assert [t.params for t in done] == [t.params for t in whole]
    assert search.best_trial(done).number == search.best_trial(whole).number
    assert all(len(t.scores) == 3 for t in done if not t.stopped)


def test_missing_scores_count_as_the_worst():
    done = search.run_trials(SPACE, lambda p, fold: None if p["kind"] != "b" else float("nan") if p["depth"] > 9 else 0.5, 2, 20)
    assert search.best_trial(done).score == 0.5


def test_search_with_fits(training_frame):
    space = {"trees": search.Whole(2, 4), "depth": search.Whole(1, 3)}
    found = search.search_space(training_frame(3, 60), space, lambda p: training.random_forest(**p), trials=3, folds=2).orderBy("trial").collect()
    assert [r.trial for r in found] == [0, 1, 2] and all(0 <= r.f1 <= 1 and set(json.loads(r.params)) == {"trees", "depth"} for r in found)
    assert found[0].folds == 2 and search.forest_space()["trees"].at(0.999999) == 120
    with pytest.raises(ValueError):
        search.best_trial([])
