"""Fits over one table: how many there are, what is written, and that pruning leaves the other trials alone."""

import numpy as np
import pandas as pd
import pytest

from barloom.operators import training as tr

FEATURES = ["x", "z"]
SPACE = {"regParam": [0.0, 0.01, 0.1, 1.0, 10.0, 100.0], "maxIter": [5]}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 300
    x, z = rng.normal(size=n), rng.normal(size=n)
    y = (x + 0.5 * z + rng.normal(size=n) > 0).astype(float)
    return spark.createDataFrame(pd.DataFrame({"row_idx": np.arange(n), "x": x, "z": z, "gone": np.nan, "y": y, "w": 1.0}))


@pytest.fixture
def fits(monkeypatch):
    made, plain = [], tr.fit
    monkeypatch.setattr(tr, "fit", lambda train, features, params: made.append(params) or plain(train, features, params))
    return made


def test_pruned_trials_stop_at_their_first_fold(rows, fits, monkeypatch):
    got = {r.trial: r for r in tr.search(rows, FEATURES, SPACE, 6, 1, 4, 0.5).collect()}
    pruned = [t for t, r in got.items() if r.state == "pruned"]
    assert pruned and len(fits) == 6 + (6 - len(pruned)) * 3 < 6 * 4
    monkeypatch.setattr(tr, "MEDIAN_FROM", 99)                        # nothing is pruned
    whole = {r.trial: r for r in tr.search(rows, FEATURES, SPACE, 6, 1, 4, 0.5).collect()}
    for t, r in got.items():
        if t not in pruned:
            assert r.params == whole[t].params and abs(r.objective - whole[t].objective) < 1e-9
    assert tr.best_trial(tr.search(rows, FEATURES, SPACE, 6, 1, 4, 0.5)).count() == 1


def test_rows_are_written_once(rows, monkeypatch):
    """What a search writes does not grow with its folds, its trials or its contexts' candidates."""
    written, plain = [], tr.settle
    monkeypatch.setattr(tr, "settle", lambda df: written.append(out := plain(df)) or out)
    sizes = {}
    for folds in (2, 8):
        written.clear()
        tr.evaluate({"all": (rows, FEATURES)}, {"a": {"maxIter": 2}, "b": {"maxIter": 3}}, folds, 0.5)
        sizes[folds] = (len(written), sum(w.count() for w in written))
    assert sizes[2][0] == sizes[8][0] and sizes[8][1] <= 2 * rows.count()


def test_folds_train_before_they_test(rows):
    data = tr.fold_rows(rows, [*FEATURES, "gone"], 4, 0.5)
    assert data.folds == [0, 1, 2, 3] and all(live == FEATURES for live in data.live.values())
    for n in data.folds:
        train, test = (np.array([r.row_idx for r in data.part(n, role).collect()]) for role in ("train", "test"))
        assert train.max() < test.min() and len(test) == 50 and len(train) == 100
    with pytest.raises(ValueError):
        tr.fold_rows(rows, FEATURES, 63, 0.5)


def test_decision_rows_only(rows):
    marked = rows.withColumn("decision", rows["row_idx"] % 5 == 4)
    data = tr.fold_rows(marked, FEATURES, 2, 0.5, "decision", "train_decision")
    assert {r.row_idx % 5 for r in data.part(0, "train").collect()} == {4} and len({r.row_idx % 5 for r in data.part(0, "test").collect()}) == 5
