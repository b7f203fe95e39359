"""Curves and areas against direct computation on small random scores."""

import numpy as np
import pytest

from basketlens.operators import scoring


@pytest.fixture(scope="module", params=[0, 1, 2])
def case(request, spark):
    rng = np.random.default_rng(request.param)
    n = [40, 200, 300][request.param]
    y = rng.integers(0, 2, n)
    s = np.round(rng.random(n) * 0.6 + y * 0.2, [1, 2, 6][request.param])
    rows = [(int(a), float(b), int(b > 0.5)) for a, b in zip(y, s)]
    return y, s, spark.createDataFrame(rows, "label int, score double, prediction int")


def points(y, s):
    out = []
    for t in sorted(set(s), reverse=True):
        out.append((t, int(((s >= t) & (y == 1)).sum()), int(((s >= t) & (y == 0)).sum())))
    return out


def test_roc_auc(case):
    y, s, df = case
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    assert scoring.roc_auc(df).first()[0] == pytest.approx(wins / len(pos) / len(neg))


def test_roc_auc_of_billions(spark, monkeypatch):
    """The product of two counts above 3.1e9 does not fit a 64-bit number."""
    steps = spark.createDataFrame(
        [(0.9, 4 * 10**9, 10**9, 4 * 10**9, 10**9), (0.1, 10**9, 3 * 10**9, 5 * 10**9, 4 * 10**9)],
        "score double, pos long, neg long, tp long, fp long",
    )
    monkeypatch.setattr(scoring, "score_steps", lambda *_: steps)
    expected = (1 * 2 + 3 * 4.5) / 20
    assert scoring.roc_auc(steps).first()[0] == pytest.approx(expected)


def test_average_precision(case):
    y, s, df = case
    total, last, area = y.sum(), 0, 0.0
    for _, tp, fp in points(y, s):
        area += (tp - last) / total * tp / (tp + fp)
        last = tp
    assert scoring.average_precision(df).first()[0] == pytest.approx(area)


def test_roc_curve(case):
    y, s, df = case
    full = [(fp / (y == 0).sum(), tp / y.sum(), t) for t, tp, fp in points(y, s)]
    found = sorted(
        map(tuple, scoring.roc_curve(df, drop_intermediate=False).collect()), key=lambda r: -r[2]
    )
    assert found[0] == (0.0, 0.0, float("inf"))
    assert found[1:] == [pytest.approx(p) for p in full]
    thinned = sorted(map(tuple, scoring.roc_curve(df).collect()), key=lambda r: -r[2])
    assert set(thinned) <= set(found)
    assert np.trapezoid([r[1] for r in thinned], [r[0] for r in thinned]) == pytest.approx(
        np.trapezoid([r[1] for r in found], [r[0] for r in found])
    )


def test_pr_curve(case):
    y, s, df = case
    found = sorted(
        map(tuple, scoring.pr_curve(df).collect()), key=lambda r: (r[2] is None, -(r[2] or 0))
    )
    assert found[-1] == (1.0, 0.0, None)
    assert found[:-1] == [
        pytest.approx((tp / (tp + fp), tp / y.sum(), t)) for t, tp, fp in points(y, s)
    ]


def test_report(case):
    y, s, df = case
    p = (s > 0.5).astype(int)
    found = {r["class"]: r for r in scoring.classification_report(df).collect()}
    assert found["accuracy"].f1 == pytest.approx((y == p).mean())
    assert found["accuracy"].precision is None
    assert found["1"].precision == pytest.approx((y[p == 1] == 1).mean())
    assert found["0"].recall == pytest.approx((p[y == 0] == 0).mean())
    assert found["weighted avg"].support == len(y)
    matrix = {(r.actual, r.predicted): r.n for r in scoring.confusion_matrix(df).collect()}
    assert matrix == {(a, b): int(((y == a) & (p == b)).sum()) for a in (0, 1) for b in (0, 1)}


def test_report_without_predictions_of_a_class(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "label int, prediction int")
    found = {r["class"]: r for r in scoring.classification_report(df).collect()}
    assert (found["1"].precision, found["1"].recall, found["1"].f1) == (0.0, 0.0, 0.0)
    assert {(r.actual, r.predicted): r.n for r in scoring.confusion_matrix(df).collect()}[1, 1] == 0
