"""A forest's table of nodes against hand-made splits and the fitted model's own importances."""

import random

import pytest

from marketloom.operators import forests, models


def test_a_hand_made_split(spark):
    rows = spark.createDataFrame([(float(i % 7), float(i % 5), int(i % 7 > 3)) for i in range(280)], "a double, b double, trade_success int")
    model = models.estimator("random_forest", ["a", "b"]).fit(rows)
    nodes = forests.forest_nodes(model, ["a", "b"]).collect()
    roots = [n for n in nodes if n.node == 0]
    assert len(roots) == 200 and all(3 <= n.threshold < 4 for n in roots if n.feature == "a") and any(n.feature == "a" for n in roots)
    for n in nodes:
        # what a split gains is the impurity it takes away
        if n.feature:
            left, right = (next(m for m in nodes if (m.tree, m.node) == (n.tree, c)) for c in (n.left, n.right))
            assert n.rows == left.rows + right.rows
            assert n.gain == pytest.approx(n.impurity - (left.rows * left.impurity + right.rows * right.impurity) / n.rows)
        else:
            assert n.threshold is None and (n.left, n.right) == (-1, -1)


def test_importances_are_the_models_own(spark):
    r = random.Random(16)
    rows = [(r.random(), r.random(), r.random(), 1.0) for _ in range(600)]
    frame = spark.createDataFrame([(*x, int(x[0] + 0.3 * x[1] + r.gauss(0, 0.2) > 0.6)) for x in rows], "a double, b double, c double, still double, trade_success int")
    columns = ["a", "b", "c", "still"]
    model = models.estimator("random_forest", columns).fit(frame)
    found = forests.forest_importances(forests.forest_nodes(model, columns)).collect()
    want = dict(zip(columns, model.stages[-1].featureImportances.toArray(), strict=True))
    assert [x.feature for x in found] == sorted((c for c in columns if want[c]), key=lambda c: -want[c])
    assert {x.feature: x.importance for x in found} == pytest.approx({c: v for c, v in want.items() if v}) and sum(x.importance for x in found) == pytest.approx(1.0)
    assert forests.forest_importances(forests.forest_nodes(model, columns), 2).count() == 2
    with pytest.raises(ValueError):
        forests.forest_nodes(models.estimator("logistic_regression", columns).fit(frame), columns)
