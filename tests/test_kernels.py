import numpy as np
import pytest
from pyspark.sql import functions as F

from arbormetric.functions.margin_fit import fit_margin
from arbormetric.operators import polynomials as K
from arbormetric.operators import search as G
from arbormetric.plans.searching import search_kernel


def terms(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, p string")
    return K.poly_terms(df, "p", ["id"])


def as_dict(df, key=0):
    return {(r.ex, r.ey): r.coef for r in df.collect() if r.id == key}


def test_parse_by_hand(spark):
    texts = ["x^2+2*x*y-3", "-y^2", "y*x^2", "1.0E-5", "x*x", "2x^3y^2+x", "x + y", "x-x", "3*"]
    df = terms(spark, *texts)
    assert as_dict(df, 0) == {(2, 0): 1, (1, 1): 2, (0, 0): -3}
    assert as_dict(df, 1) == {(0, 2): -1}
    assert as_dict(df, 2) == {(2, 1): 1}
    assert as_dict(df, 5) == {(3, 2): 2, (1, 0): 1}
    assert as_dict(df, 7) == {(0, 0): 0}
    source = spark.createDataFrame(list(enumerate(texts)), "id long, p string")
    assert {r.id for r in K.poly_rejects(source, "p").collect()} == {3, 4, 6, 8}


def test_arithmetic(spark):
    a, b = terms(spark, "x+y"), terms(spark, "x-y")
    assert as_dict(K.poly_mul(a, b, ["id"])) == {(2, 0): 1, (0, 2): -1}
    assert as_dict(K.poly_sub(a, a, ["id"])) == {(0, 0): 0}
    assert as_dict(K.poly_add(a, b, ["id"])) == {(1, 0): 2}
    assert as_dict(K.poly_add_scalar(a, 2, ["id"])) == {(1, 0): 1, (0, 1): 1, (0, 0): 2}
    assert as_dict(K.poly_scale(a, 0, ["id"])) == {(0, 0): 0}


def test_format(spark):
    texts = {r.id: r.text for r in K.poly_format(terms(spark, "y-3x^2y+2", "x-x"), ["id"]).collect()}
    assert texts == {0: "-3.0x^2y+1.0y+2.0", 1: "0.0"}


def test_grid(spark):
    unit = K.Range(0.0, 1.0, 2)
    grid = K.param_grid(K.range_row(spark, a=unit, b=unit, c=K.Range(0.0, 0.0, 3))).collect()
    assert [(r.alpha, r.beta, r.logc) for r in grid] == [
        (0.5, 0, 0), (0.5, 0.5, 0), (1, 0, 0), (1, 0.5, 0), (1, 1, 0)
    ]


def test_eval_and_normalize(spark):
    rows = [(0, 0, "4x"), (0, 1, "x^2+2*x*y-3"), (1, 1, "x+y")]
    df = spark.createDataFrame(rows, "i long, j long, p string")
    table = K.poly_terms(df, "p", ["i", "j"])
    gram = K.poly_eval(table, K.Range(0.0, 0.5, 1), K.Range(0.25, 0.25, 1))
    values = {(r.i, r.j): r.v for r in gram.collect()}
    assert values == {(0, 0): 2.0, (0, 1): -2.5, (1, 1): 0.75}
    norm = {(r.i, r.j): r.v for r in K.normalize_gram(gram).collect()}
    assert norm[0, 0] == norm[1, 1] == 1
    assert norm[0, 1] == pytest.approx(-2.5 / np.sqrt(1.5))


def test_fit_meets_the_optimality_conditions():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(-1, 1, (20, 2)), rng.normal(1, 1, (20, 2))])
    y = np.repeat([-1.0, 1.0], 20)
    weights, shift, converged = fit_margin(x @ x.T, y, 1.0)
    f = x @ x.T @ weights + shift
    assert converged and (np.sign(f) == y).mean() > 0.8
    kernel = np.outer([-2, -1, 1, 2], [-2, -1, 1, 2]).astype(float)
    weights, shift, _ = fit_margin(kernel, np.array([-1.0, -1, 1, 1]), 100.0)
    assert kernel @ weights + shift == pytest.approx([-2, -1, 1, 2], abs=1e-5)


def toy(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(-2, 0.5, (10, 2)), rng.normal(2, 0.5, (10, 2))])
    y = [-1.0] * 10 + [1.0] * 10
    rows = [
        (i, j, ex, ey, float(c))
        for i in range(20) for j in range(20)
        for ex, ey, c in ((1, 0, x[i] @ x[j]), (0, 1, 1.0))
    ]
    terms_ = spark.createDataFrame(rows, "i long, j long, ex int, ey int, coef double")
    return terms_, spark.createDataFrame(list(enumerate(y)), "id long, y double")


def test_search(spark):
    terms_, labels = toy(spark)
    unit = K.Range(0.0, 1.0, 2)
    found = search_kernel(terms_, labels, unit, unit, K.Range(-1.0, 1.0, 2), 5, norm=True)
    assert found["outcomes"].count() == 5 * 3
    best = found["best"].first()
    assert (best.tp, best.fp, best.fn, best.tn) == (10, 0, 0, 10) and best.accuracy == 1
    assert (best.a_ix, best.b_ix, best.c_ix) == (0, 0, 0)
    assert found["gram"].count() == 400 and found["diagonal"].count() == 20
    assert found["optimal"].count() >= 1


def line_gram(spark):
    x = np.array([-2.0, -1.1, 0.4, -0.3, 1.2, 2.1])
    rows = [(i, j, 0, 0, 1.0, 0.0, float(x[i] * x[j] + 1)) for i in range(6) for j in range(6)]
    gram = spark.createDataFrame(
        rows, "i long, j long, a_ix int, b_ix int, alpha double, beta double, v double"
    )
    y = [-1.0, -1.0, -1.0, 1.0, 1.0, 1.0]
    return gram, spark.createDataFrame(list(enumerate(y)), "id long, y double")


def test_predictions_cover_all_rows_of_a_bounded_fit(spark):
    terms_, labels = toy(spark)
    gram = K.poly_eval(terms_, K.Range(1.0, 1.0, 1), K.Range(0.0, 0.0, 1))
    found = G.grid_cv(gram, labels, K.Range(0.0, 0.0, 0), 2, 14).collect()
    assert len(found) == 20 and all(r.predicted == r.y and r.converged for r in found)


def test_a_gram_that_lacks_cells_raises(spark):
    gram, labels = line_gram(spark)
    once = K.Range(0.0, 0.0, 1)
    assert G.grid_cv(gram, labels, once, 2).count() == 6
    for cut in ("i <= j", "i <> 5", "j <> 0"):
        with pytest.raises(Exception, match="lacks cells"):
            G.grid_cv(gram.filter(cut), labels, once, 2).collect()
    with pytest.raises(Exception, match="no label"):
        G.grid_cv(gram, labels.filter("id > 0"), once, 2).collect()


def test_folds_are_stratified(spark):
    folds = G.stratified_folds(toy(spark)[1], 5).groupBy("y", "fold").count().collect()
    assert len(folds) == 10 and {r["count"] for r in folds} == {2}


def test_labels_are_checked(spark):
    bad = spark.createDataFrame([(0, 2.0)], "id long, y double")
    with pytest.raises(Exception, match="labels must be"):
        G.stratified_folds(bad, 2).collect()


def test_labels_without_gram_rows_raise(spark):
    gram, labels = line_gram(spark)
    more = labels.unionByName(spark.createDataFrame([(17, 1.0)], "id long, y double"))
    once = K.Range(0.0, 0.0, 1)
    with pytest.raises(Exception, match="no Gram row"):
        G.grid_cv(gram, more, once, 2).collect()
    with pytest.raises(Exception, match="no Gram row"):
        G.confusion(G.grid_cv(gram, more, once, 2)).collect()
    with pytest.raises(ValueError, match="two folds"):
        G.grid_cv(gram, labels, once, 1)


def test_a_rare_class_is_drawn(spark):
    """Of 30,000 rows 60 are in the rare class, all of which every draw of 100 has."""
    parts = spark.range(30_000).selectExpr("id", "if(id % 500 = 0, 1.0D, -1.0D) as y", "cast(id % 2 as int) as fold")
    parts = parts.withColumn("fold", (F.col("id") / 500).cast("int") % 2)
    drawn = {(r.y, r.fold): r["count"] for r in G._drawn(parts, 100).groupBy("y", "fold").count().collect()}
    assert drawn[1.0, 0] == drawn[1.0, 1] == 30
    assert 20 < drawn[-1.0, 0] < 150


def test_convergence_reaches_the_model(spark):
    rows = [(0, 0, c, 1.0, 1.0, float(c), i, 1.0, 1.0, i != 3 or c != 1) for c in range(2) for i in range(5)]
    found = G.confusion(spark.createDataFrame(
        rows, "a_ix int, b_ix int, c_ix int, alpha double, beta double, logc double, id long, y double, predicted double, converged boolean"))
    assert {r.c_ix: r.converged for r in found.collect()} == {0: True, 1: False}
    assert G.select_model(found).first().converged


def test_a_fit_that_sees_one_class_is_flagged(spark):
    gram, _ = line_gram(spark)
    # The only row of one class is in fold 0, so the fit for fold 0 sees the other class alone.
    labels = spark.createDataFrame([(i, 1.0 if i == 5 else -1.0) for i in range(6)], "id long, y double")
    folds = {r.id: r.fold for r in G.stratified_folds(labels, 2).collect()}
    found = {r.id: r.converged for r in G.grid_cv(gram, labels, K.Range(0.0, 0.0, 1), 2).collect()}
    assert not any(found[i] for i in found if folds[i] == folds[5])
