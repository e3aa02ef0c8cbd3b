import math

import numpy as np
import pytest

from arbormetric.operators import clustering as H
from arbormetric.operators import evaluation as E


def distances(spark, targets=2, items=18, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(targets):
        x = rng.normal(size=(items, 3))
        for i in range(items):
            for j in range(i + 1, items):
                rows.append((f"t{t}", i, j, float(np.linalg.norm(x[i] - x[j]))))
    return spark.createDataFrame(rows, "target string, i long, j long, d double"), rows


def by_step(df):
    return [tuple(r) for r in df.orderBy("target", "step").collect()]


def naive(rows, target, link):
    """Greedy clustering straight from the definition of a link over item pairs or centroids."""
    d = {}
    for t, i, j, v in rows:
        if t == target:
            d[i, j] = d[j, i] = v
    clusters = {i: [i] for i in {i for pair in d for i in pair}}
    heights = []
    while len(clusters) > 1:
        def gap(a, b):
            values = [d[p, q] for p in clusters[a] for q in clusters[b]]
            return {"single": min, "complete": max, "upgma": lambda v: sum(v) / len(v)}[link](values)

        value, a, b = min((gap(a, b), a, b) for a in clusters for b in clusters if a < b)
        clusters[a] += clusters.pop(b)
        heights.append((a, b, value))
    return heights


@pytest.mark.parametrize("link", ["single", "complete", "upgma"])
def test_links_by_definition(spark, link):
    dist, rows = distances(spark, 1, 14)
    got = [(r.left, r.right, r.height) for r in H.hac(dist, link).orderBy("step").collect()]
    want = naive(rows, "t0", link)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_squared_links_on_a_line(spark):
    # Points 0, 1, 4: centroid and Ward heights by hand.
    rows = [("t", 0, 1, 1.0), ("t", 0, 2, 4.0), ("t", 1, 2, 3.0)]
    dist = spark.createDataFrame(rows, "target string, i long, j long, d double")
    last = lambda link: H.hac(dist, link).orderBy("step").collect()[-1].height
    assert last("upgmc") == pytest.approx(3.5)
    assert last("wpgmc") == pytest.approx(3.5)
    assert last("ward") == pytest.approx(math.sqrt(2 * 2 * 1 / 3) * 3.5)
    assert last("wpgma") == pytest.approx(3.5)


@pytest.mark.parametrize("link", ["ward", "upgmc", "wpgmc"])
def test_rounds_equal_groups(spark, link):
    dist, _ = distances(spark, 2, 12)
    limit = 4 if link in H.REDUCIBLE else 10
    one, other = by_step(H.hac(dist, link)), by_step(H.hac(dist, link, group_limit=limit))
    assert [r[:4] for r in one] == [r[:4] for r in other]
    assert [r[4] for r in one] == pytest.approx([r[4] for r in other])


def test_weights_stand_for_equal_items(spark):
    rows = [("t", 0, 1, 1.0), ("t", 0, 2, 4.0), ("t", 1, 2, 3.0), ("t", 0, 3, 0.0),
            ("t", 1, 3, 1.0), ("t", 2, 3, 4.0)]
    schema = "target string, i long, j long, d double"
    full = H.hac(spark.createDataFrame(rows, schema), "upgma").orderBy("step").collect()
    weights = spark.createDataFrame([(0, 2), (1, 1), (2, 1)], "id long, n long")
    part = H.hac(spark.createDataFrame(rows[:3], schema), "upgma", weights).orderBy("step").collect()
    assert [r.height for r in part] == pytest.approx([r.height for r in full[1:]])
    assert part[-1]["size"] == 4


def test_cuts_agree(spark):
    merges = H.hac(distances(spark)[0], "complete")
    rows = lambda df: sorted((r.target, r.k, r.id, r.cluster) for r in df.collect())
    grouped, jumped = rows(H.cut(merges, 6)), rows(H.cut(merges, 6, group_limit=1))
    assert grouped == jumped
    for k in range(2, 7):
        assert len({r[3] for r in grouped if r[:2] == ("t0", k)}) == k


def scores(spark, clusters, classes):
    assigned = spark.createDataFrame(
        [("t", 2, n, c) for n, c in enumerate(clusters)], "target string, k int, id long, cluster long"
    )
    named = spark.createDataFrame(list(enumerate(classes)), "id long, class string")
    return E.agreement(E.contingency(assigned, named)).first()


def test_agreement_by_hand(spark):
    same = scores(spark, [0, 0, 1, 1], "aabb")
    assert (same.ari, same.nmi) == pytest.approx((1.0, 1.0))
    # Pairs: 2 together in both of 4; expected 3*3/10.
    mixed = scores(spark, [0, 0, 0, 1, 1], "aabbb")
    together, p, q, n = 2, 4, 4, 10
    assert mixed.ari == pytest.approx((together - p * q / n) / ((p + q) / 2 - p * q / n))
    h = lambda *c: -sum(x / sum(c) * math.log(x / sum(c)) for x in c)
    assert mixed.nmi == pytest.approx(2 - 2 * h(2, 1, 2) / (h(3, 2) + h(2, 3)))
    assert scores(spark, [0, 0], "aa").nmi is None


def test_unknown_link_means_complete():
    assert H.link_name("WARD") == "ward" and H.link_name("wand") == "complete"


@pytest.mark.parametrize("link", H.LINKS)
def test_ties_do_not_depend_on_the_limit(spark, link):
    rng = np.random.default_rng(17)
    rows = [
        (f"t{t}", i, j, float(rng.integers(1, 5))) for t in range(6) for i in range(9) for j in range(i + 1, 9)
    ]
    dist = spark.createDataFrame(rows, "target string, i long, j long, d double")
    whole = H.hac(dist, link)
    rounds = H.hac(dist, link, group_limit=4)
    key = lambda df: [(r.target, r.step, r.left, r.right, round(r.height, 8), r.size) for r in df.orderBy("target", "step").collect()]
    assert key(whole) == key(rounds)


def test_rounds_take_the_weights_of_the_target(spark):
    dist, _ = distances(spark, 2, 6)
    weights = spark.createDataFrame(
        [(f"t{t}", i, 1 + (i + t) % 3) for t in range(2) for i in range(6)], "target string, id long, n long"
    )
    key = lambda df: [(r.target, r.left, r.right, round(r.height, 8), r.size) for r in df.orderBy("target", "step").collect()]
    assert key(H.hac(dist, "upgma", weights)) == key(H.hac(dist, "upgma", weights, group_limit=3))


@pytest.mark.parametrize("limit", [3, 100])
def test_an_item_without_weight_raises(spark, limit):
    dist, _ = distances(spark, 1, 6)
    weights = spark.createDataFrame([(i, 1) for i in range(5)], "id long, n long")
    with pytest.raises(Exception, match="no weight"):
        H.hac(dist, "upgma", weights, group_limit=limit).collect()
