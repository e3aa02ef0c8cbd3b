import itertools
import random

import pytest

from arbormetric.operators.bounded import candidate_pairs
from arbormetric.operators.distances import structure_distances, tree_distances
from arbormetric.operators.levels import level_distances, relabel_costs, tree_subtrees
from arbormetric.operators.nodes import structures, tree_arrays, tree_nodes
from arbormetric.operators.variants import Variant, all_variants
from brute_force import distance

# Trees of depth 3 and more with repeated labels and unlike shapes.
DEEP = [
    "m(n(o(m)),o)",
    "o(n(m,n(o)))",
    "o(m(o,n),m)",
    "n(o(m(n),o))",
]


def table(spark, texts):
    rows = list(enumerate(texts))
    return spark.createDataFrame(rows, "tree_id long, tree string")


def matrix(df):
    return {(r.target, r.i, r.j): r.d for r in df.collect()}


def random_tree(rng, size):
    parents = [rng.randrange(i) for i in range(1, size)]
    kids = {i: [] for i in range(size)}
    for child, parent in enumerate(parents, 1):
        kids[parent].append(child)

    def text(u):
        label = rng.choice("ab" if size > 3 else "abc")
        inner = ",".join(text(k) for k in kids[u])
        return f"{label}({inner})" if inner else label

    return text(0)


@pytest.fixture(scope="module")
def deep(spark):
    return matrix(tree_distances(table(spark, DEEP), variants=all_variants()))


@pytest.mark.parametrize("v", all_variants(), ids=lambda v: v.target)
def test_deep_trees(deep, v):
    for i, j in itertools.combinations(range(len(DEEP)), 2):
        want = distance(v.shape, v.gap, v.exact, v.weight, DEEP[i], DEEP[j])
        assert deep[(v.target, i, j)] == pytest.approx(want), (DEEP[i], DEEP[j])


COSTS = [("m", "n", 0.25), ("o", "m", 1.75), ("n", "n", 9.0), ("q", "z", 5.0)]


def test_relabel_costs(spark):
    """Single labels cost what the table says, in either order; the rest costs the weight."""
    texts = ["n(m,q(o))", "m", "o(q,m(n))", "m(o,n)", "o(n(m))"]
    variants = [v for v in all_variants(0.5) if not v.exact and (v.shape in "sap" or not v.gap)]
    costs = spark.createDataFrame(COSTS, "label_a string, label_b string, cost double")
    found = matrix(tree_distances(table(spark, texts), variants=variants, costs=costs))
    given = {frozenset(c[:2]): c[2] for c in COSTS}
    for v in variants:
        for i, j in itertools.combinations(range(len(texts)), 2):
            want = distance(v.shape, v.gap, v.exact, v.weight, texts[i], texts[j], given)
            assert found[(v.target, i, j)] == pytest.approx(want), (v, texts[i], texts[j])
    none, path = costs.limit(0), [Variant("p", weight=0.5)]
    plain = matrix(tree_distances(table(spark, texts[:3]), variants=path))
    assert matrix(tree_distances(table(spark, texts[:3]), variants=path, costs=none)) == plain


@pytest.mark.parametrize("rows", [
    [("a", "b", 1.0), ("b", "a", 2.0)], [("a", "b", None)], [("a", "b", -1.0)]])
def test_costs_that_raise(spark, rows):
    costs = spark.createDataFrame(rows, "label_a string, label_b string, cost double")
    for shape in ("s", "p"):
        with pytest.raises(Exception, match="relabel cost"):
            tree_distances(table(spark, ["a", "b(a)"]), variants=[Variant(shape)], costs=costs).collect()
    with pytest.raises(ValueError, match="weight"):
        tree_distances(table(spark, ["a", "b"]), variants=[Variant("f")], costs=costs)


def test_costs_given_twice_alike(spark):
    costs = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.5)], "label_a string, label_b string, cost double")
    assert [tuple(r) for r in relabel_costs(costs).collect()] == [("a", "b", 0.5)]


def test_near_structures(spark):
    """The rows of the full matrix up to the limit, from a part of its pairs."""
    rng = random.Random(9)
    texts = sorted({random_tree(rng, rng.randrange(1, 6)).replace("a", rng.choice("axyz")) for _ in range(16)})
    variants = [Variant("t", False, weight=1.5), Variant("f", False, True), Variant("f"), Variant("p", weight=0.5)]
    trees = table(spark, texts)
    costs = spark.createDataFrame([("a", "b", 0.75), ("x", "z", 1.25)], "label_a string, label_b string, cost double")
    for own, given, limits in ((variants, None, (0, 2.5)), ([Variant("s")], costs, (1.5,))):
        whole = matrix(structure_distances(trees, own, key="tree_id", costs=given))
        for limit in limits:
            near = matrix(structure_distances(trees, own, key="tree_id", costs=given, max_distance=limit))
            assert near == {k: d for k, d in whole.items() if d <= limit}


def test_candidates_are_few(spark):
    """Trees of own labels only meet their copies with a change, and bounds hold for every weight."""
    texts = [f"r{n}(s{n},t{n}(u{n}))" for n in range(40)] + [f"r{n}(s{n},t{n})" for n in range(40)]
    arrays = tree_arrays(tree_nodes(table(spark, texts)))
    for weight in (0.5, 1.0, 2.0):
        pairs = {(r.i, r.j) for r in candidate_pairs(arrays, "tree_id", 1.0, weight).collect()}
        assert pairs == {(n, n + 40) for n in range(40)}
    every = candidate_pairs(arrays, "tree_id", 1.0, 0.0).count()
    assert every == 80 * 79 // 2
    assert candidate_pairs(arrays, "tree_id", 7.0, 1.0).count() == 80 * 79 // 2
    assert candidate_pairs(arrays.limit(0), "tree_id", 1.0, 1.0).count() == 0


def test_subtrees(spark):
    arrays = tree_arrays(tree_nodes(table(spark, ["a(b(c),b(c))", "b(c)"])))
    rows = tree_subtrees(arrays, "tree_id").collect()
    at = {(r.tree_id, r.pos): r for r in rows}
    assert at[0, 1].id == at[0, 3].id == at[1, 0].id and at[0, 2].id == at[1, 1].id
    assert [(at[0, n].size, at[0, n].height, len(at[0, n].kids)) for n in range(5)] == [
        (5, 2, 2), (2, 1, 1), (1, 0, 0), (2, 1, 1), (1, 0, 0)]
    assert at[0, 0].kids == [at[0, 1].id, at[0, 3].id]


@pytest.mark.parametrize("budget", [4000, 6])
def test_against_mappings(spark, budget):
    rng = random.Random(7)
    texts = sorted({random_tree(rng, n) for n in (1, 2, 3, 4, 4, 5, 5, 5, 5, 5, 4, 5)})
    variants = [v for w in (0.5, 1.5) for v in all_variants(w) if not (v.exact and w > 1)]
    distinct = table(spark, texts)
    found = matrix(structure_distances(distinct, variants, budget, "tree_id"))
    for v in variants:
        for i, j in itertools.combinations(range(len(texts)), 2):
            want = distance(v.shape, v.gap, v.exact, v.weight, texts[i], texts[j])
            assert found[(v.target, i, j)] == pytest.approx(want), (v, texts[i], texts[j])
    assert len(found) == len(variants) * len(texts) * (len(texts) - 1) // 2


def test_invariants_on_larger_trees(spark):
    rng = random.Random(3)
    texts = sorted({random_tree(rng, rng.randrange(6, 18)) for _ in range(14)})
    variants = all_variants(1.0) + [v for v in all_variants(2.0) if not v.exact]
    found = matrix(tree_distances(table(spark, texts), variants=variants, budget=60))
    for i, j in itertools.combinations(range(len(texts)), 2):
        d = lambda t: found[(t, i, j)]
        assert d("fttf100") <= d("fftf100") <= d("tftf100")
        assert d("fttf100") <= d("tttf100") <= d("tftf100")
        assert d("fttf100") <= d("sttf100") <= d("attf100")
        assert d("fttf200") == d("fttt") and d("pttf200") == d("pttt")
        for v in all_variants(1.0):
            if not v.exact:
                assert d(v.target) <= d(v.target[:3] + "t")
                assert d(v.target) <= d(v.target[:4] + "200")


def test_equal_trees_and_structures(spark):
    trees = table(spark, ["a(b,c)", " a( b c )", "a(b(c))", "a(b(c))"])
    assert sorted(r.n for r in structures(trees).collect()) == [2, 2]
    found = matrix(tree_distances(trees, variants=[Variant("f"), Variant("p")]))
    assert found[("fttf100", 0, 1)] == 0 and found[("pttf100", 0, 1)] == 2
    assert found[("fttf100", 2, 3)] == 0 and found[("pttf100", 2, 3)] == 0
    assert len(found) == 12


def test_no_agreement_as_null(spark):
    arrays = tree_arrays(tree_nodes(table(spark, ["a", "b"])))
    for null, want in ((True, None), (False, 1e8)):
        out = level_distances(arrays, "tree_id", [Variant("a", True, True)], null_no_agreement=null)
        assert out.first().d == want


def test_undefined_variants():
    for bad in ({"shape": "s", "gap": False}, {"shape": "a", "gap": False}, {"shape": "q"},
                {"shape": "f", "floating": False}):
        with pytest.raises(ValueError):
            Variant(**bad)
    assert Variant("f", True, True, 3.0).weight == 1.0
    assert Variant("f", weight=0.29).target == "fttf29"
    assert len(all_variants()) == 16
