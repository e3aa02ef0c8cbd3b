import pytest

from arbormetric.operators.variants import Variant
from arbormetric.plans.clustering import compare_targets
from arbormetric.sources import kernels, matrices, scores
from arbormetric.sources.scores import read_scores
from arbormetric.sources.trees import read_trees

# The header keys and line forms of the matrix format.
DM = """*** DATASET toy
*** LABELS
0:+1
1:-1
2:+1
*** DISTANCES: SHAPE=f GAP=t FLOAT=t EXACT_MATCH={exact} WEIGHT={weight}
0: 0:0 1:1.0 2:2.5
1: 0:1.0 1:0 2:3.0
junk
2: 0:2.5 1:3.0 2:0
"""


@pytest.fixture
def files(tmp_path):
    paths = []
    for name, exact, weight in (("a", "f", "0.50"), ("b", "t", "1.00")):
        path = tmp_path / f"{name}.dm"
        path.write_text(DM.format(exact=exact, weight=weight))
        paths.append(str(path))
    return paths


def test_read_matrices(spark, files):
    dist, labels = matrices.read_dm(spark, files)
    got = sorted((r.target, r.i, r.j, r.d) for r in dist.collect())
    want = [(0, 1, 1.0), (0, 2, 2.5), (1, 2, 3.0)]
    assert got == [("fttf50", *w) for w in want] + [("fttt", *w) for w in want]
    assert sorted((r.id, r["class"]) for r in labels.collect()) == sorted(
        [(0, "+1"), (1, "-1"), (2, "+1")]
    )
    assert matrices.header_problems(matrices.dm_header(spark, files)).count() == 0


def test_half_matrices_and_gates(spark, tmp_path):
    rows = {"low": "0: 0:0\n1: 0:1.0 1:0\n2: 0:2.5 1:3.0 2:0\n", "high": "0: 1:1.0 2:2.5\n1: 2:3.0\n", "odd": "0: 1:1.0\n1: 0:2.0\n"}
    head = DM[: DM.index("0: 0:0")].format(exact="f", weight="0.50")
    for name, text in rows.items():
        (tmp_path / f"{name}.dm").write_text(head + text)
    for name in ("low", "high"):
        got = sorted((r.i, r.j, r.d) for r in matrices.read_dm(spark, str(tmp_path / f"{name}.dm"))[0].collect())
        assert got == [(0, 1, 1.0), (0, 2, 2.5), (1, 2, 3.0)]
    with pytest.raises(Exception, match="several distances"):
        matrices.read_dm(spark, str(tmp_path / "odd.dm"))[0].collect()
    with pytest.raises(ValueError, match="duplicated target"):
        matrices.read_dm(spark, [str(tmp_path / "low.dm"), str(tmp_path / "high.dm")])


def test_header_problems(spark, files, tmp_path):
    other = tmp_path / "c.dm"
    other.write_text(DM.format(exact="t", weight="1.00").replace("toy", "else"))
    empty = tmp_path / "d.dm"
    empty.write_text("0:+1\n")
    headers = matrices.dm_header(spark, [*files, str(other), str(empty)])
    assert matrices.header_problems(headers).count() == 4
    twice = matrices.dm_header(spark, [files[1], str(other)])
    problems = {r.problem for r in matrices.header_problems(twice).collect()}
    assert problems == {"inconsistent dataset names"}


def test_matrix_round_trip(spark, files, tmp_path):
    dist, labels = matrices.read_dm(spark, files)
    one = labels.select("id", "class").distinct()
    out = str(tmp_path / "out")
    matrices.write_dm(dist, one, out, "toy", Variant("f", weight=0.5))
    lines = [r.value for r in spark.read.text(out).collect()]
    assert sorted(lines) == sorted(
        line for line in DM.format(exact="f", weight="0.50").splitlines() if line != "junk"
    )
    again, _ = matrices.read_dm(spark, out)
    rows = lambda df: sorted((r.i, r.j, r.d) for r in df.collect())
    assert rows(again) == rows(dist.filter("target = 'fttf50'"))
    matrices.write_distances(dist, str(tmp_path / "long"))
    assert spark.read.parquet(str(tmp_path / "long")).count() == 6


def test_scores(spark, tmp_path):
    path = tmp_path / "scores.csv"
    path.write_text("A,1,2.5\nB,3,4\nA,7,8\n")
    got = sorted((r.method, int(r.dataset), r.score) for r in scores.read_scores(spark, str(path)).collect())
    assert got == [("A", 0, 7), ("A", 1, 8), ("B", 0, 3), ("B", 1, 4)]
    with pytest.raises(Exception, match="repeated"):
        scores.read_scores(spark, str(path), strict=True).collect()


def test_kernel_file(spark, tmp_path):
    path = tmp_path / "k.txt"
    path.write_text("0:1\n1:-1\n# note\n0: 0:x 1:x+y\n1: 0:x+y 1:2*y^2\n2: 0:1.0E-5\n")
    labels, terms = kernels.read_kernel(spark, str(path))
    assert sorted(map(tuple, labels.collect())) == [(0, 1.0), (1, -1.0)]
    got = {(r.i, r.j, r.ex, r.ey): r.coef for r in terms.collect()}
    assert got[1, 1, 0, 2] == 2 and got[0, 1, 0, 1] == 1 and len(got) == 6
    assert [tuple(r) for r in kernels.rejected_cells(spark, str(path)).collect()] == [
        (2, 0, "1.0E-5")
    ]


def test_results(spark, files, tmp_path):
    dist, labels = matrices.read_dm(spark, files)
    result = compare_targets(dist, labels.select("id", "class").distinct(), "complete", 2)
    scores.write_result(result, str(tmp_path / "res"))
    assert spark.read.parquet(str(tmp_path / "res/assigned")).count() == 6
    assert spark.read.parquet(str(tmp_path / "res/best")).count() == 2
    outcomes = spark.createDataFrame(
        [(0, 0, 0, 0.5, 0.0, -1.0, 1, 2, 3, 4)],
        "a_ix int, b_ix int, c_ix int, alpha double, beta double, logc double, "
        "tp long, fp long, fn long, tn long",
    )
    kernels.write_grid_log(outcomes, str(tmp_path / "log"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert lines == ["alpha,beta,log C,tp,fp,fn,tn", "0.5,0.0,-1.0,1,2,3,4"]
    kernels.write_best_model(
        {n: outcomes for n in ("best", "labels", "gram", "diagonal")}, str(tmp_path / "model")
    )
    assert spark.read.parquet(str(tmp_path / "model/best")).count() == 1


def test_lines_of_several_files_are_in_path_order(spark, tmp_path):
    """Spark reads large files first; places follow the paths all the same."""
    (tmp_path / "a.txt").write_text("x:a\ny:b\n")
    (tmp_path / "b.txt").write_text("".join(f"z:c{n}\n" for n in range(400)))
    (tmp_path / "c.txt").write_text("w:d\n")
    trees = {r.tree_id: r.tree for r in read_trees(spark, str(tmp_path)).collect()}
    assert [trees[n] for n in (0, 1, 2, 401, 402)] == ["a", "b", "c0", "c399", "d"] and len(trees) == 403
    (tmp_path / "s1.csv").write_text("m,1\n" + "k,5\n" * 300)
    (tmp_path / "s2.csv").write_text("m,2\n")
    scores = read_scores(spark, [str(tmp_path / "s1.csv"), str(tmp_path / "s2.csv")])
    assert {r.method: r.score for r in scores.collect()}["m"] == 2
