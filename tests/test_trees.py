import pytest
from pyspark.sql import functions as F

from arbormetric.operators import nodes
from arbormetric.operators.nodes import canonical_trees, token_depths, tree_nodes, tree_ref
from arbormetric.operators.pairs import all_pairs, pair_tiles
from arbormetric.operators.paths import common_path_lengths
from arbormetric.operators.nodes import tree_arrays
from arbormetric.sources.trees import accepted_trees, read_trees, rejected_trees


def nodes_of(spark, text):
    df = spark.createDataFrame([(1, text)], "tree_id long, tree string")
    rows = tree_nodes(df).orderBy("pre").collect()
    return [(r.pre, r.label, r.parent, r.depth, r.size, r.ord) for r in rows]


def test_hand_nodes(spark):
    assert nodes_of(spark, "a(b,c(d))") == [
        (0, "a", None, 0, 4, 0),
        (1, "b", 0, 1, 1, 0),
        (2, "c", 0, 1, 2, 1),
        (3, "d", 2, 2, 1, 0),
    ]
    assert nodes_of(spark, "a ( b()  c(d , e) f)")[3:] == [
        (3, "d", 2, 2, 1, 0),
        (4, "e", 2, 2, 1, 1),
        (5, "f", 0, 1, 1, 2),
    ]


def test_file_rejects_and_ids(spark, tmp_path):
    lines = ["+1:a(b,c)", "-1: a(b)", "no tree", "x:a(b", "x:a)b(", "x:(a)", "+1:a b", "q:r:s(t)"]
    path = tmp_path / "trees.txt"
    path.write_text("\n".join(lines) + "\n")
    trees = read_trees(spark, str(path))
    good = {r.tree_id: (r["class"], r.tree) for r in accepted_trees(trees).collect()}
    assert good == {
        0: ("+1", "a(b,c)"), 1: ("-1", " a(b)"), 6: ("+1", "a b"), 7: ("q", "r:s(t)")
    }
    assert {r.tree_id for r in rejected_trees(trees).collect()} == {2, 3, 4, 5}
    assert {r.tree_id for r in rejected_trees(trees, strict=True).collect()} == {2, 3, 4, 5, 6}
    first = {r.tree_id: r.tree for r in canonical_trees(accepted_trees(trees)).collect()}
    assert first[6] == "a" and first[1] == "a(b)"


def test_ids_over_many_files(spark, tmp_path):
    for part in range(3):
        body = "\n".join(f"c:t{part}x{n}" for n in range(50))
        (tmp_path / f"part{part}.txt").write_text(body + "\n")
    ids = [r.tree_id for r in read_trees(spark, str(tmp_path)).collect()]
    assert sorted(ids) == list(range(150))


def test_refs_follow_structure(spark):
    texts = ["a(b,c)", "a (b c)", "a(b(c))", "a(b(),c())"]
    df = spark.createDataFrame(list(enumerate(texts)), "tree_id long, tree string")
    refs = {r.tree_id: r.ref for r in tree_ref(df).collect()}
    assert refs[0] == refs[1] == refs[3] != refs[2]
    # Base64 of the MD5 digest of "a(b(),c())".
    import base64
    import hashlib

    assert refs[0] == base64.b64encode(hashlib.md5(b"a(b(),c())").digest()).decode()


@pytest.mark.parametrize("budget", [3, 1000])
def test_every_pair_once(spark, budget):
    items = spark.range(40).withColumnRenamed("id", "key")
    pairs = [(r.i, r.j) for r in all_pairs(items, "key", budget).collect()]
    assert sorted(pairs) == [(i, j) for i in range(40) for j in range(i + 1, 40)]


def test_tiles_are_small_and_balanced(spark):
    items = spark.range(2000).select(
        F.col("id").alias("key"), F.when(F.col("id") % 100 == 0, 64).otherwise(4).alias("size")
    )
    tiles = pair_tiles(items, "key", 500, "size").groupBy("bi", "bj").agg(F.sum("size").alias("s"))
    assert tiles.agg(F.max("s")).first()[0] < 2 * 500 * 1.6


def test_common_paths(spark):
    rows = [(0, "a(b(c),d)"), (1, "x(b(c(q)))"), (2, "z")]
    df = spark.createDataFrame(rows, "tree_id long, tree string")
    found = common_path_lengths(tree_arrays(tree_nodes(df)), "tree_id").collect()
    assert [(r.i, r.j, r.length) for r in found] == [(0, 1, 2)]


@pytest.mark.parametrize("table", [token_depths, tree_nodes])
def test_more_trees_make_more_tasks_not_larger_ones(spark, monkeypatch, table):
    monkeypatch.setattr(nodes, "TASK_CHARS", 100)
    texts = spark.range(300).select(F.col("id").alias("tree_id"), F.lit("a(b,c(d))").alias("tree"))
    # Hashed by key already, as by a join: the windows would stay in its few partitions.
    rows = table(texts.repartition(2, "tree_id")).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in rows) == 300 * (8 if table is token_depths else 4)
    assert len(rows) > 20 and max(r["count"] for r in rows) <= 300
