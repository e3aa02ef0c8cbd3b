"""Merkle manifest of a dataset: per-source trees under one root, with proofs, by slot pivots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from arbormetric.llm.tables import discard, small, stored, table

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows whose crc32 of the decimal id this divides are tampered with.
TAMPERED = 5


def leaf_hash(columns: list[Column]) -> Column:
    """Digest of a row: ``-`` for a null, else the byte count of the value, a colon and the value."""
    own = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*own), 256)


def _ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``gid``, the place of the group among all groups (null first), ``groups``, their
    number, ``pos``, the row's place in its group, and ``n``, the group's rows.

    Rows are dealt to ranges of group and order, the ranges' counts tell where each begins, and rows
    are numbered within a range; a group of any size lies in as many ranges as it needs. Rows that agree
    in all of ``order`` are parted by a number of their own.
    """
    spark = rows.sparkSession
    salted = rows.withColumn("salt", F.monotonically_increasing_id())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(salted.repartitionByRange(parts, group, *order, "salt").withColumn("part", F.spark_partition_id()))
    every = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = dealt.groupBy(group, "part").agg(F.count("*").alias("here"))
    own = Window.partitionBy(group).orderBy("part")
    counts = counts.withColumns({"before": F.sum("here").over(own) - F.col("here"), "n": F.sum("here").over(every(own)), "first": F.min("part").over(every(own))})
    counts = stored(counts)
    # A range has as many groups that begin in it as it has rows at most, and there are few ranges.
    begun = counts.filter("part = first")
    starts = begun.groupBy("first").agg(F.count("*").alias("begun"))
    starts = starts.withColumns({"earlier": F.sum("begun").over(Window.orderBy("first")) - F.col("begun"), "groups": F.sum("begun").over(every(Window.orderBy("first")))})
    places = begun.select(F.col(group).alias("of"), "first", (F.row_number().over(Window.partitionBy("first").orderBy(group)) - 1).alias("inner"))
    places = places.join(F.broadcast(starts), "first").select("of", (F.col("earlier") + F.col("inner")).alias("gid"), "groups")
    counts = counts.join(places, F.col(group).eqNullSafe(F.col("of"))).drop("of", "first", "here").withColumnsRenamed({group: "of", "part": "in"})
    numbered = dealt.withColumn("inner", F.row_number().over(Window.partitionBy(group, "part").orderBy(*order, "salt")) - 1)
    return (numbered.join(small(stored(counts)), F.col(group).eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
            .withColumn("pos", F.col("before") + F.col("inner")).drop("of", "in", "before", "inner", "salt", "part"))


def slot_pivot(nodes: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """Parents of ``nodes(gid, pos, n, hash)``: ``gid, pos, n`` of the level above, the children's
    digests in the columns ``s0``, ``s1``, ... by their slot, and ``hash``. Columns named in ``kept``
    are spread in the same way, as ``<name>0`` and so on. The only node of its group stays what it is.
    """
    slot = F.pmod("pos", F.lit(FANOUT))
    spread = [F.max(F.when(slot == i, F.col(c))).alias(f"{'s' if c == 'hash' else c}{i}") for c in ("hash", *kept) for i in range(FANOUT)]
    pivot = nodes.groupBy("gid", F.floor(F.col("pos") / FANOUT).alias("pos"), "n").agg(*spread)
    whole = F.sha2(F.concat_ws("", *(f"s{i}" for i in range(FANOUT))), 256)
    return pivot.withColumns({"alone": F.col("n") == 1, "hash": F.when(F.col("n") == 1, F.col("s0")).otherwise(whole), "n": F.ceil(F.col("n") / FANOUT)})


def _children(pivot: DataFrame, paths: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """The children of the parents in ``pivot`` with their way up: ``gid, pos, hash, path`` and what is
    kept. A step of ``path`` is what stands left and right of the own slot."""
    slots = [F.when(F.col(f"s{i}").isNotNull(), F.struct(
        F.lit(i).alias("slot"), F.col(f"s{i}").alias("hash"), *(F.col(f"{c}{i}").alias(c) for c in kept),
        F.concat_ws("", *(f"s{j}" for j in range(i))).alias("left"), F.concat_ws("", *(f"s{j}" for j in range(i + 1, FANOUT))).alias("right")))
        for i in range(FANOUT)]
    rows = pivot.join(paths, ["gid", "pos"]).select("gid", "pos", "alone", "path", F.explode(F.array_compact(F.array(*slots))).alias("at"))
    step = F.when(F.col("alone"), F.col("path")).otherwise(F.concat(F.array(F.struct("at.left", "at.right")), F.col("path")))
    return rows.select("gid", (F.col("pos") * FANOUT + F.col("at.slot")).alias("pos"), "at.hash", *(f"at.{c}" for c in kept), step.alias("path"))


def _levels(nodes: DataFrame, kept: tuple[str, ...] = ()) -> list[DataFrame]:
    """The pivots from the leaves up, until every group has one node."""
    levels = [stored(slot_pivot(nodes, kept))]
    while (above := levels[-1].filter("n > 1")).limit(1).count():
        levels.append(stored(slot_pivot(above.select("gid", "pos", "n", "hash"))))
    return levels


def _ways(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``gid, pos, path`` of the parents of the lowest level; ``tops(gid, path)`` has the ways of the
    groups' own roots."""
    of_top = lambda level: level.filter("n = 1").select("gid", "pos").join(tops, "gid")
    ways = of_top(levels[-1])
    for below, level in zip(levels[-2::-1], levels[:0:-1], strict=True):
        ways = _children(level, ways).select("gid", "pos", "path").unionByName(of_top(below))
    return ways


def proofs(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for each row of
    ``documents``: its digest, the roots of its source and of the dataset, the digest of its siblings
    from the leaf up, and the root that its leaf, or its ``tampered`` one, folds to with them.

    The leaves of a source are in the order of the ids, null first; rows of one id are in the order of
    their digests, and equal rows are leaves of their own. Sources are ordered by their UTF-8 bytes,
    null first. While a source has more than one node, each run of FANOUT nodes becomes one; a
    source's only row is its subroot, and a single source's subroot is the root. Null values, empty and
    long texts are hashed as they are, an empty table gives no rows, other columns are not read.

    A conditional aggregate spreads each parent's children into one column per slot; hashing all of
    them gives the parent, leaving out the own one gives the siblings. Every level is written as a
    table of one row per parent; the ways up are built from the roots down, and are joined to the
    documents once per run of FANOUT.
    """
    own = [F.col(c) for c in COLUMNS]
    lowered = [F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if c == "text" else F.col(c) for c in COLUMNS]
    if tampered is None:
        tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    leaves = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", leaf_hash(own).alias("hash"), F.when(tampered, leaf_hash(lowered)).alias("changed")))
    ranked = _ranked(leaves, "source", ["doc_id", "hash"])
    kept = ("doc_id", "changed")
    levels = _levels(ranked.select("gid", "pos", "n", "hash", *kept), kept)
    subroots = stored(reduce(DataFrame.unionByName, [x.filter("n = 1").select("gid", "hash") for x in levels]))
    count = subroots.count()
    above = _levels(subroots.select(F.lit(0).cast("long").alias("gid"), F.col("gid").alias("pos"), F.lit(count).cast("long").alias("n"), "hash"))
    root = above[-1].filter("n = 1").select("hash").first()
    start = F.array().cast("array<struct<left:string,right:string>>")
    top = above[-1].filter("n = 1").select("gid", start.alias("path"))
    of_sources = _children(above[0], _ways(above, top)).select(F.col("pos").alias("gid"), F.col("hash").alias("subroot"), "path")
    of_sources = stored(of_sources)
    rows = _children(levels[0], _ways(levels, of_sources.select("gid", "path")), kept)
    whole = F.lit(root["hash"] if root else None)
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    folded = F.aggregate("path", F.coalesce("changed", "hash"), lambda node, p: F.sha2(F.concat(p["left"], node, p["right"]), 256))
    rows = rows.join(small(of_sources.select("gid", "subroot")), "gid")
    shown = rows.select("doc_id", F.col("hash").alias("leaf"), "subroot", whole.alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for each row of ``documents``,
    with the text of every fifth id (by crc32) in lower case for the check."""
    return proofs(table(spark, sf_dir, "documents"))


def _op13_sql(levels: int = 8) -> str:
    """Each tree in ``levels`` steps, enough for FANOUT ** levels nodes; ``d`` carries the documents up."""
    own = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in COLUMNS]
    lowered = [x.replace("text", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')") for x in own]
    # Each digit and then eight steps by a bit.
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, strlen(doc_id::VARCHAR) + 1),
        lambda i: list_prepend(ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT, [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END), 4294967295::BIGINT)"""
    parts = [
        f"""leaves AS MATERIALIZED (SELECT doc_id, source, row_number() OVER () AS id, sha256({' || '.join(own)}) AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {crc} % {TAMPERED} = 0 THEN sha256({' || '.join(lowered)}) END AS changed FROM documents)""",
        """d0 AS MATERIALIZED (SELECT id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS gid, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
  count(*) OVER (PARTITION BY source) AS n, leaf, coalesce(changed, leaf) AS fold, '' AS sibs FROM leaves)""",
        "t0 AS MATERIALIZED (SELECT gid, pos, n, leaf AS hash FROM d0)",
    ]
    step = """r{k} AS MATERIALIZED (SELECT gid, pos // {f} AS pos, n, list(hash ORDER BY pos) AS h FROM t{k} GROUP BY ALL),
t{m} AS MATERIALIZED (SELECT gid, pos, (n + {f} - 1) // {f} AS n, CASE WHEN n = 1 THEN h[1] ELSE sha256(array_to_string(h, '')) END AS hash FROM r{k}),
x{k} AS MATERIALIZED (SELECT id, d.gid, d.pos // {f} AS pos, r.n, leaf, fold, sibs, coalesce(array_to_string(h[1:d.pos % {f}], ''), '') AS l, coalesce(array_to_string(h[d.pos % {f} + 2:], ''), '') AS r
  FROM d{k} d JOIN r{k} r ON d.gid = r.gid AND d.pos // {f} = r.pos),
d{m} AS MATERIALIZED (SELECT id, gid, pos, (n + {f} - 1) // {f} AS n, leaf, CASE WHEN n = 1 THEN fold ELSE sha256(l || fold || r) END AS fold,
  CASE WHEN n = 1 THEN sibs ELSE sibs || l || r END AS sibs FROM x{k})"""
    steps = lambda ks: [step.replace("{k}", str(k)).replace("{m}", str(k + 1)).replace("{f}", str(FANOUT)) for k in ks]
    parts += steps(range(levels))
    a, b, end = levels, levels + 1, 2 * levels + 1
    parts += [f"t{b} AS MATERIALIZED (SELECT 0 AS gid, gid AS pos, count(*) OVER () AS n, hash FROM t{a})",
              f"d{b} AS MATERIALIZED (SELECT id, 0 AS gid, gid AS pos, leaf, fold, sibs FROM d{a})"]
    parts += steps(range(b, end))
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, l.leaf, s.hash AS subroot, r.hash AS root, sha256(e.sibs) AS proof_sha256, e.fold AS folded_root, e.fold = r.hash AS verified
FROM leaves l JOIN d{end} e USING (id) JOIN d{a} o USING (id) JOIN t{a} s ON o.gid = s.gid, t{end} r"""


OP13_SQL = _op13_sql()
