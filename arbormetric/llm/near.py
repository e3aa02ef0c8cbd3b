"""Near-duplicate documents by BagMinHash over multisets of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from arbormetric.llm.components import connected_components
from arbormetric.llm.tables import arrow_rows, byte_runs, fresh, small, stored, table

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 6
REGISTERS = BANDS * ROWS
#: Stands for a null id, and so goes before all others.
NO_ID = -(2**63)
#: Rows and bytes of text whose signatures are computed at once.
BATCH, BATCH_BYTES = 512, 1 << 20
#: Rows that a worker is handed at once.
ARROW_ROWS = 512
#: Buckets of up to FEW texts are compared pair by pair, larger ones in cells.
FEW = 16
CELL = 512
#: By how much a cell's overlap may fall short before its pair is dropped; rounding only.
SLACK = 1e-6


def _mixed(x: np.ndarray) -> np.ndarray:
    """Splitmix64, the public mixing function."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers and hashes of all shingles, sorted by both. Words are parted by white space
    and in lower case; a text of fewer words than a shingle has one of all its words, and one
    without words has none."""
    split = [t.lower().split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    flat = [w for s in split for w in s]
    if not flat:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    hashes = pd.util.hash_array(np.array(flat, dtype=object), categorize=True)
    doc = np.repeat(np.arange(len(split)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    start = np.flatnonzero((place + words <= sizes[doc]) | (place == 0))
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    total = np.zeros(len(start), np.uint64)
    for k in range(words):
        inside = place[start] + k < sizes[doc[start]]
        total = _mixed(total + np.where(inside, padded[start + k], np.uint64(0)))
    order = np.lexsort((total, doc[start]))
    return doc[start][order], total[order]


def _runs(doc: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of equal shingles of a document."""
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (x[1:] != x[:-1])])) if len(doc) else np.empty(0, np.int64)
    return first, np.diff(np.append(first, len(doc)))


def bag_minhash(doc: np.ndarray, x: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """Signatures (n, registers) of the multisets of shingles; two agree in a register with the
    probability of the multisets' weighted Jaccard similarity.

    A shingle of count c owns the weights [0, c). Its points in time and weight come from Poisson
    processes over [0, 1), [1, 2), [2, 4), [4, 8), ..., the same for every document, each point
    with a register; those at weights of c and more are thinned out, and a register keeps the
    earliest point. Points are drawn in order of time and only up to the time by which all
    registers of a document are likely to be filled; documents with a register left draw again
    with twice the time.
    """
    first, count = _runs(doc, x)
    levels = np.ceil(np.log2(count)).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(first)), levels)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.maximum(low, 1)
    owner_doc, most = doc[first][owner], count[owner]
    seed = _mixed(x[first][owner] + _mixed(level.astype(np.uint64)))
    total = np.bincount(doc, minlength=n).astype(float)
    limit = (np.log(registers) + 3) / np.maximum(total, 1)
    out = np.full((n, registers), np.inf)
    waiting = np.ones(len(owner), bool)
    while waiting.any():
        at = np.flatnonzero(waiting)
        time, k = np.zeros(len(at)), 0
        while len(at):
            draw = _mixed(seed[at] + np.uint64(k * 0xD1342543DE82EF95 % 2**64))
            time = time - np.log1p((draw >> np.uint64(11)).astype(float) * -(2.0**-53)) / (registers * width[at])
            soon = time <= limit[owner_doc[at]]
            at, time, draw, k = at[soon], time[soon], draw[soon], k + 1
            more = _mixed(draw)
            register = ((more >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)
            weight = low[at] + ((more & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32 * width[at]).astype(np.int64)
            own = weight < most[at]
            np.minimum.at(out.reshape(-1), owner_doc[at][own] * registers + register[own].astype(np.int64), time[own])
        open_docs = np.isinf(out).any(axis=1) & (total > 0)
        limit = np.where(open_docs, 2 * limit, limit)
        waiting = open_docs[owner_doc]
    return out


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    bits = signatures.view(np.uint64).reshape(len(signatures), BANDS, ROWS)
    total = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bits.shape[:2])
    for r in range(ROWS):
        total = _mixed(total + bits[:, :, r])
    return total.view(np.int64)


def _in_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in batches:
        for at, upto in byte_runs(batch.column(0), BATCH_BYTES, BATCH):
            part = batch.slice(at, upto - at)
            yield part, part.column(0).to_pylist()


def _signed(docs: DataFrame) -> DataFrame:
    """``id, h1, h2, n, bands`` per row, for texts that have words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _in_batches(batches):
            doc, x = shingles(texts)
            bands = band_hashes(bag_minhash(doc, x, len(texts)))
            size = np.bincount(doc, minlength=len(texts))
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]).astype(np.int32),
                                             pa.array(bands[size > 0].ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(size), lists], names=["id", "h1", "h2", "n", "bands"])

    return docs.select("text", "id", "h1", "h2").mapInArrow(sign, "id long, h1 long, h2 long, n long, bands array<long>")


def _sets(docs: DataFrame, half: bool = False) -> DataFrame:
    """``id, bag``: the sorted hashes of shingle and occurrence, eight bytes each; with ``half``
    their lower four bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _in_batches(batches):
            doc, x = shingles(texts)
            first, count = _runs(doc, x)
            x = x + _mixed((np.arange(len(x)) - np.repeat(first, count)).astype(np.uint64))
            x = x[np.lexsort((x, doc))]
            cuts = np.cumsum(np.bincount(doc, minlength=len(texts)))
            bags = [b.tobytes() for b in np.split(x.astype(np.uint32) if half else x, cuts[:-1])]
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(bags, pa.binary())], names=["id", "bag"])

    return docs.select("text", "id").mapInArrow(pack, "id long, bag binary")


def _overlaps(pairs: DataFrame) -> DataFrame:
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for p, q in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                found.append(shared / max(1, len(p) + len(q) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["a", "b", "similarity"])

    return pairs.select("a", "b", "bag_a", "bag_b").mapInArrow(compare, "a long, b long, similarity double")


def _texts(rows: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``text, id`` of the wanted nodes, ``id`` being the node; rows that repeat a node's id and text
    give it again."""
    own = nodes.join(wanted, "node", "left_semi").select("node", "id", "h1", "h2")
    return rows.join(small(stored(own)), ["id", "h1", "h2"]).select("text", F.col("node").alias("id"))


def verified(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs of nodes whose multisets overlap enough; every pair is compared in full."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    bags = stored(_sets(_texts(rows, nodes, wanted)).dropDuplicates(["id"]))
    first, second = bags.toDF("a", "bag_a"), bags.toDF("b", "bag_b")
    return _overlaps(pairs.join(first, "a").join(second, "b")).filter(F.col("similarity") >= similarity)


def _across(rows: DataFrame, nodes: DataFrame, placed: DataFrame, similarity: float, only: DataFrame | None = None) -> DataFrame:
    """Pairs ``a, b`` of different roots in large buckets that look similar enough by their
    shingles' lower 32 bits, which may raise an overlap but never lower it (values that a text holds
    several times count as often); of the partners of a text one for each root and cell is given,
    since one link joins the classes. With ``only(id)`` the partners of these texts are all given.

    A bucket's texts outside its main root meet all of its texts in cells of about CELL by CELL, so
    what a task holds is bounded, and only what is found leaves a cell.
    """
    if not placed.limit(1).count():
        return placed.select(F.col("id").alias("a"), F.col("id").alias("b"))
    wanted = placed.select(F.col("id").alias("node")).distinct()
    short = stored(_sets(_texts(rows, nodes, wanted), half=True).dropDuplicates(["id"]))
    heights, columns = F.ceil((F.col("of") - F.col("most")) / CELL).cast("int"), F.ceil(F.col("of") / CELL).cast("int")
    part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    minor = placed.filter("root <> main")
    minor = (minor if only is None else minor.join(only, "id", "left_semi")).select("key", part(heights).alias("i"), every(columns).alias("j"), F.lit(0).alias("side"), "id", "root")
    whole = placed.select("key", every(heights).alias("i"), part(columns).alias("j"), F.lit(1).alias("side"), "id", "root")
    cells = minor.union(whole).join(short, "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")

    whole_lists, slack = only is not None, SLACK

    def compare(cell: pd.DataFrame) -> list[tuple[int, int]]:
        bags = [np.frombuffer(b, np.uint32) for b in cell["bag"]]
        sizes = np.fromiter(map(len, bags), np.int64, len(bags))
        _, at = np.unique(np.concatenate(bags), return_inverse=True)
        own = np.repeat(np.arange(len(bags)), sizes)
        shared = np.bincount(at) > 1
        column = np.cumsum(shared) - 1
        keep = shared[at]
        first = int((cell["side"] == 0).sum())
        overlap = np.zeros((first, len(bags) - first), np.float32)
        for low in range(0, int(shared.sum()), 4096):  # So many columns of the matrix at once.
            matrix = np.zeros((len(bags), 4096), np.float32)
            now = keep & (column[at] >= low) & (column[at] < low + 4096)
            np.add.at(matrix, (own[now], column[at[now]] - low), 1)
            overlap += matrix[:first] @ matrix[first:].T
        root = cell["root"].to_numpy()
        total = sizes[:first, None] + sizes[None, first:] - overlap
        x, y = np.nonzero((overlap >= similarity * total * (1 - slack)) & (root[:first, None] != root[None, first:]))
        ids = cell["id"].to_numpy()
        if whole_lists:
            return [(min(ids[i], ids[first + j]), max(ids[i], ids[first + j])) for i, j in zip(x, y, strict=True)]
        found = {(ids[i], root[first + j]): ids[first + j] for i, j in zip(x, y, strict=True)}
        return [(min(a, b), max(a, b)) for (a, _), b in found.items()]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        for batch in batches:
            if waiting is not None:
                batch = pd.concat([waiting, batch], ignore_index=True)
            cell = batch[["key", "i", "j"]].ne(batch[["key", "i", "j"]].shift()).any(axis=1).cumsum()
            done = cell < cell.iloc[-1]
            waiting = batch[~done]
            found = [pair for _, c in batch[done].groupby(cell[done]) for pair in compare(c)]
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")
        if waiting is not None:
            yield pd.DataFrame(compare(waiting), columns=["a", "b"], dtype="int64")

    return cells.mapInPandas(walk, "a long, b long")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``id, h1, h2, root, root_h1, root_h2`` for every row of ``documents``: its id and text hashes, and
    those of its class's first document, the one of the smallest id and then hashes.

    Documents are in one class if their texts are equal or a chain of candidate pairs with a
    weighted Jaccard similarity of ``similarity`` or more joins them; candidates share one of the
    signature's bands. Equal texts stand for one another. Within a band's bucket every text is
    first compared with the smallest only, which joins most of a large group in as many comparisons
    as it has texts; then all candidates that are still in different classes are compared, pair by
    pair in small buckets and in cells of large ones, where a partner stands for its class and all are
    compared if it fails the exact check, so no link is lost. A null text is empty, texts
    without words only equal themselves, a null id counts as the smallest, and rows are one document
    only if they repeat both id and text: different texts of one id, null ids among them, are
    documents of their own.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"),
                       F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text, F.length(text)).alias("h2"))
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        signed = stored(_signed(rows))
    nodes = stored(signed.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
                   .withColumn("node", F.monotonically_increasing_id()))
    bands = nodes.select(F.col("node").alias("id"), "n", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.min(F.struct("id", "n")).alias("least"), F.count("*").alias("of")).filter("of > 1")
    fits = lambda a, b: F.least(a, b) >= similarity * F.greatest(a, b)
    members = stored(bands.join(shared, "key"))
    stars = stored(members.filter((F.col("id") != F.col("least.id")) & fits(F.col("n"), F.col("least.n")))
                   .select(F.col("least.id").alias("a"), F.col("id").alias("b")).distinct())
    links = stored(verified(rows, nodes, stars, similarity))
    roots = connected_components(links)
    placed = stored(members.select("key", "id", "n").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
    counts = placed.groupBy("key", "root").agg(F.count("*").alias("c"))
    mixed = counts.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots"), F.sum("c").alias("of"),
                                      F.max("c").alias("most")).filter("roots > 1")
    placed = stored(placed.join(mixed.select("key", "main", "of", "most"), "key"))
    found = stored(_across(rows, nodes, placed.filter(F.col("of") > FEW), similarity))
    few = placed.filter(F.col("of") <= FEW)
    minor = few.filter("root <> main").select("key", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("root_a"))
    rest = (minor.join(few.select("key", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("root_b")), "key")
            .filter((F.col("root_a") != F.col("root_b")) & fits(F.col("n_a"), F.col("n_b")))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(found).distinct())
    rest = stored(rest.join(stars, ["a", "b"], "left_anti"))
    if rest.limit(1).count():
        more = stored(verified(rows, nodes, rest, similarity))
        # Where the partner that stood for a class is none, all of the text's partners are compared.
        failed = stored(found.join(more, ["a", "b"], "left_anti").select(F.explode(F.array("a", "b")).alias("id")).distinct())
        if failed.limit(1).count():
            again = _across(rows, nodes, placed.filter(F.col("of") > FEW), similarity, failed).distinct()
            again = stored(again.join(rest.union(stars), ["a", "b"], "left_anti"))
            more = stored(more.union(verified(rows, nodes, again, similarity)))
        if more.limit(1).count():
            roots = connected_components(links.union(more))
    joined = nodes.select("node", "id", "h1", "h2").join(roots.toDF("node", "root"), "node")
    least = joined.groupBy("root").agg(F.min(F.struct("id", "h1", "h2")).alias("least"))
    moved = joined.join(least, "root").select("h1", "h2", "least")
    of_text = nodes.select("h1", "h2", "id").join(moved, ["h1", "h2"], "left").select("h1", "h2", F.coalesce("least", F.struct("id", "h1", "h2")).alias("least"))
    return (signed.select("id", "h1", "h2").join(of_text, ["h1", "h2"])
            .select("id", "h1", "h2", F.col("least.id").alias("root"), F.col("least.h1").alias("root_h1"), F.col("least.h2").alias("root_h2")))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` with one document of each class, its first; of rows that repeat its id
    and text one stays. All columns stay as they are."""
    key = fresh(docs, "own_id", "own_h1", "own_h2")
    text = F.coalesce("text", F.lit(""))
    of_row = (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(text), F.xxhash64(F.lit(7), text, F.length(text)))
    rows = docs.withColumns(dict(zip(key, of_row, strict=True)))
    classes = stored(near_classes(docs, similarity))
    first = F.struct("id", "h1", "h2") == F.struct(F.col("root").alias("id"), F.col("root_h1").alias("h1"), F.col("root_h2").alias("h2"))
    gone = stored(classes.filter(~first).select("id", "h1", "h2").distinct().toDF(*key))
    kept = rows.join(small(gone), key, "left_anti").select(*docs.columns, *key)
    again = stored(classes.filter(first).groupBy("id", "h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("id", "h1", "h2").toDF(*key))
    if not again.limit(1).count():
        return kept.drop(*key)
    once = kept.join(small(again), key, "left_semi").select(*kept.columns).dropDuplicates(key)
    return kept.join(small(again), key, "left_anti").select(*docs.columns).union(once.select(*docs.columns))


def op8_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, class_id, text_hash, class_text_hash``: the document's class is named by the smallest
    id in it and the hash of that one's text, which tells apart texts that share an id or have none."""
    classes = near_classes(table(spark, sf_dir, "documents"))
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return classes.select(shown("id").alias("doc_id"), shown("root").alias("class_id"), F.col("h1").alias("text_hash"), F.col("root_h1").alias("class_text_hash"))
