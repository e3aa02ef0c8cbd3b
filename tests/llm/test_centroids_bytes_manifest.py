"""Centroid clustering, byte-level BPE and the Merkle manifest against brute force and a library."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from arbormetric.llm import bytepairs, centroids, manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def clustered(rows, clusters, rounds, seed):
    """The definition on whole integers."""
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows]
    kept.sort(key=lambda r: (sha(f"{seed}:{'' if r[0] is None else r[0]}"), r[1]))
    centers = [v for _, v in kept[:clusters]]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    nearest = lambda v: min((far(v, c), n) for n, c in enumerate(centers))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        groups = [[v for (_, v), o in zip(kept, own, strict=True) if o == n] for n in range(len(centers))]
        centers = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centers, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    of = lambda n: sum(d for _, d, m in found if m == n)
    return sorted(((i, n, d, of(n), sum(x[1] for x in found), sha(",".join(map(str, centers[n])))) for i, d, n in found), key=repr)


@pytest.mark.parametrize("dimensions", [4, 7])
def test_clusters(spark, dimensions):
    rng = random.Random(dimensions)
    middles = [[rng.uniform(-2, 2) for _ in range(dimensions)] for _ in range(4)]
    vector = lambda: [m + rng.gauss(0, 0.4) for m in rng.choice(middles)]
    rows = [(i, vector()) for i in range(150)]
    # Repeated rows, ids and vectors, a null id, and ties between equal centroids.
    rows += [(3, rows[3][1]), (4, vector()), (None, vector()), (None, vector())] + [(i, [0.25] * dimensions) for i in range(200, 240)]
    away = [(500, None), (501, []), (502, [1.0] * (dimensions + 1)), (503, [None] + [1.0] * (dimensions - 1)),
            (504, [float("nan")] * dimensions), (505, [float("-inf")] * dimensions)]
    frame = spark.createDataFrame(rows + away, "vec_id long, embedding array<float>").withColumns({"key": F.lit(1), "cluster": F.lit("x"), "v": F.lit(0)})
    for clusters, rounds in ((5, 4), (3, 12), (400, 1)):
        got = centroids.cluster_vectors(frame, dimensions=dimensions, clusters=min(clusters, 60), rounds=rounds, seed=9)
        assert sorted(map(tuple, got.collect()), key=repr) == clustered(rows, min(clusters, 60), rounds, 9)
    few = frame.filter("vec_id between 10 and 12")
    assert sorted(map(tuple, centroids.cluster_vectors(few, dimensions=dimensions).collect()), key=repr) == clustered(rows[10:13], 8, 10, 3)
    none = centroids.cluster_vectors(frame.filter("vec_id >= 500"), dimensions=dimensions)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_too_large_components_raise(spark):
    frame = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="too large"):
        centroids.cluster_vectors(frame, dimensions=2).collect()


def test_intervals_hold_the_distances():
    rng = np.random.default_rng(5)
    v = rng.integers(-3000, 3000, (200, 6))
    borders = np.sort(np.concatenate([v.min(0)[:, None], rng.integers(-3000, 3000, (6, centroids.CELLS - 1)), v.max(0)[:, None]], axis=1), axis=1)
    centers = rng.integers(-4000, 4000, (5, 6))
    cell = np.stack([np.searchsorted(borders[i, 1:-1], v[:, i], "right") for i in range(6)], axis=1).astype(np.uint8)
    least, most = centroids.distance_tables(borders, centers)
    exact = ((v[:, None] - centers) ** 2).sum(axis=2)
    at = np.arange(6)
    for c in range(5):
        assert (least[c][at, cell].sum(axis=1) <= exact[:, c]).all() and (exact[:, c] <= most[c][at, cell].sum(axis=1)).all()
    near = centroids.candidates(cell[:, ::2] | cell[:, 1::2] << centroids.BITS, least, most)
    assert near[np.arange(200), exact.argmin(axis=1)].all() and not near.all()


TEXTS = [None, "", " ", "\n", "a\x00b \xff ÿþ", "a" * 70, "漢字 かな 한국어 😀😀  x", "it's we'll  \n\n  ", "▁▁ Ġ Ā￾￿ <unk> <|endoftext|>",
         "  　x ", " " * 300, "ab" * 900, "İstanbul ΣΑΣ é", "\r\n\t x\x1c\x85 y", "the quick brown fox " * 400]


def tiktoken_coder():
    import tiktoken

    ranks = bytepairs.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={p: i for i, p in enumerate(ranks)}, special_tokens={})


def test_byte_pairs_as_the_library(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rng = random.Random(4)
    texts = TEXTS + ["".join(chr(rng.choice([rng.randrange(1, 128), rng.randrange(128, 0xD800), 32, rng.randrange(0xE000, 0x1F700)])) for _ in range(200)) for _ in range(20)]
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "ids": F.lit(2)})
    library = tiktoken_coder()
    ids = [library.encode_ordinary(t or "") for _, t in rows]
    want = [(i, len(x), sha(" ".join(map(str, x))), sha(t or "")) for (i, t), x in zip(rows, ids, strict=True)]
    assert sorted(map(tuple, bytepairs.coded_digests(docs, "doc_id", "text", path, pattern).collect()), key=repr) == sorted(want, key=repr)
    encoded = bytepairs.encode_texts(docs, "doc_id", "text", path, pattern)
    assert sorted((r.doc_id, r.ids) for r in encoded.filter("doc_id is not null").collect()) == sorted((i, x) for (i, _), x in zip(rows, ids, strict=True) if i is not None)
    data = bytepairs.decode_ids(encoded, "doc_id", "ids", path, pattern).collect()
    assert sorted((repr(r.doc_id), bytes(r.data).decode()) for r in data) == sorted((repr(i), t or "") for i, t in rows)
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(bytepairs.decode_ids(none, "doc_id", "ids", path, pattern).first().data) == b""
    assert bytepairs.coded_digests(docs.limit(0), "doc_id", "text", path, pattern).count() == 0


def test_parts_of_a_text_are_the_text():
    coder = bytepairs.BytePairs(bytepairs.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    library = tiktoken_coder()
    for text in TEXTS[1:]:
        parts = [*coder.chunks(text, 7)]
        assert [i for p in parts for i in p.tolist()] == library.encode_ordinary(text)
        assert b"".join(map(coder.decode, parts)) == text.encode()


def test_a_piece_that_its_merges_miss():
    """With these ranks ``abc`` merges to ``ab`` and ``c``, but as a whole pre-token it is a piece."""
    import tiktoken

    ranks = [bytes([b]) for b in range(256)] + [b"ab", b"bcd", b"abc"[:3] + b"x", b"abc" + b"xy"]
    coder = bytepairs.BytePairs(ranks, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks={p: i for i, p in enumerate(ranks)}, special_tokens={})
    assert coder.apart
    for text in ("abcx", "abcxy bcd", "bcd", " abcx ab abcxabcx", "abcxy's"):
        assert [i for p in coder.chunks(text) for i in p.tolist()] == library.encode_ordinary(text)


def merkle(rows):
    """The manifest by plain loops."""
    digest = lambda values: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))
    lower = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def climb(nodes):
        """Root and, for each node, its steps (left, right)."""
        steps, above = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
            for n, own in enumerate(above):
                run, slot = runs[n // 16], n % 16
                for i in own:
                    steps[i].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            above = [[i for own in above[n : n + 16] for i in own] for n in range(0, len(above), 16)]
            nodes = [sha("".join(r)) for r in runs]
        return nodes[0], steps

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in sources:
        own = sorted((r for r in rows if r[1] == source), key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
        trees.append((own, *climb([digest(r) for r in own])))
    root, tops = climb([t[1] for t in trees])
    out = []
    for (own, subroot, steps), top in zip(trees, tops, strict=True):
        for row, way in zip(own, steps, strict=True):
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            fold = digest((*row[:4], lower(row[4]))) if changed else digest(row)
            for left, right in way + top:
                fold = sha(left + fold + right)
            out.append((row[0], digest(row), subroot, root, sha("".join(a + b for a, b in way + top)), fold, fold == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("seed", [0, 1])
def test_manifest(spark, seed):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", "Größe A", "no capitals", "x" * 5000, "ABC " * rng.randrange(1, 4)])
    rows = [(i, "hot", "en", i, text()) for i in rng.sample(range(-50, 1000), 300)]
    rows += [(i, f"s{i % 37}", rng.choice([None, "de"]), None, text()) for i in range(80)]
    # A null source, an empty one, a single row, equal ids, equal rows and null ids.
    rows += [(i, None, None, 1, "A") for i in range(17)] + [(5, "", "x", 2, "Q"), (7, "one", None, None, None), (7, "é", "x", 1, "A"), (7, "é", "x", 1, "A"), (7, "é", "x", 1, "B")]
    rows += [(None, "é", None, None, "T"), (None, "é", None, None, "U")] + [(9, "copies", "x", 1, "A")] * 40
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"pos": F.lit(1), "gid": F.lit(2), "hash": F.lit("x"), "n": F.lit(0)})
    got = manifest.proofs(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == merkle(rows)
    frame = docs.select("doc_id", "source", "lang", "n_chars", "text").toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"})
    db = duckdb.connect()
    db.register("documents", frame)
    from_sql = db.execute(manifest.OP13_SQL).fetchall()
    assert sorted(from_sql, key=repr) == merkle(rows)


def test_small_manifests(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert manifest.proofs(empty).count() == 0
    for rows in ([(10, "a", None, None, "T")], [(10, None, None, None, None)], [(n, "a", "e", 1, "T") for n in range(16)], [(n, f"{n}", "e", 1, "T") for n in range(17)]):
        got = manifest.proofs(spark.createDataFrame(rows, SCHEMA)).collect()
        assert sorted(map(tuple, got), key=repr) == merkle(rows)
