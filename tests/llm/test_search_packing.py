"""Top-k, packing, WARC, urls, fingerprints and pieces against brute force and round trips."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from arbormetric.llm import fingerprints, packing, pieces, topk, urls, warc
from arbormetric.llm.tables import scratch_folder


def test_exact_top_k(spark):
    rng = random.Random(1)
    vector = lambda: [rng.uniform(-2, 2) for _ in range(6)]
    rows = [(i, vector()) for i in range(120)] + [(200, None), (201, [1.0, None]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, vector()), (204, [1.0, 2.0]), (205, [])]
    rows += [(7, rows[7][1]), (8, vector()), (300, rows[5][1]), (301, rows[5][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit("clash"))
    vectors = frame.select("vec_id", topk.integer_vector(F.col("embedding")).alias("v"))
    sound = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for k, blocks in ((4, 2), (10, 3), (500, 2)):
        got = topk.exact_top_k(vectors, vectors.filter("vec_id % 20 = 0"), k, blocks, 32, 3).collect()
        want = []
        for q, v in {i: v for i, v in sound if i % 20 == 0}.items():
            best = sorted((-dot(v, w), i) for i, w in sound if i != q)[:k]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
        assert sorted(map(tuple, got)) == sorted(want)
    assert topk.exact_top_k(vectors.limit(0), vectors).count() == 0
    assert topk.exact_top_k(vectors, vectors.limit(0)).count() == 0


def test_best_fit():
    assert packing.best_fit([5, 4, 3, 2, 6], 8, 10) == ([0, 1, 0, 1, 2], [0, 0, 5, 4, 0])
    # With one open bin the fullest, and only, bin closes first.
    assert packing.best_fit([5, 4, 3, 8, 4], 8, 1)[0] == [0, 1, 1, 2, 3]
    rng = random.Random(2)
    lengths = [rng.randrange(1, 101) for _ in range(3000)]
    bins, offsets = packing.best_fit(lengths, 100, 16)
    filled = {}
    for n, b, o in zip(lengths, bins, offsets, strict=True):
        assert filled.get(b, 0) == o
        filled[b] = o + n
    assert max(filled.values()) <= 100 and len(filled) < 1.1 * sum(lengths) / 100


def test_words_are_asked_for_once(monkeypatch):
    """Words of earlier batches, with other signs or cases, do not go through the merges again; what is
    kept is bounded and changes no ids."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, asked = Tokenizer.from_file(path), []
    batches = [["stone river, stone", "it's Élan!"], ["Stone, RIVER élan, it's", None], ["", "River! İ \x01 <|endoftext|> a\u2028b"], ["stone ?! ... 12a Ünder; ×"] * 2]
    whole = packing.WordIds._of_words
    monkeypatch.setattr(packing.WordIds, "_of_words", lambda self, words: asked.extend(words) or whole(self, words))

    def check():
        encoder = packing.WordIds(path)
        asked.clear()
        for texts in batches:
            got = encoder.encode(pa.array([t or "" for t in texts], pa.string()))
            assert [ids.tolist() for ids in got] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        return encoder

    check()
    assert len(asked) == len(set(asked)) and {"stone", "river", "élan", "it's"} <= set(asked) and not {"Stone,", "RIVER"} & set(asked)
    for name, most in (("REMEMBERED", 3), ("REMEMBERED_BYTES", 1)):
        monkeypatch.setattr(packing, name, most)
        assert len(check().known) < 12


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [(1, "Hello world, it's" * 40), (2, None), (3, ""), (None, "a\x1cb\x01 <|endoftext|>x İstanbul ΣΑΣ"), (5, "word " * 700), (5, "word " * 700), (6, "é ́e\u2028b " * 9)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("piece", F.lit(1))
    got = packing.pack(packing.token_pieces(docs, "doc_id", "text", path, 256), 7, 256, shard_rows=4).collect()
    tokenizer = Tokenizer.from_file(path)
    want = []
    for doc, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(str(doc), p, s, len(ids[s : s + 256]), zlib.crc32(np.array(ids[s : s + 256], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 256))]
    assert sorted((str(r.doc), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 256
    assert packing.pack_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc(spark, compression):
    inner = warc.MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    long = "x" * 120
    rows = [(1, "http://a/b", long), (2, "http://a/ c\n", long), (3, None, None), (4, "u", ""), (5, "u", inner * 4), (6, "u", inner + "é😀"), (7, "u", "WARC/1.1"),
            (8, "u", "short"), (9, "u", "short"), (10, "u", inner * 4), (1, "u", long), (None, "u", long), (12, "u", warc.MAGIC + "no header"), (13, "u", warc.END * 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "k": F.lit("x")})
    path = scratch_folder(spark)
    warc.write_warc(pages.coalesce(1), path, "page_id", "url", "html", compression=compression)
    records = warc.read_warc(spark, path)
    got = sorted(map(tuple, warc.page_records(records).collect()), key=str)
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        again = h in first and i != first[h]
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert got == sorted(want, key=str)
    bodies = sorted(bytes(r.block).split(b"\r\n\r\n", 1)[1] for r in records.collect() if "WARC-Type: response" in r.head)
    assert bodies == sorted((h or "").encode() for i, _, h in rows if not (h in first and i != first[h]))
    empty = scratch_folder(spark)
    warc.write_warc(pages.limit(0), empty, "page_id", "url", "html")
    assert warc.page_records(warc.read_warc(spark, empty)).count() == 0


def test_revisits_of_an_id_with_two_payloads(spark):
    """Page 1 stands twice; the copy of its shorter payload keeps that one's size and digest."""
    import duckdb

    rows = [(1, "u", "x" * 120), (1, "u", "y" * 300), (2, "u", "x" * 120), (3, "u", "y" * 300)]
    path = scratch_folder(spark)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_warc(pages, path, "page_id", "url", "html")
    got = sorted(map(tuple, warc.page_records(warc.read_warc(spark, path)).collect()), key=str)
    db = duckdb.connect()
    db.register("pages", pages.toPandas())
    assert got == sorted(db.execute(warc.OP7_SQL).fetchall(), key=str)
    assert [r[1:] for r in got if r[0] == 2] == [(120, hashlib.sha256(b"x" * 120).hexdigest(), "revisit", 1)]


def test_a_damaged_archive_ends_its_chain(spark, tmp_path):
    record = lambda i, n: f"{warc.MAGIC}WARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {n}\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((record(1, 3) + record(2, 5) + record(3, 3)).encode())
    (tmp_path / "b.warc").write_bytes(("junk" + record(4, 3)).encode())
    heads = [r.head for r in warc.read_warc(spark, str(tmp_path)).collect()]
    assert len(heads) == 1 and "urn:page:1>" in heads[0]


URL_SQL = """
WITH parts AS (SELECT page_id, translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(verdict, rule) AS (VALUES ('block', 'net/'), ('allow', 'example.net/en/'), ('block', 'example.com/de/'), ('allow', 'org/fr/')),
fits AS (SELECT page_id, arg_max((rule, verdict), len(rule)) AS best FROM parts, rules
  WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY page_id)
SELECT page_id, coalesce(host, ''), coalesce(path, ''), best[1], best[2] FROM parts LEFT JOIN fits USING (page_id)
"""


def test_url_rules_by_sql(spark):
    import duckdb

    rng = random.Random(8)
    some = lambda *xs: rng.choice(xs)
    named = [some("http", "HTTPS", "") + some("://", "://", "//") + some("", "a.", "Www.", "not") + some("example", "EXAMPLE", "x") + some(".net", ".com", ".org", "", ".net:80")
            + some("", "/", "/en/", "/de/x", "/fr/", "/EN/", "/en?", "/fr/#y", "?/en/", "/a://b/en/") for _ in range(300)]
    pages = spark.createDataFrame([(i, None if i == 7 else u) for i, u in enumerate(named)], "page_id long, url string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in urls_of(pages)]
    db = duckdb.connect()
    db.register("pages", pages.toPandas())
    assert sorted(got, key=str) == sorted(db.execute(URL_SQL).fetchall(), key=str)


def urls_of(pages):
    return urls.judge_urls(pages).collect()


def test_rare_labels_are_drawn(spark):
    labelled = spark.range(40_000).selectExpr("concat('u', id) as url", "id as key", "if(id % 4000 = 0, 1.0D, 0.0D) as label", *[f"0.0D as {f}" for f in urls.FEATURES])
    model = urls.fit_trees(labelled, 50)
    assert not isinstance(model, float)


def test_urls(spark):
    rows = [(1, "https://Blog.A.NET/x?y"), (2, "http://www.example.net/en/1#t"), (3, "http://example.com/de/"), (4, "http://example.com/de"), (5, "x://a.org/fr/z"),
            (6, None), (7, "no scheme"), (8, "http://net"), (9, "http://notnet/"), (10, "http://É.net/"), (11, "a://b://c.net/"), (2, "http://www.example.net/en/1#t")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("x"), "label": F.lit(3)})
    got = {r.page_id: r for r in urls.judge_urls(pages).collect()}
    assert {i: (r.host, r.path, r.rule) for i, r in got.items()} == {
        1: ("blog.a.net", "/x", "net/"), 2: ("www.example.net", "/en/1", "example.net/en/"), 3: ("example.com", "/de/", "example.com/de/"), 4: ("example.com", "/de", None),
        5: ("a.org", "/fr/z", "org/fr/"), 6: ("", "", None), 7: ("", "", None), 8: ("net", "", None), 9: ("notnet", "/", None), 10: ("É.net", "/", "net/"), 11: ("b:", "//c.net/", None)}
    assert {r.verdict for r in got.values()} <= {"block", "allow"} and got[1].verdict == "block" and got[2].verdict == "allow"
    assert urls.judge_urls(pages.limit(0)).count() == 0
    assert all(r.verdict == "allow" for r in urls.judge_urls(pages.filter("page_id in (6, 7)")).collect())


def test_url_trees_learn(spark):
    """Held-out accuracy on urls whose labels follow from their form."""
    rng = random.Random(6)
    rows = []
    for i in range(400):
        bad = i % 2
        host = f"{'win-cash-' if bad else 'blog'}{rng.randrange(99)}.{'xyz' if rng.random() < 0.5 else 'info'}"
        rows.append((i, f"http://{host}/{'p' * rng.randrange(1, 5)}{'?a=1&b=2&c=3' if bad else ''}"))
    rules = [("block" if "win-" in u else "allow", re.sub(r"^http://([^?]*).*", r"\1", u)) for _, u in rows[:200]]
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=rules[:120]).collect()}
    held = [(got[i].verdict == "block") == bool(i % 2) for i in range(200, 400) if got[i].rule is None]
    assert len(held) > 50 and sum(held) >= 0.95 * len(held)


def test_prefix_hashes():
    rng = random.Random(8)
    text = "".join(rng.choice("ab😀é") for _ in range(400))
    other = text[37:300] + "x" + text
    a, b = fingerprints.PrefixHash(text), fingerprints.PrefixHash(other)
    for _ in range(300):
        i, j, n = rng.randrange(350), rng.randrange(350), rng.randrange(50)
        assert (a.span(i, i + n) == b.span(j, j + n)) == (text[i : i + n] == other[j : j + n])
        assert fingerprints.common_extension(a, i, b, j) == len(os.path.commonprefix([text[i:], other[j:]]))


def test_fingerprints(spark):
    rng = random.Random(9)
    rows = [(i * 3, " ".join(rng.choice(["stone", "é", "😀", "river"]) for _ in range(rng.randrange(0, 60)))) for i in range(40)]
    rows += [(500, None), (501, ""), (502, "x"), (503, rows[4][1]), (None, "of no id"), (504, "same"), (504, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "part": F.lit("x")})
    got = sorted(fingerprints.fingerprint_documents(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert len(got) == len(ordered)
    for n, (r, (i, t)) in enumerate(zip(got, ordered, strict=True)):
        following = ordered[(n + 1) % len(ordered)][1]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        own, new = fingerprints.Document(t), fingerprints.Document(edited)
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (i, len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (own.fingerprint, new.fingerprint)
        assert r.near_edited == fingerprints.likeness(own.sketch, new.sketch) and 0 <= r.near_next <= 1
        assert r.common_prefix == len(os.path.commonprefix([t, edited]))
    single = fingerprints.fingerprint_documents(docs.filter("doc_id = 0")).collect()
    assert single[0].edited_sha256 and fingerprints.fingerprint_documents(docs.limit(0)).count() == 0


def test_pieces(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    sampler = pieces.Sampler(model)
    texts = ["", "a", " a", "  two  blanks\n\nlines ", "▁ literal ▁", "日本語 😀 é\x00", "x" * 2000, "the same words and the same words"]
    for text in texts:
        ids = sampler.encode([text], [3])[0]
        assert sampler.model.decode(ids).decode() == text
    alone = [sampler.encode([t], [k])[0].tolist() for k, t in enumerate(texts)]
    assert [i.tolist() for i in sampler.encode(texts, list(range(len(texts))))] == alone
    drawn = {tuple(sampler.encode(["unbelievable thing"], [k])[0].tolist()) for k in range(200)}
    assert len(drawn) > 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, ""), (None, None), (3, texts[3])], "doc_id long, text string").withColumn("ids", F.lit(1))
    got = pieces.sample_pieces(docs).collect()
    assert len(got) == docs.count() and all(r.lossless and r.n_pieces == len(r.ids) for r in got)
    assert len({tuple(r.ids) for r in got if r.doc_id == 3}) == 1
    assert pieces.sample_pieces(docs.limit(0)).count() == 0


def test_sampling_follows_the_lattice():
    """Frequencies of all segmentations of a word against their exact probabilities."""
    from itertools import combinations

    sampler = pieces.Sampler(public_tokenizers.path("piece_bpe_32k.model"))
    model = sampler.model
    score = {model.texts[model.piece[n]]: (int(model.piece[n]), model.score[n]) for n in np.flatnonzero(model.piece >= 0)}
    word, weight = b" there", {}
    for n in range(len(word)):
        for cuts in combinations(range(1, len(word)), n):
            parts = [word[i:j] for i, j in zip((0, *cuts), (*cuts, len(word)), strict=True)]
            if all(p in score for p in parts):
                weight[tuple(score[p][0] for p in parts)] = np.exp(sum(score[p][1] for p in parts))
    n = 20_000
    found = {}
    for ids in sampler.encode(["there"] * n, list(range(n))):
        found[tuple(ids.tolist())] = found.get(tuple(ids.tolist()), 0) + 1
    assert set(found) <= set(weight)
    total = sum(weight.values())
    for ids, w in weight.items():
        p = w / total
        assert abs(found.get(ids, 0) / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-4
