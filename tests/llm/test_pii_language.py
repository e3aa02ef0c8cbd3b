"""Personal data against Python's patterns; language on held-out rows."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from arbormetric.llm import language
from arbormetric.llm.language import accepted_documents
from arbormetric.llm.pii import BASE, KINDS, _valid, confident_patterns, find_personal_data, masked

#: The patterns as the contract gives them.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")[:4]) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans(spark):
    rng = random.Random(2)
    parts = ["a.b@c.de", "x@y", "@", "é", "😀", "1.2.3.4", "300.1.1.1", "007.0000255.1.0", "4539 1488 0343 6467", "4539148803436467", "12", "+1 (988) 555-2485",
             "+49", "-", " ", "\n", ".", "_", "%", "1", "0-0", "user_1@mail-2.example.co.uk", "+", "word", "5"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(150)]
    texts += ["", None, "1" * 5000, "a" * 5000, "1 " * 3000, "a@b.c" * 300, "a.b@c.d_e@f.gh"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: [tuple(s) for s in r.base] for r in find_personal_data(rows).collect()}
    assert got == {i: base_spans(t or "") for i, t in enumerate(texts)}


def test_validity(spark):
    cases = [("ip", "255.0.00.1", True), ("ip", "1.2.3.256", False), ("ip", "1.2.3.0000255", True), ("ip", "1.2.3.1000", False)]
    for kind, value, want in cases:
        assert spark.range(1).select(_valid(kind, F.lit(value))).first()[0] is want
    assert list(BASE) == list(KINDS)


def test_contexts_discover_unseen_identifiers(spark):
    texts = [f"text {i} phone: +1 (988) 555-24{i:02d} then more" for i in range(12)] + ["text phone: 0988 555 2477 then more", "order 0988 555 2477 went out"]
    texts += [f"mail bob{i}@x.org now" for i in range(8)] + ["mail bob (at) x.org now"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = {r.id: {tuple(s) for s in r.spans} - {tuple(s) for s in r.base} for r in find_personal_data(rows).collect()}
    assert found[12] == {("phone", 12, 25)} and not found[13]
    assert found[22] == {("email", 5, 19)}
    assert all(not v for k, v in found.items() if k not in (12, 22))


def test_two_generations(spark):
    """Numbers beside fixed-pattern phones are found first; the word beside those then finds more."""
    texts = [f"call phone: +1 (988) 555-24{i:02d} now" for i in range(12)]
    texts += [f"call phone: 0988 555 24{i:02d}, answered" for i in range(30, 40)]
    texts += ["the line 0988 555 2499, answered later", "order 0988 555 2498 went out"]
    texts += [f"from host 10.0.0.{i} up" for i in range(8)] + ["from host 10,0,0,99 up"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = {r.id: {(s.kind, texts[r.id][s.start:s.end]) for s in r.spans} - {(s.kind, texts[r.id][s.start:s.end]) for s in r.base}
             for r in find_personal_data(rows).collect()}
    assert all(found[i] == {("phone", f"0988 555 24{i + 18:02d}")} for i in range(12, 22))
    assert found[22] == {("phone", "0988 555 2499")} and not found[23]
    assert found[32] == {("ip", "10,0,0,99")}


def test_long_context_words_count_whole(spark):
    stem = "w" * 40
    texts = [f"{stem}a: +1 (988) 555-24{i:02d} x" for i in range(9)] + [f"{stem}a: 0988 555 2499 y", f"{stem}b: 0988 555 2498 z"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    more = {r.id: len(r.spans) - len(r.base) for r in find_personal_data(rows).collect()}
    assert more[9] == 1 and more[10] == 0


def test_pattern_scores(spark):
    edges = [("p", i, "ip", True) for i in range(6)] + [("p", 100, "ip", False), ("q", 100, "ip", False), ("q", 7, "card", True)]
    got = confident_patterns(spark.createDataFrame(edges, "pattern string, instance long, kind string, seed boolean")).collect()
    assert [tuple(r) for r in got] == [("p", "ip")]


def settled_patterns(edges, confidence=0.8, support=5, settled=1e-3):
    """Patterns taken and rounds of scores, without Spark."""
    edges, taken, rounds = set(edges), -1, 0
    while True:
        keys, of = {(p, k) for p, _, k, _ in edges}, {}
        for p, *_ in edges:
            of[p] = of.get(p, 0) + 1
        seeds = {key: sum(s for p, _, k, s in edges if (p, k) == key) for key in keys}
        score, rise = {key: seeds[key] / of[key[0]] for key in keys}, 1
        while rise > settled:
            beside = {}
            for p, i, k, s in edges:
                if not s:
                    beside.setdefault(i, []).append(score[p, k])
            newer = {key: (seeds[key] + sum(sum(beside[i]) / len(beside[i]) for p, i, k, s in edges if (p, k) == key and not s)) / of[key[0]] for key in keys}
            rise, score, rounds = max(newer[key] - score[key] for key in keys), newer, rounds + 1
        chosen = {key for key in keys if seeds[key] >= support and score[key] >= confidence}
        promoted = {i for p, i, k, s in edges if not s and (p, k) in chosen}
        if len(chosen) == taken or not promoted:
            return chosen, rounds
        taken, edges = len(chosen), {(p, i, k, s or i in promoted) for p, i, k, s in edges}


def test_rounds_of_scores_take_few_jobs(spark):
    """Every job, and every table sent to all executors, leaves something in the driver's memory."""
    edges = {(f"p{i // 8}", i, "ip", i % 4 > 0) for i in range(24)} | {(f"q{i % 3}", i, "ip", i % 4 > 0) for i in range(0, 24, 2)} | {("p0", 99, "card", True)}
    want, rounds = settled_patterns(edges)
    frame = spark.createDataFrame(sorted(edges), "pattern string, instance long, kind string, seed boolean")
    spark.sparkContext.setJobGroup("scores", "rounds of scores")
    try:
        got = {tuple(r) for r in confident_patterns(frame).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("scores"))
    assert got == want and rounds == 8
    assert jobs <= 9 * rounds, jobs


def test_language_stage_judges_texts_of_one_id_apart(spark):
    good, bad = "the house and the water over the hill with the old tree " * 8, "zqx wvk " * 3
    rows = [(i, good, "en", "s", 1) for i in range(12)] + [(None, good, "en", "s", 1), (None, "жизнь и вода " * 40, None, None, 1), (3, "жизнь и вода " * 40, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("row_key", F.lit(bad))
    kept = accepted_documents(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text[:3]) for r in kept.collect()) == sorted([(str(i), "the") for i in range(12)] + [("None", "the")])


def test_masked(spark):
    rows = [(1, "é mail a@b.cd and 1.2.3.4.", "en", "s", 26), (None, "x a@b.cd", "en", "s", 8), (3, None, "en", "s", 0), (4, "plain", "en", "s", 99), (1, "é mail a@b.cd and 1.2.3.4.", "en", "s", 26)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit(5)).withColumn("spans", F.lit("x"))
    out = masked(docs)
    assert out.columns == docs.columns
    got = sorted((r.text or "", r.n_chars) for r in out.collect())
    assert got == sorted([("é mail [EMAIL] and [IP].", 24)] * 2 + [("x [EMAIL]", 9), ("", 0), ("plain", 99)])
    assert masked(docs.limit(0)).count() == 0


def test_digest():
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_language(spark):
    rng = random.Random(4)
    of = {"en": ["the", "and", "house", "with", "water"], "de": ["der", "und", "haus", "mit", "wasser"], "fr": ["le", "et", "maison", "avec", "eau"]}
    text = lambda lang, n: " ".join(rng.choice(of[lang]) for _ in range(n))
    train = spark.createDataFrame([(i, text(lang, 30), lang) for i, lang in enumerate(list(of) * 20)], "doc_id long, text string, lang string")
    model = language.fit_text_model(train)
    rows = [(i, text(lang, 12), "xx" if i % 5 == 0 else lang, f"host{i % 3}.example.{lang}", lang) for i, lang in enumerate(list(of) * 30)]
    rows += [(900, None, "de", "host1.example.de", "de"), (901, "", None, None, None), (902, "жизнь " * 50, None, "x.org", None), (None, text("fr", 9), "fr", "", "fr")]
    frame = spark.createDataFrame(rows, "id long, text string, declared string, host string, truth string").withColumns({"n": F.lit(1), "prior": F.lit("p")})
    got = {r.id: r for r in language.identify(frame, model).collect()}
    assert all(got[i].language == truth and got[i].accepted for i, _, _, _, truth in rows if truth)
    assert not got[902].accepted
    assert abs(1 - got[0].posterior) < 0.01
    none = language.identify(frame, language.fit_text_model(train.limit(0))).collect()
    assert len(none) == len(rows) and not any(r.accepted for r in none)
    assert language.identify(frame.limit(0), model).count() == 0


def test_accepted_documents(spark):
    rows = [(i, "the house and the water " * 5, "en", "s", 1) for i in range(30)] + [(99, "жизнь и вода " * 40, None, "t", 2), (None, "the water", "en", "s", 3), (3, "the house", "en", "s", 4)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("x"))
    out = language.accepted_documents(docs)
    assert out.columns == docs.columns
    assert sorted(r.n_chars for r in out.collect()) == sorted(r[4] for r in rows if r[4] != 2)


def test_page_text(spark):
    page = "<html lang=de><script>var t='</p>';</script><style>p{}</style><p>Das&nbsp;Haus</p><SCRIPT>x</SCRIPT>"
    assert spark.range(1).select(language.page_text(F.lit(page))).first()[0].split() == ["Das", "Haus"]
