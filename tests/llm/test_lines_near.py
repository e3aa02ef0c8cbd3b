"""Line dedup, near-dedup and components against brute force on small rows."""

import random
from collections import Counter

import regex
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from arbormetric.llm import components as components_module, lines, near
from arbormetric.llm.components import connected_components
from arbormetric.llm.lines import BLOCKS, DISTANCE, SHARED, WORD, _edits_by_step, _edits_in_line, _lines, _simhash, _similar, line_groups, without_repeated_lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, **more):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).withColumns({k: F.lit(v) for k, v in more.items()})


def words(rng, n):
    return [rng.choice(["stone", "river", "cloud", "paper", "of", "the", "glass", "winter", "a"]) + str(rng.randrange(40)) for _ in range(n)]


def components(links, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (4, 4), (3, 1)] + [(100, i) for i in range(101, 140)]
    got = {r.id: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    ids = {i for link in links for i in link} - {4}
    assert got == {i: r for i, r in components(links, ids | {4}).items() if i != 4}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_are_read_while_their_ends_are_apart(spark, monkeypatch):
    """New links are joined to known components: those inside of one are not gone through again."""
    rng = random.Random(4)
    old = [(rng.randrange(i), i) for i in range(1, 120)] + [(rng.randrange(200, i), i) for i in range(201, 260)]
    new = [(5, 9), (250, 3), (7, 7), (300, 301), (301, 302), (400, 119)]
    frame = lambda links: spark.createDataFrame(links, "a long, b long")
    roots, sizes, stored = connected_components(frame(old)), [], components_module.stored

    def counted(df):
        out = stored(df)
        if df.columns == ["a", "b"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(components_module, "stored", counted)
    got = {r.id: r.root for r in components_module.joined_components(roots, frame(new)).collect()}
    ids = {i for link in old + new for i in link} - {7} | {7}
    assert got == components(old + new, ids)
    assert max(sizes) <= 2 * len(new)
    sizes.clear()
    assert {r.id: r.root for r in connected_components(frame(old)).collect()} == components(old, {i for link in old for i in link})
    # The links of a round are those between what the last one has joined.
    assert sizes[0] == 2 * len(old) and sum(sizes[1:]) < sizes[0]


def test_line_groups(spark):
    rng = random.Random(3)
    long = words(rng, 60)
    near_line = ", ".join(long).upper()
    changed = " ".join([*long[:30], "of", *long[30:]])
    texts = [
        (5, "Same line here!\n\n" + " ".join(long)), (2, "same  LINE here\nonly in two"), (7, None), (8, ""), (9, "...\n!!!"),
        (None, "of no id\nsame line here?"), (11, near_line + "\n" + changed + "\nlast one"), (12, "only in two\nonly in two"), (12, "only in two\nonly in two")]
    docs = docs_of(spark, texts, line="clash", first=1)
    got = {(r.id, r.line): tuple(r.first) for r in line_groups(docs).collect()}
    norm = {}
    for d, t in texts:
        for i, line in enumerate((t or "").split("\n")):
            if found := [w for w in regex.split(r"[^\p{L}\p{N}]+", line.lower()) if w]:
                norm[(near.NO_ID if d is None else d, i)] = " ".join(found)
    assert set(got) == set(norm)
    first = {}
    for place in sorted(norm):
        first.setdefault(norm[place], place)
    assert got[(5, 0)] == got[(2, 0)] == (near.NO_ID, 1)
    # A word too short to carry weight changes no hash: the line is a fuzzy copy.
    assert got[(11, 1)] == got[(11, 0)] == (5, 2)
    assert all(got[p] == first[norm[p]] for p in got if p[0] != 11)
    out = {(r.doc_id, r.text): r for r in without_repeated_lines(docs).collect()}
    assert without_repeated_lines(docs).columns == docs.columns
    assert (7, None) in out and (8, "") in out and (9, "...\n!!!") in out
    assert (11, "last one") in out and out[(11, "last one")].n_chars == 8
    assert not any(d == 12 for d, _ in out)
    assert (2, "only in two") in out and (5, "\n" + " ".join(long)) in out
    assert without_repeated_lines(docs.limit(0)).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def edited(rng, own, n):
    own = list(own)
    for _ in range(n):
        at = rng.randrange(len(own))
        own[at : at + rng.randrange(2)] = words(rng, rng.randrange(2)) if len(own) > 1 else words(rng, 1)
    return own


def test_similar_lines_are_told_by_their_edits(spark):
    """The words in line and the shortened edit matrix tell what the whole edit matrix tells."""
    rng = random.Random(9)
    pairs = [("a", "a b"), ("é ü", "é u"), ("x", "y"), ("same start and end", "same start or other end")]
    for _ in range(60):
        own = words(rng, rng.randrange(1, 30))
        pairs.append((" ".join(own), " ".join(edited(rng, own, rng.randrange(1, 9)))))
    rows = [(n, a, b, int(max(len(a), len(b)) * 0.2 + 1e-9)) for n, (a, b) in enumerate(pairs)]
    frame = spark.createDataFrame(rows, "n int, text_a string, text_b string, most int")
    got = {r.n for r in frame.filter(_similar()).collect()}
    want = {n for n, a, b, most in rows if edits(a, b) <= most}
    assert got == want and 0 < len(want) < len(rows)
    assert all(r.most_in_line >= edits(r.text_a, r.text_b) for r in frame.withColumn("most_in_line", _edits_in_line()).collect())


def test_gaps_in_several_places_need_no_edit_matrix(spark):
    """Words found again a few words ahead tell pairs that lose words in both lines, from either side."""
    rng, pairs = random.Random(12), []
    for _ in range(30):
        own = words(rng, 40)
        one, other = own[:5] + own[6:25] + own[26:], own[:15] + own[16:33] + own[34:]
        pairs.append((" ".join(one), " ".join(other)))
    gaps = len(pairs)
    pairs += [("a", "b c d"), ("b c d", "a"), ("a b", "b a"), ("a", "a"), ("x" * 3 * WORD, "x" * (3 * WORD - 1) + "y"), ("a " + "x" * 2 * WORD, "x" * 2 * WORD)]
    for _ in range(60):
        own = words(rng, rng.randrange(1, 30))
        pairs.append((" ".join(own), " ".join(edited(rng, own, rng.randrange(1, 20)))))
    rows = [(n, a, b, int(max(len(a), len(b)) * 0.2 + 1e-9)) for n, (a, b) in enumerate(pairs)]
    frame = spark.createDataFrame(rows, "n int, text_a string, text_b string, most int")
    got = {r.n: r for r in frame.select("n", "text_a", "text_b", "most", _edits_in_line().alias("line"), _edits_by_step().alias("step"), _similar().alias("similar")).collect()}
    assert all(min(r.line, r.step) >= edits(r.text_a, r.text_b) for r in got.values())
    assert all(r.similar == (edits(r.text_a, r.text_b) <= r.most) for r in got.values())
    assert all(got[n].step <= got[n].most for n in range(gaps)) and sum(got[n].line > got[n].most for n in range(gaps)) > gaps / 2
    # A long word's letters only count in the edit matrix, which is filled once.
    assert got[gaps + 4].line == got[gaps + 4].step == 3 * WORD and got[gaps + 4].similar


def test_only_lines_that_occur_again_look_up_their_first(spark, monkeypatch):
    """The last join has a row for a line that is repeated or near another one, none for all others."""
    rng, sizes = random.Random(14), []
    base = words(rng, 24)
    texts = [(n, " ".join("".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(12))) for n in range(50)]
    texts += [(60, "same line"), (61, " ".join(base)), (59, "Same, line!\n" + " ".join([*base[:9], "of", *base[9:]])), (58, " ".join(base) + "\nsame line")]
    hint = DataFrame.hint

    def counted(df, name, *more):
        if df.columns == ["h1", "h2", "known"]:
            sizes.append(df.count())
        return hint(df, name, *more)

    monkeypatch.setattr(DataFrame, "hint", counted)
    got = {(r.id, r.line): tuple(r.first) for r in line_groups(docs_of(spark, texts)).collect()}
    assert got == {(n, 0): (n, 0) for n in range(50)} | {(58, 0): (58, 0), (58, 1): (58, 1), (59, 0): (58, 1), (60, 0): (58, 1), (59, 1): (58, 0), (61, 0): (58, 0)}
    assert sizes == [3]


def test_fuzzy_links_are_complete(spark):
    """All pairs that share blocks, are within the distance and the similarity are in one group."""
    rng = random.Random(5)
    base = words(rng, 24)
    texts = [(i, " ".join(edited(rng, base, rng.randrange(6)))) for i in range(40)]
    docs = docs_of(spark, texts)
    sims = {r.id: r.sim & (2**64 - 1) for r in _simhash(_lines(docs)).collect()}
    starts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    shared = lambda x: sum(not (x >> s) & ((1 << w) - 1) for s, w in zip(starts, BLOCKS, strict=True))
    near_pairs = [(a, b) for a in sims for b in sims if a < b and (sims[a] ^ sims[b]).bit_count() <= DISTANCE and shared(sims[a] ^ sims[b]) >= SHARED]
    own = dict(texts)
    links = [(a, b) for a, b in near_pairs if edits(own[a], own[b]) <= max(len(own[a]), len(own[b])) * 0.2 + 1e-9]
    want = components(links, sims)
    got = {r.id: r.first.id for r in line_groups(docs).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """The ways through crowded and through other buckets give the same groups."""
    rng = random.Random(21)
    texts, base = [], words(rng, 24)
    for n in range(3):
        other = words(rng, 20)
        texts += [(100 * n + i, "\n".join([" ".join(edited(rng, base, rng.randrange(6))), " ".join(edited(rng, other, rng.randrange(3)))])) for i in range(10)]
    groups = lambda: {(r.id, r.line): tuple(r.first) for r in line_groups(docs_of(spark, texts)).collect()}
    want = groups()
    for crowd in (1, 4):
        monkeypatch.setattr(lines, "CROWD", crowd)
        monkeypatch.setattr(lines, "CROWD_SHARE", 1)
        assert groups() == want
    assert len(set(want.values())) < len(want)


def test_meetings_by_chance_are_not_written(spark, monkeypatch):
    """Lines that only share buckets cost no rows of stored tables beyond those of the lines."""
    monkeypatch.setattr(lines, "BLOCKS", (3, 3, 3, 3, 3, 3))
    sizes, stored = [], lines.stored

    def counted(df):
        out = stored(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(lines, "stored", counted)
    rng = random.Random(23)
    texts = [(n, " ".join("".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(12))) for n in range(120)]
    assert len({r.first for r in line_groups(docs_of(spark, texts)).collect()}) == 120
    assert max(sizes) <= 2 * 120


def test_bag_minhash_estimates_weighted_jaccard():
    rng = random.Random(1)
    a, b = words(rng, 300), None
    b = a[:250] + words(rng, 60) + a[:20]
    doc, x = near.shingles([" ".join(a), " ".join(b), "", "one two"], 1)
    found = near.bag_minhash(doc, x, 4, 2000)
    p, q = Counter(a), Counter(b)
    want = sum((p & q).values()) / sum((p | q).values())
    assert abs((found[0] == found[1]).mean() - want) < 0.05
    assert (found[2] == float("inf")).all()
    again = near.bag_minhash(*near.shingles([" ".join(b)], 1), 1, 2000)
    assert (again[0] == found[1]).all()


def test_near_classes(spark):
    rng = random.Random(7)
    texts, n = [], 0
    for _ in range(6):
        base = words(rng, rng.choice([4, 30, 120, 400]))
        for _ in range(rng.randrange(1, 8)):
            own = list(base)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = "changed"
            texts.append((n, " ".join(own)))
            n += 1
    repeated = " ".join(words(rng, 40))
    texts += [(n, None), (n + 1, ""), (n + 2, "  \n"), (n + 3, repeated * 3), (n + 4, repeated * 3), (n + 4, repeated * 3), (None, repeated * 3)]
    bags = {}
    for d, t in texts:
        w = (t or "").lower().split()
        bags[near.NO_ID if d is None else d] = (t or "", Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    links = []
    for a, (s, p) in bags.items():
        for b, (t, q) in bags.items():
            if a < b and (s == t or sum((p & q).values()) >= 0.8 * max(1, sum((p | q).values()))):
                links.append((a, b))
    want = components(links, bags)
    docs = docs_of(spark, texts, bands=1, id="x", __root=2)
    got = {r.id: r.root for r in near.near_classes(docs).collect()}
    assert got == want
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(near.NO_ID if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert near.near_classes(docs.limit(0)).count() == 0


def test_no_link_is_lost_where_a_stand_in_fails(spark, monkeypatch):
    """With a loose look at large buckets the partner that stands for a class often fails the exact
    check; the others of its class are compared then."""
    monkeypatch.setattr(near, "FEW", 1)
    monkeypatch.setattr(near, "CELL", 3)
    monkeypatch.setattr(near, "SLACK", 0.6)
    rng = random.Random(3)
    base, texts = words(rng, 60), []
    # Texts along a way: neighbours are similar, those further off are not, and all share bands.
    for n in range(14):
        texts.append((n, " ".join(base)))
        base = list(base)
        base[(4 * n) % 60] = f"new{n}"
    bags = {n: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for n, w in ((n, t.split()) for n, t in texts)}
    links = [(a, b) for a in bags for b in bags if a < b and sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values())]
    docs = docs_of(spark, rng.sample(texts, len(texts)))
    monkeypatch.setattr(near, "band_hashes", lambda s: near.np.tile(near.np.arange(near.BANDS), (len(s), 1)))
    assert {r.id: r.root for r in near.near_classes(docs).collect()} == components(links, bags)


def test_texts_that_share_an_id(spark):
    """Documents are told apart by id and text, null ids among them."""
    rng = random.Random(13)
    a, b, c, d, e = (words(rng, 60) for _ in range(5))
    near_of = lambda w: " ".join([*w, "changed"])
    text = " ".join
    texts = [(None, text(a)), (None, text(b)), (None, text(b)), (1, text(c)), (2, near_of(c)), (2, text(d)), (3, text(e)), (4, near_of(d)), (5, near_of(e)), (6, near_of(a))]
    docs = docs_of(spark, texts)
    kept = sorted((r.doc_id or 0, r.text) for r in near.keep_one(docs).collect())
    assert kept == sorted([(0, text(a)), (0, text(b)), (1, text(c)), (2, text(d)), (3, text(e))])
    classes = {(r.id, r.h1): (r.root, r.root_h1) for r in near.near_classes(docs).collect()}
    assert len(set(classes.values())) == 5


def test_cut_lines_of_texts_that_share_an_id(spark):
    rng = random.Random(17)
    lines = [" ".join(words(rng, 12)) for _ in range(7)]
    texts = [(None, lines[0] + "\n" + lines[1]), (None, lines[2] + "\n" + lines[3]), (None, lines[4] + "\n" + lines[1]), (3, lines[5] + "\n" + lines[1]), (3, lines[1] + "\n" + lines[6])]
    out = [r.text.split("\n") for r in without_repeated_lines(docs_of(spark, texts)).collect()]
    assert sorted(line for own in out for line in own) == sorted(lines) and len(out) == 5
