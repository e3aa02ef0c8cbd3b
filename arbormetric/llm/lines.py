"""Fuzzy line deduplication: SimHash, pigeonhole blocks, edit similarity, connected groups."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from arbormetric.llm.components import connected_components, joined_components
from arbormetric.llm.tables import BROADCAST_ROWS, fresh, small, stored, table

#: Blocks that a SimHash is cut into, and how many of them a candidate pair shares: hashes that
#: differ in up to len(BLOCKS) - SHARED bits always do, and most of those up to DISTANCE, the most
#: that a candidate pair may differ in.
BLOCKS = (11, 11, 11, 11, 10, 10)
SHARED = 2
DISTANCE = 9
SIMILARITY = 0.8
#: Buckets of about so many lines are crowded, as told by one line in CROWD_SHARE; which way a
#: bucket is taken changes its cost, not its links.
CROWD = 128
CROWD_SHARE = 16
#: Unequal words are compared letter by letter up to this length in the bounds of edits; longer
#: ones count as changed throughout, as lines in scripts without blanks are one word.
WORD = 64
#: Words that are looked ahead for the counterpart of a word.
AHEAD = 4
#: Words of fewer letters carry no weight in lines that have longer ones.
LETTERS = 4
#: Stands for a null id, and so goes before all others.
NO_ID = -(2**63)
BREAK = r"[^\p{L}\p{N}]+"
#: Three counters of 21 bits in a long; the last counter is that of the sign bit.
LANES = (1 << 42) | (1 << 21) | 1


def line_words(line: Column) -> Column:
    """The words of the normalised line: lower case, without signs and blanks."""
    return F.array_remove(F.split(F.lower(line), BREAK), "")


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _raw_lines(docs: DataFrame) -> DataFrame:
    """``id, doc, line, own`` for each line; ``doc`` is the text's hash, which tells apart the documents
    of an id."""
    # Split below the outer form, which infers no filter: the text does not go along with its lines.
    split = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), _text_hash().alias("doc"), F.split(F.coalesce("text", F.lit("")), "\n").alias("all"))
    return split.select("id", "doc", F.posexplode_outer("all").alias("line", "own"))


def _lines(docs: DataFrame) -> DataFrame:
    """``id, doc, line, words`` for each line."""
    return _raw_lines(docs).select("id", "doc", "line", line_words(F.col("own")).alias("words"))


def _simhash(lines: DataFrame) -> DataFrame:
    """``id, doc, line, h1, h2, chars, sim`` for each line that has words; ``chars`` is the length of the
    normal form. The words' hashes are summed up bit by
    bit, three counters in a long, by one aggregation that combines before the shuffle. A
    counter holds a million words; beyond that it runs into its neighbour, alike for equal lines."""
    long_words = F.filter("words", lambda w: F.length(w) >= LETTERS)
    normal = lines.select("id", "doc", "line", F.array_join("words", " ").alias("own"), "words")
    keyed = normal.select("id", "doc", "line", F.xxhash64("own").alias("h1"), F.xxhash64(F.lit(7), "own").alias("h2"), F.length("own").cast("long").alias("chars"), "words", long_words.alias("long"))
    each = keyed.select("id", "doc", "line", "h1", "h2", "chars", F.explode_outer(F.when(F.size("long") > 0, F.col("long")).otherwise(F.col("words"))).alias("w"))
    each = each.filter("w is not null").select("id", "doc", "line", "h1", "h2", "chars", F.xxhash64("w").alias("x"))
    sums = [F.sum(F.shiftrightunsigned("x", i).bitwiseAND(F.lit(LANES))).alias(f"s{i}") for i in range(21)]
    sums = each.groupBy("id", "doc", "line", "h1", "h2", "chars").agg(F.count("*").alias("n"), F.sum(F.shiftrightunsigned("x", 63)).alias("s63"), *sums)
    # A counter is over half of n if, raised by the rest to 2^20, it reaches bit 20.
    rest = (F.lit((1 << 20) - 1) - F.floor(F.col("n") / 2)) * F.lit(LANES)
    bits = [F.shiftleft(F.shiftrightunsigned(F.col(f"s{i}") + rest, 20).bitwiseAND(F.lit(LANES)), i) for i in range(21)]
    bits.append(F.when(F.col("s63") * 2 > F.col("n"), F.lit(-(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return sums.select("id", "doc", "line", "h1", "h2", "chars", reduce(lambda a, b: a.bitwiseOR(b), bits).alias("sim"))


def _keys(sim: str) -> Column:
    """The keys of a hash: every choice of whole blocks in which a candidate has to agree."""
    starts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    block = [F.shiftrightunsigned(sim, s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(starts, BLOCKS, strict=True)]
    keys = []
    for n, chosen in enumerate(combinations(range(len(BLOCKS)), SHARED)):
        key = F.lit(n).cast("long")
        for i in chosen:
            key = F.shiftleft(key, BLOCKS[i]).bitwiseOR(block[i])
        keys.append(key)
    return F.array(*keys)


def _most_edits(chars_a: str, chars_b: str, similarity: float) -> Column:
    return F.floor(F.greatest(chars_a, chars_b) * (1 - similarity) + 1e-9)


def _near(a: str, b: str, similarity: float) -> Column:
    """Whether two lines ``sim_*, chars_*`` can be similar: near hashes, and lengths that the
    allowed edits can make equal."""
    return ((F.bit_count(F.col(f"sim_{a}").bitwiseXOR(F.col(f"sim_{b}"))) <= DISTANCE)
            & (F.abs(F.col(f"chars_{a}") - F.col(f"chars_{b}")) <= _most_edits(f"chars_{a}", f"chars_{b}", similarity)))


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs of nodes whose normalised lines are similar by edit distance, read in full."""
    ids = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    wanted = stored(nodes.join(small(ids), "node").select("node", "h1", "first.*"))
    texts = _wanted_lines(docs, wanted).filter(F.xxhash64("own") == F.col("h1"))
    texts = stored(texts.groupBy("node").agg(F.min("own").alias("own")))
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    both = both.withColumn("most", _most_edits(F.length("text_a"), F.length("text_b"), similarity).cast("int"))
    # Few bytes, much work: dealt out anew, so that the pairs are not put together in a few tasks.
    both = both.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return both.filter(_similar()).select("a", "b")


def _wanted_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, h1, own`` for ``wanted(node, h1, id, doc, line)``: the normalised lines, of documents that
    are split only if a line of theirs is wanted."""
    asked = wanted.groupBy("id", "doc").agg(F.collect_list(F.struct("node", "h1", "line")).alias("asked"))
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), _text_hash().alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    found = _let(F.split("text", "\n"), lambda own: F.transform("asked", lambda x: F.struct(x.node.alias("node"), x.h1.alias("h1"), F.get(own, x.line).alias("own"))))
    lines = texts.join(asked, ["id", "doc"]).select(F.explode(found).alias("x")).select("x.*")
    return lines.select("node", "h1", F.array_join(line_words(F.col("own")), " ").alias("own"))


def _similar() -> Column:
    """Whether ``text_a`` and ``text_b`` are ``most`` edits apart or less. Words that stand in line with one
    another mostly tell, or those that are found again a few words ahead; otherwise the edit matrix, which grows with the
    square of what is compared, does without what both lines begin or end with. It is filled once: Spark walks along the
    whole line for every row of it, so a narrower try first costs much and seldom tells what the words don't."""
    turned = lambda p: F.struct(F.reverse(p.a).alias("a"), F.reverse(p.b).alias("b"))
    inner = _let(_without_common_start(F.struct(F.col("text_a").alias("a"), F.col("text_b").alias("b"))), lambda p: _without_common_start(turned(p)))
    told = (_edits_in_line() <= F.col("most")) | (_edits_by_step() <= F.col("most"))
    return told | _let(inner, lambda p: F.call_function("levenshtein", p.a, p.b, F.col("most")) >= 0)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _without_common_start(pair: Column) -> Column:
    """``a`` and ``b`` without their longest common start, found by binary search."""
    steps = F.array(*(F.lit(1 << i) for i in range(30, -1, -1)))

    def longer(p: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda n, step: F.when(
            (step <= p.least - n) & (p.a.substr(F.lit(1), n + step) == p.b.substr(F.lit(1), n + step)), n + step).otherwise(n))

    def cut(p: Column) -> Column:
        return _let(longer(p), lambda n: F.struct(p.a.substr(n + 1, F.length(p.a)).alias("a"), p.b.substr(n + 1, F.length(p.b)).alias("b")))

    return _let(_let(pair, lambda p: F.struct(p.a.alias("a"), p.b.alias("b"), F.least(F.length(p.a), F.length(p.b)).alias("least"))), cut)


def _change(a: str, b: str) -> str:
    """SQL for the edits, or more, that make word ``a`` word ``b``."""
    return f"if({a} = {b}, 0, if(greatest(length({a}), length({b})) > {WORD}, greatest(length({a}), length({b})), levenshtein({a}, {b})))"


def _edits_by_step() -> Column:
    """Edits that surely make ``text_a`` into ``text_b``, at a cost in proportion to their words: the words of
    ``text_a`` are gone through, ``j`` is the place of the next one of ``text_b``. Where they differ, the nearer of
    both that is found again a few words ahead in the other line tells what is added or taken away; else one is changed into the other."""
    found = f"named_struct('added', array_position(slice(w.b, s.j + 2, {AHEAD}), w.a[i]), 'gone', array_position(slice(w.a, i + 2, {AHEAD}), w.b[s.j]))"
    next_gone = "named_struct('j', s.j, 'edits', s.edits + length(w.a[i]) + 1)"
    step = f"""case when s.j >= size(w.b) then {next_gone}
        when w.a[i] = w.b[s.j] then named_struct('j', s.j + 1, 'edits', s.edits)
        else transform(array({found}), f -> case
            when f.added > 0 and (f.gone = 0 or f.added <= f.gone)
                then named_struct('j', s.j + int(f.added) + 1, 'edits', s.edits + length(array_join(slice(w.b, s.j + 1, int(f.added)), ' ')) + 1)
            when f.gone > 0 then {next_gone}
            else named_struct('j', s.j + 1, 'edits', s.edits + {_change('w.a[i]', 'w.b[s.j]')}) end)[0] end"""
    rest = "s.edits + if(s.j < size(w.b), length(array_join(slice(w.b, s.j + 1, size(w.b)), ' ')) + 1, 0)"
    fold = f"aggregate(sequence(0, size(w.a) - 1), named_struct('j', 0, 'edits', 0), (s, i) -> {step}, s -> {rest})"
    return F.expr(f"transform(array(named_struct('a', split(text_a, ' '), 'b', split(text_b, ' '))), w -> {fold})[0]")


def _edits_in_line() -> Column:
    """Edits that surely make one of ``text_a, text_b`` the other, at a cost in proportion to their
    words: every word of the line of fewer words is changed into its counterpart, counted from
    the start up to some word and from the end after it, and the other line's words between
    are added. Each step of the fold keeps the least for both ways of counting."""
    fewer = "size(split(text_a, ' ')) <= size(split(text_b, ' '))"
    short, long = (f"split(if({fewer}, text_{x}, text_{y}), ' ')" for x, y in ("ab", "ba"))
    # Matched words of the longer line are taken off the price of adding it whole.
    price = _change("w.short[i]", "w.long[{0}]") + " - length(w.long[{0}]) - 1"
    step = f"named_struct('start', s.start + {price.format('i')}, 'end', least(s.start, s.end) + {price.format('i + size(w.long) - size(w.short)')})"
    fold = f"aggregate(sequence(0, size(w.short) - 1), named_struct('start', 0, 'end', 0), (s, i) -> {step}, s -> least(s.start, s.end))"
    return F.expr(f"transform(array(named_struct('short', {short}, 'long', {long})), w -> {fold} + length(array_join(w.long, ' ')) + 1)[0]")


def _linked(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``nodes`` with the ``root`` of their group so far."""
    known = roots.toDF("node", "known")
    return nodes.join(known, "node", "left").withColumn("root", F.coalesce("known", "node")).drop("known")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``a, b`` of the pairs that are not in one group so far."""
    known = pairs.join(roots.toDF("a", "root_a"), "a", "left").join(roots.toDF("b", "root_b"), "b", "left")
    return known.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _blocks(nodes: DataFrame) -> DataFrame:
    """``nodes`` once for every key of their hashes."""
    return nodes.select("*", F.explode(_keys("sim")).alias("key"))


def _near_pairs(blocks: DataFrame, similarity: float) -> DataFrame:
    """``a, b, bits``: all lines ``node, sim, chars, root, key`` that share a key, can be similar and are
    in different groups, where they have any. Pairs by chance end in the join, so only near ones are ever written. Buckets
    are small here: they are looked up by key instead of being sorted on both sides."""
    one, other = (blocks.select("key", *(F.col(c).alias(f"{c}_{n}") for c in blocks.columns if c != "key")) for n in "ab")
    met = one.join(other.hint("shuffle_hash"), "key").filter((F.col("node_a") < F.col("node_b")) & _near("a", "b", similarity))
    if "root" in blocks.columns:
        met = met.filter(F.col("root_a") != F.col("root_b"))
    return met.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(F.min(F.bit_count(F.col("sim_a").bitwiseXOR(F.col("sim_b")))).alias("bits"))


def _best_pairs(near: DataFrame) -> DataFrame:
    """``a, b``: of each line's ``near`` pairs with smaller lines that of the smallest and that of the most alike."""
    best = near.groupBy("b").agg(F.min("a").alias("least"), F.min(F.struct("bits", "a")).alias("next"))
    return best.select(F.explode(F.array_distinct(F.array("least", "next.a"))).alias("a"), "b")


def _first_candidates(crowded: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: for every line of the crowded buckets the smallest line of a bucket that can be
    similar, and the most alike of the lines that follow it in the order of the hashes."""
    bucket = Window.partitionBy("key").orderBy("sim", "node")
    own = {"sim": "sim_o", "chars": "chars_o"}
    both = crowded.withColumns({f"{c}_l": F.first(c).over(bucket) for c in ("node", "sim", "chars")} | {f"{c}_n": F.lead(c).over(bucket) for c in ("node", "sim", "chars")})
    both = both.withColumnsRenamed(own)
    lead = F.when((F.col("node") != F.col("node_l")) & _near("l", "o", similarity), F.col("node_l"))
    following = F.when(_near("n", "o", similarity), F.struct(F.bit_count(F.col("sim_o").bitwiseXOR(F.col("sim_n"))).alias("bits"), F.col("node_n").alias("node")))
    best = both.select("node", lead.alias("lead"), following.alias("next")).filter("lead is not null or next is not null")
    best = best.groupBy("node").agg(F.min("lead").alias("lead"), F.min("next").alias("next"))
    return best.select("node", F.explode(F.array("lead", "next.node")).alias("other")).filter("other is not null").select(*_pair("node", "other")).distinct()


def _other_candidates(crowded: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: all lines of a crowded bucket that can be similar and are in different groups. The
    rows of a bucket's largest group only meet those of its other groups."""
    counts = crowded.groupBy("key", "root").agg(F.count("*").alias("c"))
    mixed = counts.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots")).filter("roots > 1")
    placed = crowded.join(mixed.select("key", "main"), "key")
    minor = placed.filter("root <> main").select("key", F.col("node").alias("a"), F.col("sim").alias("sim_a"), F.col("chars").alias("chars_a"), F.col("root").alias("root_a"))
    placed = placed.select("key", F.col("node").alias("b"), F.col("sim").alias("sim_b"), F.col("chars").alias("chars_b"), F.col("root").alias("root_b"), "main")
    # A pair of two smaller groups is met once, one with the largest from its smaller side.
    met = minor.join(placed, "key").filter((F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("main")) | (F.col("a") < F.col("b"))) & _near("a", "b", similarity))
    return met.select(*_pair("a", "b")).distinct()


def _groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``id, doc, line, first`` for each line with words of ``documents``: ``first(id, line, doc)`` is the
    group's occurrence that stays, the one of the smallest id and then place and text hash.

    Lines are in one group if their normal forms are equal, or a chain of pairs joins them whose
    SimHashes share SHARED blocks and differ in at most DISTANCE bits and whose edit similarity is
    ``similarity`` or more. Equal lines are one node. In a crowded bucket a line first meets the smallest
    one and the next in the order of the hashes, in the others the smallest and the most alike of
    those near it; then all near ones still in different groups meet, so no link is lost. A null text has no lines, a null
    id counts as the smallest, rows that repeat an id and text have their lines once, different texts of
    one id are documents of their own, and lines without words are no lines here.
    """
    lines = stored(_simhash(_lines(docs)))
    nodes = stored(lines.groupBy("h1", "h2").agg(F.min(F.struct("id", "line", "doc")).alias("first"), F.min("sim").alias("sim"), F.min("chars").alias("chars"), F.count("*").alias("of"))
                   .withColumn("node", F.monotonically_increasing_id()))
    hashes = nodes.select("node", "sim", "chars")
    share = hashes.filter(F.pmod(F.xxhash64("node"), F.lit(CROWD_SHARE)) == 0)
    hot = stored(_blocks(share).groupBy("key").agg(F.count("*").alias("of")).filter(F.col("of") * CROWD_SHARE >= CROWD).select("key"))
    some, spread = hot.limit(1).count() > 0, _blocks(hashes)
    if some:
        crowded = stored(_blocks(hashes).join(small(hot), "key"))
        met = stored(_first_candidates(crowded, similarity))
        first = stored(_verified(docs, nodes, met, similarity))
        roots = connected_components(first)
        spread = _blocks(_linked(hashes, roots)).join(small(hot), "key", "left_anti")
    near = stored(_near_pairs(spread, similarity))
    best = stored(_best_pairs(near))
    links = stored(_verified(docs, nodes, best, similarity))
    roots = joined_components(roots, links) if some else connected_components(links)
    rest = _apart(near.join(best, ["a", "b"], "left_anti").select("a", "b"), roots)
    if some:
        others = _other_candidates(_linked(crowded, roots), similarity)
        rest = rest.union(others).distinct().join(met.union(best), ["a", "b"], "left_anti")
    rest = stored(rest)
    if rest.limit(1).count():
        more = stored(_verified(docs, nodes, rest, similarity))
        if more.limit(1).count():
            roots = joined_components(roots, more)
    joined = nodes.join(roots.toDF("node", "root"), "node").select("root", "h1", "h2", "first")
    least = joined.groupBy("root").agg(F.min("first").alias("least"))
    moved = joined.join(least, "root").select("h1", "h2", F.col("least").alias("known"))
    # A line that occurs once and has no near ones is its own first, and needs no row to say so.
    again = nodes.filter("of > 1").select("h1", "h2", "first").join(moved, ["h1", "h2"], "full").select("h1", "h2", F.coalesce("known", "first").alias("known"))
    own = F.struct("id", "line", "doc")
    return lines.select("id", "doc", "line", "h1", "h2").join(again.hint("shuffle_hash"), ["h1", "h2"], "left").select("id", "doc", "line", F.coalesce("known", own).alias("first"))


def line_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``id, line, first, doc, first_doc`` for each line with words: ``first(id, line)`` is the place of
    the group's occurrence that stays, ``doc`` and ``first_doc`` are the hashes of the two texts."""
    first = F.struct("first.id", "first.line")
    return _groups(docs, similarity).select("id", "line", first.alias("first"), "doc", F.col("first.doc").alias("first_doc"))


def without_repeated_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one occurrence of every group of lines: the others are cut from ``text``, and
    ``n_chars`` is that of the new text. A document that has lines with words and keeps none of
    them goes; one that never had any stays as it is, and so do all other columns."""
    own = F.struct("id", "line", "doc") == F.col("first")
    known, known_doc, some, cut, here, here_doc, text = fresh(docs, "known", "known_doc", "some", "cut", "here", "here_doc", "new_text")
    lines = stored(_groups(docs, similarity).select("id", "doc", "line", own.alias("stays")))
    cuts = lines.groupBy(F.col("id").alias(known), F.col("doc").alias(known_doc)).agg(F.bool_or("stays").alias(some), F.collect_set(F.when(~F.col("stays"), F.col("line"))).alias(cut))
    cuts = stored(cuts.filter(F.size(cut) > 0))
    rows = docs.withColumns({here: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), here_doc: _text_hash()})
    rows = rows.join(small(cuts), (F.col(here) == F.col(known)) & (F.col(here_doc) == F.col(known_doc)), "left")
    rows = rows.filter(F.coalesce(some, F.lit(True)))
    shorter = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(cut, i)), "\n")
    rows = rows.withColumn(text, F.when(F.col(known).isNull(), F.col("text")).otherwise(shorter))
    changed = {"text": F.col(text), "n_chars": F.when(F.col(known).isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long"))}
    return rows.select(*(changed.get(c, F.col(c)).alias(c) for c in docs.columns))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, line, kept_doc_id, kept_line, kept, text_hash, kept_text_hash`` for every line with words;
    the hashes tell apart texts that share an id or have none."""
    groups = _groups(table(spark, sf_dir, "documents"))
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return groups.select(shown("id").alias("doc_id"), "line", shown("first.id").alias("kept_doc_id"), F.col("first.line").alias("kept_line"),
                         (F.struct("id", "line", "doc") == F.col("first")).alias("kept"), F.col("doc").alias("text_hash"), F.col("first.doc").alias("kept_text_hash"))
