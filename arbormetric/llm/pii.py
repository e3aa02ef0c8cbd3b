"""Personal data: fixed patterns, and further identifiers found by bootstrapped contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from arbormetric.llm.tables import discard, fresh, stored, stored_and_seen, stored_small, table

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, written so that a failing start is given up at once: runs are taken
#: possessively, and only the start of a run (or the end of the match before) can begin a match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Looser shapes of identifiers: what no fixed pattern takes can still be found by its contexts.
LOOSE = {
    "at": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?)[A-Za-z0-9-]++)*+",
    "number": r"(?<![0-9A-Za-z])[0-9(](?:[ ().,:/-]{0,2}[0-9]){6,}+",
    "quad": r"(?<![0-9A-Za-z])[0-9]{1,3}+(?:[.,:/-][0-9]{1,3}+){3}(?![0-9])",
}
GUARD = {"email": "@", "phone": "+"}
#: Letters of a word beyond which its hash stands for it, and the rise below which scores are settled.
LONG_WORD = 64
SETTLED = 1e-3
CONFIDENCE = 0.8
SUPPORT = 5
#: The word beside a span with the signs between, seen from the span.
BESIDE = r"^([^\\p{L}]{0,3}\\p{L}++)"
SPAN = "struct<start:int,end:int,value:string,before:string,after:string>"


def _found(name: str) -> str:
    """Spans of the matches ``m_`` between the gaps ``g_``, with the text on both sides."""
    return f"""
    CASE WHEN size(m_{name}) > 0 THEN aggregate(
      sequence(1, size(m_{name})),
      named_struct('at', 0, 'out', CAST(array() AS array<{SPAN}>)),
      (s, i) -> named_struct(
        'at', s.at + length(g_{name}[i - 1]) + length(m_{name}[i - 1]),
        'out', concat(s.out, array(named_struct(
          'start', s.at + length(g_{name}[i - 1]), 'end', s.at + length(g_{name}[i - 1]) + length(m_{name}[i - 1]),
          'value', m_{name}[i - 1], 'before', reverse(regexp_extract(reverse(g_{name}[i - 1]), '{BESIDE}', 1)),
          'after', regexp_extract(g_{name}[i], '{BESIDE}', 1))))),
      s -> s.out) ELSE CAST(array() AS array<{SPAN}>) END"""


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int") * (2 - i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$"))
    if kind == "card":
        return F.length(digits).between(13, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _loose_kind(value: Column) -> Column:
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return (F.when(value.rlike(r"@|\(at\)|\[at\]"), "email")
            .when(value.rlike(r"^[0-9]{1,3}(?:[.,:/-][0-9]{1,3}){3}$"), "ip")
            .when(digits >= 12, "card").otherwise("phone"))


def _overlaps(spans: Column, start: Column, end: Column) -> Column:
    return F.exists(spans, lambda b: (b.start < end) & (b.end > start))


def occurrences(docs: DataFrame) -> DataFrame:
    """``id, h, base, loose`` for each row of ``docs(id, text)``: ``h`` is a hash of the text,
    ``base`` the spans of the fixed patterns by kind and start, ``loose`` those of the looser shapes
    that touch none of them."""
    text = F.col("text")
    rows = docs.select("id", text, F.xxhash64(text).alias("h"))
    patterns = BASE | LOOSE
    guards = {k: F.contains(text, F.lit(v)) for k, v in GUARD.items()} | {"at": text.rlike(r"@|at[)\]]")}
    digit = text.rlike("[0-9]")
    nothing = F.array().cast("array<string>")
    rows = rows.withColumns({f"m_{k}": F.when(guards.get(k, digit), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(nothing) for k, p in patterns.items()})
    rows = rows.withColumns({f"g_{k}": F.when(F.size(f"m_{k}") > 0, F.split(text, p, -1)) for k, p in patterns.items()})
    rows = rows.select("id", "h", *(F.expr(_found(k)).alias(k) for k in patterns))

    def tagged(spans: Column, kind) -> Column:
        return F.transform(spans, lambda s: F.struct(
            kind(s.value).alias("kind"), s.start.alias("start"), s.end.alias("end"), s.value.alias("value"), s.before.alias("before"), s.after.alias("after")))

    def sound(kind: str) -> Column:
        return tagged(F.filter(kind, lambda s: _valid(kind, s.value)), lambda v: F.lit(kind))

    loose = [F.col("at"), F.col("number"), F.filter("quad", lambda s: ~_overlaps(F.col("number"), s.start, s.end))]
    rows = rows.select("id", "h", F.concat(*map(sound, KINDS)).alias("base"), F.concat(*(tagged(spans, _loose_kind) for spans in loose)).alias("loose"))
    return rows.withColumn("loose", F.filter("loose", lambda s: ~_overlaps(F.col("base"), s.start, s.end)))


def _contexts(rows: DataFrame, spans: str, seed: bool) -> DataFrame:
    """One row per span and lexical pattern: the word before it, with the signs between, and the
    word after it."""
    each = rows.filter(F.size(spans) > 0).select("id", "h", F.explode(spans).alias("s")).select("id", "h", "s.*")
    word = lambda c: F.when(F.length(c) > LONG_WORD, F.sha2(F.lower(c), 256)).otherwise(F.trim(F.lower(c)))
    sides = F.array(F.concat(F.lit("<"), word("before")), F.concat(F.lit(">"), word("after")))
    return each.select("id", "h", "kind", "start", "end", F.xxhash64("kind", "value").alias("instance"), F.lit(seed).alias("seed"),
                       F.explode(F.filter(sides, lambda p: F.length(p) > 1)).alias("pattern"))


def _pattern_scores(graph: DataFrame, settled: float) -> DataFrame:
    """``pattern, kind, seeds, loose, score`` once no score rises by ``settled`` any more; ``loose``
    tells patterns of instances that are no seeds. Scores start from the seeds alone and only rise, so that this ends."""
    counts = graph.groupBy("pattern", "kind").agg(F.sum(F.col("seed").cast("double")).alias("seeds"), F.count("*").alias("n"))
    fixed = counts.withColumn("of", F.sum("n").over(Window.partitionBy("pattern")))
    # Only instances that are not seeds change; what the seeds give a pattern is summed up once, and
    # patterns of seeds alone stay as they are.
    fixed = stored(fixed.select("pattern", "kind", "seeds", "of", (F.col("seeds") < F.col("n")).alias("loose"), (F.col("seeds") / F.col("of")).alias("score")))
    edges, seen = stored_and_seen(graph.filter(~F.col("seed")).select("pattern", "instance", "kind"), left=F.count("*"))
    out = ["pattern", "kind", "seeds", "loose", "score"]
    if not seen["left"]:
        return fixed.select(*out)
    known, rounds, rise = fixed.filter("loose").select("pattern", "kind", "seeds", "of", "score"), None, None
    while rise is None or rise > settled:
        instances = edges.join(known.select("pattern", "kind", "score"), ["pattern", "kind"]).groupBy("instance").agg(F.avg("score").alias("given"))
        given = edges.join(instances, "instance").select("pattern", "kind", "given")
        # Old and new meet in one aggregation: no further join, and no table to send to every executor.
        both = known.unionByName(given, allowMissingColumns=True).groupBy("pattern", "kind").agg(
            *(F.max(c).alias(c) for c in ("seeds", "of")), F.max("score").alias("old"), F.sum("given").alias("given"))
        newer = both.select("pattern", "kind", "seeds", "of", ((F.col("seeds") + F.col("given")) / F.col("of")).alias("score"), "old")
        known, seen = stored_and_seen(newer, rise=F.max(F.col("score") - F.col("old")))
        rise, known = seen["rise"], known.drop("old")
        if rounds is not None:
            discard(rounds)
        rounds = known
    return known.withColumn("loose", F.lit(True)).select(*out).union(fixed.filter("NOT loose").select(*out))


def confident_patterns(graph: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT, settled: float = SETTLED) -> DataFrame:
    """``pattern, kind``: patterns that single out a kind, from ``graph(pattern, instance, kind,
    seed)``, distinct edges between patterns and instances.

    A pattern's score for a kind is the mean score of all its instances, those of other kinds
    counting nothing; a seed scores 1 and any other instance the mean of its patterns' scores,
    until the scores are settled. Patterns of at least ``support`` seeds and a score of ``confidence``
    are taken, what they hold becomes seeds, and so on until no pattern is added.
    """
    graph, taken = stored(graph), -1
    while True:
        scores = _pattern_scores(graph, settled).filter((F.col("seeds") >= support) & (F.col("score") >= confidence))
        chosen, seen = stored_and_seen(scores.select("pattern", "kind", "loose"), taken=F.count("*"), loose=F.count_if("loose"))
        before, taken = taken, seen["taken"]
        if taken == before or not seen["loose"]:
            return chosen.select("pattern", "kind")
        promoted = graph.filter(~F.col("seed")).join(chosen.filter("loose"), ["pattern", "kind"], "left_semi").select("instance", F.lit(True).alias("new")).distinct()
        newer = stored(graph.join(promoted, "instance", "left").select("pattern", "instance", "kind", (F.col("seed") | F.coalesce("new", F.lit(False))).alias("seed")))
        discard(graph)
        graph = newer


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``id, h, base, spans`` for every row of ``docs(id, text)``; a null text is empty.

    ``base`` are the spans of the fixed patterns, ``spans`` these and the ones discovered: the seeds
    induce the patterns around them, and loosely shaped identifiers in patterns of high
    confidence are taken as well unless they touch a base span. Spans have ``kind``, ``start`` and
    ``end`` (code points, end exclusive), ordered by kind as listed, then start. Rows that repeat
    an id and a text have the same spans.
    """
    rows = stored(occurrences(docs.select("id", F.coalesce("text", F.lit("")).alias("text"))))
    loose = stored(_contexts(rows, "loose", False))
    edges = ["pattern", "instance", "kind", "seed"]
    graph = loose.select(*edges).union(_contexts(rows, "base", True).select(*edges)).distinct()
    patterns = stored_small(confident_patterns(graph).join(loose.select("pattern", "kind").distinct(), ["pattern", "kind"], "left_semi"))
    place = F.struct("kind", "start", "end")
    found = stored_small(loose.join(patterns, ["pattern", "kind"]).groupBy("id", "h").agg(F.collect_set(place).alias("found")))
    rows = rows.withColumnsRenamed({"id": "own", "h": "own_h"}).join(
        found, F.col("own").eqNullSafe(F.col("id")) & (F.col("own_h") == F.col("h")), "left").select("own", "own_h", "base", "found")
    plain = lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"))
    base = F.transform("base", plain)
    order = lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s.kind).alias("k"), s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))
    spans = F.when(F.col("found").isNull(), base).otherwise(F.transform(F.array_sort(F.transform(F.concat(base, F.col("found")), order)), plain))
    return rows.select(F.col("own").alias("id"), F.col("own_h").alias("h"), base.alias("base"), spans.alias("spans"))


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of personal data in ``text`` replaced by its kind in brackets and
    ``n_chars`` that of the new text. Of spans that overlap the one that starts first is
    replaced, and what another has behind it goes with it. Other columns, and texts without spans,
    stay as they are."""
    found = find_personal_data(docs.select(F.col("doc_id").alias("id"), "text"))
    own, key, h, spans, masked_text = fresh(docs, "own_hash", "of_id", "of_hash", "found_spans", "masked_text")
    found = stored_small(found.filter(F.size("spans") > 0).select(F.col("id").alias(key), F.col("h").alias(h), F.col("spans").alias(spans)).distinct())
    rows = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own) == F.col(h)), "left")
    text = F.expr(f"""
      concat_ws('', aggregate(
        array_sort(transform({spans}, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind))),
        named_struct('at', 0, 'out', CAST(array() AS array<string>)),
        (a, s) -> named_struct(
          'at', greatest(a.at, s.end),
          'out', CASE WHEN s.start >= a.at THEN concat(a.out, array(substring(text, a.at + 1, s.start - a.at), concat('[', upper(s.kind), ']'))) ELSE a.out END),
        a -> concat(a.out, array(substring(text, a.at + 1)))))""")
    rows = rows.withColumn(masked_text, F.when(F.col(spans).isNull(), F.col("text")).otherwise(text))
    changed = {"text": F.col(masked_text), "n_chars": F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length(masked_text).cast("long"))}
    return rows.select(*(changed.get(c, F.col(c)).alias(c) for c in docs.columns))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    number = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"), *map(number, KINDS),
        F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
