"""Language identification by Bayesian fusion of text, markup, address suffix and host."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from arbormetric.llm.tables import arrow_rows, byte_runs, fresh, small, stored, table
from arbormetric.llm.urls import url_parts

BUCKETS = 1 << 15
#: Labelled rows of a language, in expectation, from which its character model is fitted.
FIT_ROWS = 2_000
#: Characters from which a text counts with full weight; longer ones count no more, since what
#: follows repeats the same evidence.
FULL_WEIGHT = 200
#: Rows of the level above that a site or a host counts besides its own.
SMOOTHING = 10.0
#: Prior of the hypothesis that a text is in none of the languages.
UNKNOWN = 0.01
THRESHOLD = 0.5
#: Rows and bytes of text that are scored at once.
BATCH, BATCH_BYTES = 512, 1 << 20
LETTERS = np.arange(128)
LETTERS[[c for c in range(128) if not chr(c).isalpha()]] = 32


def _buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts in lower case, ASCII signs as blanks, and the texts' starts.
    BUCKETS stands at the two places between texts."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer("\0\0".join([*lower, ""]).encode("utf-32-le"), "<u4").astype(np.int64)
    sizes = np.fromiter(map(len, lower), np.int64, len(lower)) + 2
    starts = np.cumsum(sizes) - sizes
    codes = np.where(codes < 128, LETTERS[np.minimum(codes, 127)], codes)
    mixed = (codes[:-2] * 0x9E3779B1 + codes[1:-1] * 0x85EBCA77 + codes[2:] * 0xC2B2AE3D) & 0xFFFFFFFF
    found = np.full(len(codes), BUCKETS)
    found[:-2] = (mixed ^ (mixed >> 15)) * 0x2C1B3C6D >> 12 & (BUCKETS - 1)
    ends = starts + sizes
    # Trigrams that reach into the gap behind a text, or the gap itself.
    for back in (1, 2, 3, 4):
        at = ends - back
        found[at[at >= starts]] = BUCKETS
    return found, starts


@dataclass
class TextModel:
    """Log-probabilities of trigram buckets, one row a language."""

    languages: list[str]
    table: np.ndarray

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of trigrams and log-likelihood by language of each text."""
        at, starts = _buckets(texts)
        n = np.add.reduceat((at < BUCKETS).astype(np.int64), starts)
        return n, np.stack([np.add.reduceat(row[at], starts) for row in self.table], 1) if len(self.languages) else np.zeros((len(texts), 0))


def fit_text_model(docs: DataFrame, text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS) -> TextModel:
    """Trigram model of the languages in ``lang``, from about ``fit_rows`` rows of each, drawn
    evenly by a hash of the text. The driver gets one count per language and bucket."""
    named = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.lower(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r.lang: r.n for r in named.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return TextModel([], np.zeros((0, BUCKETS + 1)))
    part = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(math.ceil(1e6 * min(1.0, fit_rows / n))))))
    drawn = named.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < part[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS + 1), np.int64)
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                np.add.at(total[languages.index(lang)], _buckets([text])[0], 1)
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(total[at])], names=["l", "b", "n"])

    counts = drawn.mapInArrow(count, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros((len(languages), BUCKETS + 1))
    seen[counts["l"], counts["b"]] = counts["n"]
    seen = seen[:, :BUCKETS] + 0.5
    return TextModel(languages, np.hstack([np.log(seen / seen.sum(1, keepdims=True)), np.zeros((len(languages), 1))]))


def _scored(rows: DataFrame, model: TextModel) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, upto in byte_runs(batch.column(0), BATCH_BYTES, BATCH):
                part = batch.slice(at, upto - at)
                n, scores = model.scores(part.column(0).to_pylist())
                width = scores.shape[1]
                lists = pa.ListArray.from_arrays(np.arange(0, len(scores) * width + 1, max(width, 1), np.int32) if width else np.zeros(len(scores) + 1, np.int32), pa.array(scores.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(n), lists], names=["id", "declared", "host", "n", "scores"])

    return rows.select("text", "id", "declared", "host").mapInArrow(score, "id long, declared string, host string, n long, scores array<double>")


def _levels(rows: DataFrame, languages: list[str]) -> DataFrame:
    """Adds ``prior``: the languages' shares at the row's host, smoothed by those at its site, these
    by those of all rows. ``best`` is the language by text alone."""
    counted = [F.sum((F.col("best") == i).cast("double")).alias(f"c{i}") for i in range(len(languages))]
    whole = rows.agg(*counted).first()
    whole = [float(c or 0) + 1.0 for c in whole]
    whole = F.array(*(F.lit(c / sum(whole)) for c in whole))

    def smoothed(own: Column, above: Column) -> Column:
        n = F.aggregate(own, F.lit(0.0), lambda s, c: s + c)
        return F.zip_with(own, above, lambda c, p: (c + SMOOTHING * p) / (n + SMOOTHING))

    hosts = rows.groupBy("site", "host").agg(*counted)
    hosts = stored(hosts.select("site", "host", F.array(*(f"c{i}" for i in range(len(languages)))).alias("counts")))
    sites = hosts.groupBy("site").agg(*(F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(len(languages))))
    sites = sites.select("site", smoothed(F.array(*(f"c{i}" for i in range(len(languages)))), whole).alias("above"))
    priors = stored(hosts.join(sites, "site").select("host", smoothed(F.col("counts"), F.col("above")).alias("prior")))
    return rows.join(small(priors), "host")


def _evidence(rows: DataFrame, key: str, languages: list[str]) -> DataFrame:
    """Adds ``<key>_given``: the log-probability of the row's ``key`` in each language, from the
    smoothed counts of keys among rows of that language by text alone."""
    counted = [F.sum((F.col("best") == i).cast("double")).alias(f"c{i}") for i in range(len(languages))]
    counts = stored(rows.groupBy(key).agg(*counted))
    total = counts.agg(F.count("*"), *(F.sum(f"c{i}") for i in range(len(languages)))).first()
    given = F.array(*(F.log((F.col(f"c{i}") + 1.0) / (F.lit(float(t or 0)) + F.lit(float(total[0])))) for i, t in enumerate(total[1:])))
    return rows.join(small(counts.select(key, given.alias(f"{key}_given"))), key)


def identify(rows: DataFrame, model: TextModel, threshold: float = THRESHOLD) -> DataFrame:
    """``id, declared, language, posterior, accepted`` for ``rows(id, text, declared, host)``.

    The posterior of a language is proportional to its prior at the host, the probabilities of the
    declared language and of the address suffix in it, and the likelihood of the text; a text in
    none of the languages has uniform trigrams. A row is accepted if a language has a posterior
    of ``threshold`` or more. A null or empty text, or a null column, is no evidence either
    way; repeated rows are judged one by one; without labelled rows nothing is accepted.
    """
    clean = lambda c: F.coalesce(F.lower(c), F.lit(""))
    primary = F.regexp_extract(clean("declared"), "^([a-z]+)", 1)
    known = F.when(primary.isin(model.languages), primary).otherwise(F.when(primary == "", "").otherwise("other"))
    rows = rows.select("id", F.coalesce("text", F.lit("")).alias("text"), known.alias("declared"), clean("host").alias("host"))
    if not model.languages:
        return rows.select("id", "declared", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), F.lit(False).alias("accepted"))
    rows = stored(_scored(rows, model))
    names = F.split("host", r"\.")
    rows = rows.withColumns({
        "best": F.when(F.col("n") > 0, F.array_position("scores", F.array_max("scores")).cast("int") - 1),
        "suffix": F.when(F.size(names) > 1, F.element_at(names, -1)).otherwise(""),
        "site": F.array_join(F.slice(names, -F.least(F.size(names), F.lit(2)), 2), ".")})
    rows = _evidence(_evidence(_levels(rows, model.languages), "declared", model.languages), "suffix", model.languages)
    weight = F.when(F.col("n") > 0, F.least("n", F.lit(FULL_WEIGHT)) / F.col("n")).otherwise(0.0)
    total = [
        math.log(1 - UNKNOWN) + F.log(F.col("prior")[i]) + F.col("declared_given")[i] + F.col("suffix_given")[i] + weight * F.col("scores")[i]
        for i in range(len(model.languages))]
    # An unknown language says as much about markup and suffix as the languages do on average.
    mean = lambda c: F.aggregate(F.transform(c, F.exp), F.lit(0.0), lambda s, x: s + x / len(model.languages))
    unknown = math.log(UNKNOWN) + F.log(mean("declared_given")) + F.log(mean("suffix_given")) - weight * F.col("n") * math.log(BUCKETS)
    rows = rows.withColumn("total", F.array(*total)).withColumn("top", F.array_max("total"))
    mass = F.aggregate("total", F.exp(unknown - F.col("top")), lambda s, x: s + F.exp(x - F.col("top")))
    language = F.element_at(F.array(*map(F.lit, model.languages)), F.array_position("total", F.col("top")).cast("int"))
    return rows.select("id", "declared", language.alias("language"), (1 / mass).alias("posterior")).withColumn("accepted", F.col("posterior") >= threshold)


def page_text(html: Column) -> Column:
    """The text of a page without scripts, styles, tags and entities."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.regexp_replace(bare, r"<[^>]*>|&[A-Za-z0-9#]+;", " ")


def identify_documents(docs: DataFrame, model: TextModel) -> DataFrame:
    """``identify`` for ``documents``: the column ``lang`` is the declared language and ``source``
    the host."""
    return identify(docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host")), model)


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """``identify`` for ``pages``: the language declared is that of the markup."""
    declared = F.regexp_extract("html", r"""(?i)<html[^>]*\slang\s*=\s*["']?([a-z]+)""", 1)
    return identify(pages.select(F.col("page_id").alias("id"), page_text(F.col("html")).alias("text"), declared.alias("declared"),
                                 url_parts(F.col("url"))[0].alias("host")), model)


def accepted_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is identified, all columns as they are. Rows are told apart
    by a hash of id and text: different texts of one id, or of none, are judged by themselves, and
    rows that repeat both stay if one of them is accepted. A null text is empty."""
    (key,) = fresh(docs, "row_key")
    rows = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit(""))))
    with arrow_rows(docs.sparkSession, BATCH):
        model = fit_text_model(docs)
        judged = stored(identify_documents(rows.drop("doc_id").withColumnRenamed(key, "doc_id"), model))
    gone = judged.groupBy(F.col("id").alias(key)).agg(F.bool_or("accepted").alias("some")).filter("not some").select(key)
    return rows.join(small(stored(gone)), key, "left_anti").select(*docs.columns)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document (``doc_id``) and every page (``page_id``)."""
    docs = table(spark, sf_dir, "documents")
    model = fit_text_model(docs)
    shown = ["declared", "language", "posterior", "accepted"]
    none = F.lit(None).cast("long")
    of_docs = identify_documents(docs, model).select(F.col("id").alias("doc_id"), none.alias("page_id"), *shown)
    of_pages = identify_pages(table(spark, sf_dir, "pages"), model).select(none.alias("doc_id"), F.col("id").alias("page_id"), *shown)
    return of_docs.union(of_pages)
