"""Document fingerprints from prefix polynomial hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from arbormetric.llm.tables import table

#: The modulus is a Mersenne prime, so that products of residues fit 64 bits and reduce by shifts.
P = np.uint64(2**31 - 1)
SHIFT = np.uint64(31)
BASES = (1_000_003, 48_271)
WINDOW = 24
#: Stands for a null id, and so goes before all others.
NO_ID = -(2**63)
#: Smallest hashes kept of a text: a likeness of 0.5 has a standard error of about 0.03.
SKETCH = 256


def _mod(x: np.ndarray) -> np.ndarray:
    x = (x & P) + (x >> SHIFT)
    x = (x & P) + (x >> SHIFT)
    return np.where(x >= P, x - P, x)


class Powers:
    """Powers of a base and of its inverse, made longer by doubling when a longer text comes."""

    def __init__(self, base: int):
        self.steps = (base, pow(base, int(P) - 2, int(P)))
        self.tables = [np.ones(1, np.uint64) for _ in self.steps]

    def upto(self, n: int) -> list[np.ndarray]:
        while len(self.tables[0]) <= n:
            m = len(self.tables[0])
            self.tables = [np.concatenate([t, _mod(t * np.uint64(pow(s, m, int(P))))]) for t, s in zip(self.tables, self.steps, strict=True)]
        return self.tables


POWERS = [Powers(b) for b in BASES]


class PrefixHash:
    """Modular prefix arrays of a text: the hash of the span [i, j) is (H[j] - H[i]) / base^i, so
    equal spans have equal hashes wherever they stand."""

    def __init__(self, text: str):
        self.text = text
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        self.prefix = []
        for powers in POWERS:
            up = powers.upto(self.n)[0]
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(_mod(codes * up[: self.n]), out=sums[1:])
            self.prefix.append(_mod(sums))
        self._windows: np.ndarray | None = None

    def span(self, i: int, j: int) -> tuple[int, int]:
        """Hashes of [i, j) by either base."""
        return tuple((int(h[j]) - int(h[i])) * int(w.upto(i)[1][i]) % int(P) for h, w in zip(self.prefix, POWERS, strict=True))

    def windows(self) -> np.ndarray:
        """Mixed hashes of all spans of WINDOW characters."""
        if self._windows is None:
            h, inverse = self.prefix[0], POWERS[0].upto(self.n)[1]
            m = max(0, self.n - WINDOW + 1)
            self._windows = _mix(_mod((h[WINDOW:] + P - h[:m]) * inverse[:m])) if m else h[:0]
        return self._windows


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(15))) * np.uint64(0x2C1B3C6D) & np.uint64(0xFFFFFFFF)
    x = (x ^ (x >> np.uint64(12))) * np.uint64(0x297A2D39) & np.uint64(0xFFFFFFFF)
    return x ^ (x >> np.uint64(15))


def common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """Length of the longest common extension of ``a`` from ``i`` and ``b`` from ``j``, by binary
    search over equal spans."""
    low, high = 0, min(a.n - i, b.n - j)
    if high > 0 and a.text[i] != b.text[j]:
        return 0
    while low < high:
        middle = (low + high + 1) // 2
        if a.span(i, i + middle) == b.span(j, j + middle):
            low = middle
        else:
            high = middle - 1
    return low


def _least(*parts: np.ndarray) -> np.ndarray:
    """The SKETCH smallest distinct values."""
    found = []
    for x in parts:
        if len(x) > 4 * SKETCH:
            lead = np.unique(x[np.argpartition(x, 4 * SKETCH)[: 4 * SKETCH]])
            x = lead if len(lead) >= SKETCH else np.unique(x)
        found.append(x)
    return np.unique(np.concatenate(found))[:SKETCH]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two texts' spans, estimated from their smallest hashes."""
    both = np.union1d(a, b)[:SKETCH]
    return len(np.intersect1d(np.intersect1d(a, b, True), both, True)) / len(both) if len(both) else 1.0


def _print(n: int, whole: tuple[int, int], sketch: np.ndarray) -> str:
    return f"{n:x}-{whole[0]:08x}{whole[1]:08x}-{sketch.astype('>u4').tobytes().hex()}"


def _sketch(parts: list[np.ndarray], n: int, whole: tuple[int, int]) -> np.ndarray:
    if n >= WINDOW:
        return _least(*parts)
    return _mix(np.array([whole[0]], np.uint64)) if n else np.empty(0, np.uint64)


class Document(PrefixHash):
    """A text with its fingerprint."""

    def __init__(self, text: str):
        super().__init__(text)
        self.whole = self.span(0, self.n)
        self.sketch = _sketch([self.windows()], self.n, self.whole)
        self.fingerprint = _print(self.n, self.whole, self.sketch)


def edited(own: Document, following: Document) -> tuple:
    """What the query returns of a document whose last floor(n / 2) characters give way to the
    first as many of the following one. The edited text's hash and spans come from the two prefix
    arrays; only the spans across the seam are hashed anew."""
    drop = own.n // 2
    keep, take = own.n - drop, min(drop, following.n)
    n = keep + take
    text = own.text[:keep] + following.text[:take]
    whole = tuple(
        (int(h[keep]) + int(g[take]) * int(w.upto(keep)[0][keep])) % int(P)
        for h, g, w in zip(own.prefix, following.prefix, POWERS, strict=True))
    lead, tail = max(0, keep - WINDOW + 1), max(0, take - WINDOW + 1)
    seam = PrefixHash(text[lead : keep + WINDOW - 1])
    sketch = _sketch([own.windows()[:lead], following.windows()[:tail], seam.windows()], n, whole)
    common = keep + min(take, common_extension(own, keep, following, 0))
    return (
        own.n, hashlib.sha256(text.encode()).hexdigest(), own.fingerprint, _print(n, whole, sketch),
        likeness(own.sketch, sketch), likeness(own.sketch, following.sketch), common)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    common_prefix`` for every row of ``documents``; ``common_prefix`` is the length of the longest
    common extension of the text and its edited text from their start.

    The fingerprint holds the length, the text's hashes by two bases and the smallest hashes of its
    spans. A null text is empty; documents follow one another by id and, where ids repeat, by text;
    a null id comes first; the last is followed by the first, and a single one by itself. Other
    columns are not read.

    Texts move once: to ranges of ids, cut at quantiles of the ids, with the first document of each
    range sent to the range before as well. The bounds and the first ids, a few numbers per
    partition, are all that the driver sees.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 20 * n).alias("cuts")).first().cuts
    cuts = F.array(*(F.lit(c).cast("long") for c in sorted(set(cuts or [0]))))
    rows = rows.withColumn("part", F.size(F.filter(cuts, lambda c: c <= F.col("key"))))
    firsts = sorted(map(tuple, rows.groupBy("part").agg(F.min("key")).collect()))
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    guests = F.create_map(*(x for a, b in before.items() for x in (F.lit(a).cast("long"), F.lit(b)))) if before else F.create_map(F.lit(0).cast("long"), F.lit(0))
    place = lambda part, guest: F.struct(part.cast("int").alias("part"), F.lit(guest).alias("guest"))
    places = F.array(place(F.col("part"), 0), place(F.try_element_at(guests, F.col("key")), 1))
    rows = rows.withColumn("at", F.explode(F.filter(places, lambda p: p.part.isNotNull()))).select("at.*", "key", "text")
    rows = rows.repartition("part").sortWithinPartitions("part", "guest", "key", "text")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, closed = None, None
        for batch in batches:
            out = []
            for part, guest, doc, text in zip(batch["part"], batch["guest"], batch["key"].tolist(), batch["text"], strict=True):
                if part == closed:
                    continue
                own = Document(text)
                if last and last[0] == part:
                    out.append((None if last[1] == NO_ID else last[1], *edited(last[2], own)))
                last, closed = (None, part) if guest else ((part, doc, own), closed)
            frame = pd.DataFrame(out, columns=names)
            yield frame.astype({"doc_id": "Int64"})

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"]
    return rows.mapInPandas(
        walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, common_prefix long")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
