"""Token packing by bounded-space online best fit."""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from arbormetric.llm.bytepairs import byte_signs
from arbormetric.llm.tables import arrow_rows, byte_runs, stored, table

CAPACITY = 2048
OPEN_BINS = 256
SHARD_ROWS = 8192
#: Bytes of text that a task encodes at once; a longer text is encoded alone.
BATCH_BYTES = 1 << 22
#: Rows that a worker is handed at once.
ARROW_ROWS = 512
#: Distinct words that are Python strings at a time.
WORDS = 1 << 14
MARK = "\x01"
#: Letters of ASCII and Latin-1, whose lower and composed forms are plain, and common signs behind them.
LETTERS = "".join(chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)] if c not in (0xD7, 0xF7))
SIGNS_BEHIND = ".,;:!?"
PLAIN = re.compile(f"[{LETTERS}]+|[{SIGNS_BEHIND}]*")
#: Pre-tokens, and bytes of them, that a worker keeps with their ids; beyond that it goes on with those of its last batch.
REMEMBERED = 1 << 19
REMEMBERED_BYTES = 1 << 24
SIGNS = byte_signs()


def _gathered(values: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` of the entries ``at``, one after the other, and where each ends; entry
    i has ``sizes[i]`` values."""
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    own = sizes[at]
    ends = np.cumsum(own, dtype=np.int64)
    place = np.repeat((starts[at] - ends + own).astype(np.int32), own)
    place += np.arange(len(place), dtype=np.int32)
    return values[place], ends


class WordIds:
    """Ids of whole texts from the ids of their words. The vocabulary's pre-tokenizer drops white
    space and never joins what white space parts, so the ids of a text are those of its words in
    order, and every distinct word of a batch is looked at once. A plain word is letters and signs
    behind them, which the pre-tokenizer parts: both are looked up among the pre-tokens of
    earlier batches, letters in lower case, and the merges of new ones are asked for directly. All
    other words go through the whole tokenizer and are kept as well."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self._ids(MARK)[0]
        self.forget(pa.array([], pa.string()))

    def forget(self, none: pa.Array) -> None:
        self.known, self.ids, self.sizes = none, np.empty(0, "<u4"), np.empty(0, np.int32)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _merged(self, token: str) -> bytes:
        """Ids of one pre-token; letters stand as the signs of their bytes."""
        signs = token if token.isascii() else "".join(map(SIGNS.__getitem__, token.encode()))
        return array("I", [t.id for t in self.tokenizer.model.tokenize(signs)]).tobytes()

    def _of_words(self, words: list[str]) -> tuple[bytes, np.ndarray]:
        """All ids of the words, and how many those of each are."""
        found = [self._merged(w) if PLAIN.fullmatch(w) else None for w in words]
        others = [n for n, own in enumerate(found) if own is None]
        # Many words in one text, parted by a character that none of them holds.
        joined = [n for n in others if MARK not in words[n] and "<|" not in words[n]]
        for at in range(0, len(joined), 500):
            own = joined[at : at + 500]
            ids = self._ids(f" {MARK} ".join([words[n] for n in own]))
            cuts = [-1, *np.flatnonzero(ids == self.mark).tolist(), len(ids)]
            data = ids.tobytes()
            for n, start, end in zip(own, cuts[:-1], cuts[1:], strict=True):
                found[n] = data[4 * start + 4 : 4 * end]
        for n in others:
            if found[n] is None:
                found[n] = self._ids(words[n]).tobytes()
        return b"".join(found), np.fromiter(map(len, found), np.int32, len(found)) // 4

    def _learn(self, new: pa.Array) -> None:
        parts = [self._of_words(new[at : at + WORDS].to_pylist()) for at in range(0, len(new), WORDS)]
        self.known = pa.concat_arrays([self.known, new])
        self.ids = np.concatenate([self.ids, *[np.frombuffer(ids, "<u4") for ids, _ in parts]])
        self.sizes = np.concatenate([self.sizes, *[n for _, n in parts]])

    def _places(self, tokens: pa.Array) -> np.ndarray:
        """Places of the ``tokens``, all different, among the known ones."""
        if self.known.type != tokens.type:
            self.forget(tokens[:0])
        elif len(self.known) > REMEMBERED or self.known.nbytes > REMEMBERED_BYTES:
            own = pc.drop_null(pc.index_in(tokens, value_set=self.known))
            kept, at = self.known.take(own), own.to_numpy()
            if kept.nbytes > REMEMBERED_BYTES:
                self.forget(tokens[:0])
            else:
                self.ids, self.sizes, self.known = _gathered(self.ids, self.sizes, at)[0], self.sizes[at], kept
        at = pc.index_in(tokens, value_set=self.known)
        new = at.is_null()
        fresh = tokens.filter(new)
        at = at.fill_null(0).to_numpy(zero_copy_only=False).copy()
        at[new.to_numpy(zero_copy_only=False)] = np.arange(len(self.known), len(self.known) + len(fresh))
        self._learn(fresh)
        return at

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        # Blanks, tabs and line ends of ASCII are white space to the vocabulary; other kinds stay
        # inside of words, which it parts by itself.
        words = pc.ascii_split_whitespace(texts)
        counts = pc.list_value_length(words).to_numpy()
        coded = words.flatten().dictionary_encode()
        del words
        distinct = coded.dictionary
        letters = pc.ascii_rtrim(distinct, SIGNS_BEHIND)
        plain = pc.and_(pc.not_equal(letters, ""), pc.equal(pc.utf8_ltrim(letters, LETTERS), ""))
        heads = pc.if_else(plain, pc.utf8_lower(letters), distinct)
        behind = pc.if_else(plain, pc.utf8_ltrim(distinct, LETTERS), "")
        tokens = pa.concat_arrays([heads, behind]).dictionary_encode()
        at = self._places(tokens.dictionary)[tokens.indices.to_numpy()].reshape(2, -1)
        ids, _ = _gathered(self.ids, self.sizes, at.T.ravel())
        ids, ends = _gathered(ids, self.sizes[at].sum(0, dtype=np.int32), coded.indices.to_numpy())
        return np.split(ids, np.concatenate([[0], ends])[np.cumsum(counts)[:-1]]) if len(texts) else []


@functools.lru_cache(1)
def _encoder(vocabulary: str) -> WordIds:
    return WordIds(vocabulary)


def token_pieces(docs: DataFrame, key: str, text: str, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """``key, piece, start, length, ids_crc32``: each text's ids with ``end_id`` behind them, cut
    only where they are longer than ``capacity``. A null text is empty and has one piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            for at, upto in byte_runs(batch.column(1), BATCH_BYTES):
                part = batch.slice(at, upto - at)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1)), strict=True):
                    data = ids.tobytes() + end
                    for piece, start in enumerate(range(0, len(data) // 4, capacity)):
                        own = data[4 * start : 4 * (start + capacity)]
                        rows.append((doc, piece, start, len(own) // 4, zlib.crc32(own)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    end = end_id.to_bytes(4, "little")
    names = ["doc", "piece", "start", "length", "ids_crc32"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return docs.select(F.col(key).cast("long"), F.coalesce(F.col(text), F.lit(""))).mapInArrow(
        cut, "doc long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int, open_bins: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item in order of arrival. Bit f of ``free`` tells that an open bin
    has room f; an item goes to the least room that holds it. Beyond ``open_bins`` the fullest
    bin closes."""
    free, by_room, bins, offsets = 0, [[] for _ in range(capacity + 1)], [], []
    made = opened = 0
    for length in lengths:
        fits = free >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                free ^= 1 << room
        else:
            if opened == open_bins and length < capacity:
                fullest = (free & -free).bit_length() - 1
                by_room[fullest].pop()
                if not by_room[fullest]:
                    free ^= 1 << fullest
                opened -= 1
            own, room, made, opened = made, capacity, made + 1, opened + 1
        bins.append(own)
        offsets.append(capacity - room)
        room -= length
        if room:
            by_room[room].append(own)
            free |= 1 << room
        else:
            opened -= 1
    return bins, offsets


def pack(pieces: DataFrame, rows: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. ``rows`` is about the number of pieces, from
    which the number of shards follows; every shard is packed by itself, so that its open bins are
    all that a task keeps. The rows of a shard come from all tasks in turn, whatever their keys."""
    shards = max(1, round(rows / shard_rows))

    def fill(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc", "piece"], kind="stable")
        bins, frame["offset"] = best_fit(frame["length"].tolist(), capacity, open_bins)
        frame["sequence_id"] = (int(key[0]) << 32) + np.array(bins, np.int64)
        return frame[["doc", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return pieces.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards))).groupBy("shard").applyInPandas(
        fill, "doc long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for all rows of
    ``documents``. Repeated rows are packed once each, a null id stays null; other columns are not
    read."""
    import public_tokenizers

    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        pieces = stored(token_pieces(docs, "doc_id", "text", vocabulary or public_tokenizers.path("word_bpe_49k.json"), capacity))
    return pack(pieces, pieces.count(), capacity).withColumnRenamed("doc", "doc_id")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
