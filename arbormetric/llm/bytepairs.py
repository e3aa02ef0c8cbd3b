"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank file."""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from arbormetric.llm.tables import byte_runs, table

#: Characters of a text's pre-tokens that are encoded at once, and bytes of a batch's texts whose ids
#: are held together.
CHUNK = 1 << 18
BATCH_BYTES = 1 << 22
#: A byte that UTF-8 never uses; it parts pre-tokens, as no piece holds its sign.
BREAK, SIGN = 0xFF, "\n"


def byte_signs() -> str:
    """One printable character for each byte: itself if it is visible, else the next of those from
    U+0100 on. BREAK's is SIGN."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    signs = [chr(b if b in visible else next(other)) for b in range(256)]
    signs[BREAK] = SIGN
    return "".join(signs)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """A field of a protocol buffer: a varint, a float or a string of bytes."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file in the order of their ranks, which have no gaps."""
    with open(path, "rb") as lines:
        ranked = {int(rank): base64.b64decode(piece) for piece, rank in map(bytes.split, lines)}
    return [ranked[rank] for rank in range(len(ranked))]


def piece_model(ranks: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks and whose normalisation is the identity.

    A piece is the string of its bytes' signs with the negative rank as score, so the pair that is
    merged first is the one of the least rank. The unknown piece comes last.
    """
    # The numbers of sentencepiece's model fields and of its types.
    piece, score, kind, normal, unknown, bpe = 1, 2, 3, 1, 2, 2
    trainer, normalizer, model_type, vocab_size, unk, bos, eos, pad = 2, 3, 3, 4, 40, 41, 42, 43
    name, dummy_prefix, extra_spaces, escape = 1, 3, 4, 5
    signs = byte_signs()
    pieces = [(codecs.charmap_decode(p, "strict", signs)[0] if p != bytes([BREAK]) else "￾", -float(rank), normal) for rank, p in enumerate(ranks)]
    pieces.append(("<unk>", 0.0, unknown))
    absent = (1 << 64) - 1
    body = [_field(1, _field(piece, text.encode()) + _field(score, s) + _field(kind, k)) for text, s, k in pieces]
    body.append(_field(trainer, _field(model_type, bpe) + _field(vocab_size, len(pieces)) + _field(unk, len(ranks))
                       + _field(bos, absent) + _field(eos, absent) + _field(pad, absent)))
    body.append(_field(normalizer, _field(name, b"identity") + _field(dummy_prefix, 0) + _field(extra_spaces, 0) + _field(escape, 0)))
    return b"".join(body)


class BytePairs:
    """Ids of texts and bytes of ids. Pre-tokens are the matches of ``pattern``, which have to cover
    a text; each is encoded by itself."""

    def __init__(self, ranks: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=piece_model(ranks))
        self.unknown = len(ranks)
        self.split = regex.compile(pattern)
        self.signs = byte_signs()
        bytes_of = codecs.charmap_build(self.signs)
        self.pieces = [codecs.charmap_encode(self.model.id_to_piece(i), "strict", bytes_of)[0] if p != bytes([BREAK]) else p for i, p in enumerate(ranks)]
        # A pre-token that is a piece is that piece, also where its merges lead elsewhere.
        whole = {self._signed(p): rank for rank, p in enumerate(ranks) if BREAK not in p}
        self.apart = {t: whole[t] for t, ids in zip(whole, self.model.encode([*whole], num_threads=1), strict=True) if ids != [whole[t]]}

    def _signed(self, data: bytes) -> str:
        return codecs.charmap_decode(data, "strict", self.signs)[0]

    def chunks(self, text: str, units: int = CHUNK) -> Iterator[np.ndarray]:
        """The ids of ``text``, in parts of pre-tokens of about ``units`` characters."""
        if len(text) <= units:
            yield self._ids(self.split.findall(text))
            return
        tokens, size = [], 0
        for match in self.split.finditer(text):
            tokens.append(match.group())
            size += match.end() - match.start()
            if size >= units:
                yield self._ids(tokens)
                tokens, size = [], 0
        if tokens:
            yield self._ids(tokens)

    def _ids(self, tokens: list[str]) -> np.ndarray:
        signed = self._signed("\udcff".join(tokens).encode("utf-8", "surrogateescape"))
        if self.apart and not self.apart.keys().isdisjoint(signed.split(SIGN)):
            parts = [[self.apart[t]] if t in self.apart else self.model.encode(t) for t in signed.split(SIGN)]
            return np.array([i for part in parts for i in part], np.int64)
        ids = np.array(self.model.encode(signed), np.int64)
        return ids[ids != self.unknown]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes behind the signs of each id's piece."""
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


@functools.lru_cache(1)
def _coder(path: str, pattern: str) -> BytePairs:
    return BytePairs(read_ranks(path), pattern)


def encode_texts(docs: DataFrame, key: str, text: str, vocabulary: str, pattern: str) -> DataFrame:
    """``key, ids`` for each row: the ids of the whole text, none for a null or empty one. Keys are
    kept as they are, null and repeated ones too; no other column is read."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary, pattern)
        for batch in batches:
            for at, upto in byte_runs(batch.column(1), BATCH_BYTES):
                ids = [np.concatenate([np.empty(0, np.int64), *coder.chunks(t)]) for t in batch.column(1)[at:upto].to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:upto], lists], names=["key", "ids"])

    own = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return own.mapInArrow(encode, "key long, ids array<int>").withColumnRenamed("key", key)


def decode_ids(encoded: DataFrame, key: str, ids: str, vocabulary: str, pattern: str) -> DataFrame:
    """``key, data``: the bytes that each row's ids stand for; null ids give no bytes."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary, pattern)
        for batch in batches:
            for at in range(batch.num_rows):
                own = batch.column(1)[at].values
                data = coder.decode(own.to_numpy(zero_copy_only=False)) if own is not None else b""
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:at + 1], pa.array([data], pa.binary())], names=["key", "data"])

    own = encoded.select(F.col(key).cast("long").alias("key"), F.col(ids).alias("ids"))
    return own.mapInArrow(decode, "key long, data binary").withColumnRenamed("key", key)


def coded_digests(docs: DataFrame, key: str, text: str, vocabulary: str, pattern: str) -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` for each row: the digests of the decimal ids
    joined by one space and of the bytes decoded from them, part by part, so that no more than a part
    of a long text's ids is held."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary, pattern)
        for batch in batches:
            rows = []
            for own in batch.column(1):
                count, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
                for ids in coder.chunks(own.as_py()):
                    of_ids.update(((" " if count else "") + " ".join(map(str, ids.tolist()))).encode())
                    of_bytes.update(coder.decode(ids))
                    count += len(ids)
                rows.append((count, of_ids.hexdigest(), of_bytes.hexdigest()))
            counts, ids, data = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(data, pa.string())],
                                             names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    own = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return own.mapInArrow(digest, "key long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row of ``documents``. A null text is
    empty and has no tokens; null and repeated ids are kept as they stand."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return coded_digests(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
