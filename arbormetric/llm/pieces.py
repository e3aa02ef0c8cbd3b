"""Sampled SentencePiece segmentations by forward filtering and backward sampling; lossless decoding."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from arbormetric.llm.near import _mixed
from arbormetric.llm.tables import table

#: Fixed values of the format: the sign that stands for a blank.
BLANK = 0x2581
#: The code under which that sign itself, which is encoded as bytes, goes through the lattice.
LITERAL = 0x110000 + BLANK
WIDTH = 21
#: Distinct words whose lattices a worker keeps before it starts afresh.
REMEMBERED = 300_000
BATCH = 256
#: No piece holds a line break or a blank behind another sign, so the lattice of a text falls
#: apart into those of its words with the blanks before them.
WORD = re.compile(r"\n| *[^ \n]+| +")


class Growing:
    """An array that is appended to."""

    def __init__(self, dtype):
        self.data, self.n = np.empty(1 << 16, dtype), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.empty(self.n + 2 * len(more), self.data.dtype)])
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)


def _ragged(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for each range, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class PieceModel:
    """The pieces of a model with a log-probability each, as a trie over code points.

    A unigram model's scores are log-probabilities. A BPE model only has the order of its
    merges, which is read as the pieces' order by frequency: by Zipf's law the piece of rank r has
    a probability in proportion to 1 / (r + 10).
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        scores = np.array([model.get_score(i) for i in plain])
        if np.array_equal(scores, np.round(scores)) and len(scores) > 1:
            scores = -np.log(scores.max() - scores + 10)
            scores -= np.log(np.exp(scores).sum())
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.least = float(scores.min()) - 1
        self.texts = [b""] * size
        children: dict[int, int] = {}
        ends = {}
        for i, score in zip(plain, scores, strict=True):
            piece = model.id_to_piece(i)
            self.texts[i] = piece.replace(chr(BLANK), " ").encode()
            node = 0
            for code in map(ord, piece):
                node = children.setdefault(node << WIDTH | code, len(children) + 1)
            ends[node] = (i, score)
        for value, i in self.bytes.items():
            self.texts[i] = bytes([value])
        keys = np.fromiter(children, np.int64, len(children))
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], np.fromiter(children.values(), np.int64, len(children))[order]
        self.piece, self.score = np.full(len(children) + 1, -1), np.zeros(len(children) + 1)
        at = np.fromiter(ends, np.int64, len(ends))
        self.piece[at], self.score[at] = [e[0] for e in ends.values()], [e[1] for e in ends.values()]
        sizes = np.array([len(t) for t in self.texts])
        self.starts, self.sizes, self.flat = np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(self.texts), np.uint8)

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The trie's child for each node and code, 0 for none."""
        key = node << WIDTH | code
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.nodes[at], 0)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ``ids`` in UTF-8, with the blank that encoding puts before it taken off."""
        return self.flat[_ragged(self.starts[ids], self.sizes[ids])].tobytes()[1:]


class Lattices:
    """Lattices of words, each as nodes between characters with the pieces that end there, their
    first nodes and, by forward filtering, their cumulative probabilities for the way back."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.last: dict[str, int] = {}
        self.edges, self.origin, self.piece, self.chance = Growing(np.int64), Growing(np.int64), Growing(np.int64), Growing(float)
        self.edges.add(np.zeros(1, np.int64))

    def learn(self, words: list[str]) -> None:
        words.sort(key=len, reverse=True)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        code = np.where(code == BLANK, LITERAL, np.where(code == 32, BLANK, code))
        first = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        # A word of n characters has n + 1 nodes.
        node_of = np.arange(len(code)) + word
        end_of = np.repeat(first + sizes, sizes)
        starts, lengths, pieces, scores = [], [], [], []
        at, node, length = np.arange(len(code)), np.zeros(len(code), np.int64), 0
        while len(at):
            node = self.model.step(node, code[at + length])
            length += 1
            at, node = at[node > 0], node[node > 0]
            full = self.model.piece[node] >= 0
            starts.append(at[full]), lengths.append(np.full(full.sum(), length))
            pieces.append(self.model.piece[node[full]]), scores.append(self.model.score[node[full]])
            if length == 1:
                bare = np.ones(len(code), bool)
                bare[at[full]] = False
                bare = np.flatnonzero(bare)
                # Characters that are no piece go as bytes: one id for ASCII, else minus the code.
                single = np.array([self.model.bytes[c] if c < 128 else -int(c) for c in code[bare].tolist()], np.int64)
                number = 1 + (code[bare] >= 0x80) + (code[bare] >= 0x800) + ((code[bare] >= 0x10000) & (code[bare] != LITERAL))
                starts.append(bare), lengths.append(np.ones(len(bare), np.int64)), pieces.append(single), scores.append(number * self.model.least)
            more = at + length < end_of[at]
            at, node = at[more], node[more]
        start, piece, score = np.concatenate(starts), np.concatenate(pieces), np.concatenate(scores)
        origin = node_of[start]
        end = origin + np.concatenate(lengths)
        order = np.argsort(end, kind="stable")
        origin, end, piece, score = origin[order], end[order], piece[order], score[order]
        nodes = len(code) + len(words)
        per_node = np.bincount(end, minlength=nodes)
        edge = np.concatenate([[0], np.cumsum(per_node)])
        weight = np.zeros(nodes)
        first_node = first + np.arange(len(words))
        for place in range(1, int(sizes[0]) + 1 if len(sizes) else 1):
            own = first_node[: np.searchsorted(-sizes, -place, side="right")] + place
            e = _ragged(edge[own], per_node[own])
            weight[own] = np.logaddexp.reduceat(weight[origin[e]] + score[e], np.cumsum(per_node[own]) - per_node[own])
        total = np.cumsum(np.exp(weight[origin] + score - weight[end]))
        before = np.concatenate([[0.0], total])[edge[:-1]]
        shift = len(self.edges.data[: self.edges.n]) - 1
        self.chance.add(total - before[end])
        self.origin.add(origin + shift)
        self.piece.add(piece)
        self.edges.add(edge[1:] + self.edges.data[self.edges.n - 1])
        self.last.update(zip(words, (first_node + sizes + shift).tolist(), strict=True))

    def sample(self, last: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces, in order, and their number for each word, drawn from its last node backwards.
        The k-th draw of a word only depends on its seed and k."""
        edges, origin, piece, chance = self.edges.data, self.origin.data, self.piece.data, self.chance.data
        word, node, k, drawn = np.arange(len(last)), last, 0, []
        while len(word):
            u = (_mixed(seed[word] + np.uint64(k * 0xD1342543DE82EF95 % 2**64)) >> np.uint64(11)).astype(float) * 2.0**-53
            e, most = edges[node], edges[node + 1] - 1
            on = np.flatnonzero((u >= chance[e]) & (e < most))
            while len(on):
                e[on] += 1
                on = on[(u[on] >= chance[e[on]]) & (e[on] < most[on])]
            drawn.append((word, piece[e]))
            node = origin[e]
            going = edges[node + 1] > edges[node]
            word, node, k = word[going], node[going], k + 1
        count = np.zeros(len(last), np.int64)
        for own, _ in drawn:
            count[own] += 1
        ends = np.cumsum(count)
        out = np.empty(ends[-1] if len(ends) else 0, np.int64)
        for k, (own, found) in enumerate(drawn):
            out[ends[own] - 1 - k] = found
        return out, count


class Sampler:
    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.lattices = Lattices(self.model)

    def encode(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """Sampled ids of each text. The draws depend on the text's key and the word's place alone."""
        if len(self.lattices.last) > REMEMBERED:
            self.lattices.forget()
        last = self.lattices.last
        words = [WORD.findall(f" {t}") if t else [] for t in texts]
        if new := [w for w in set().union(*words) if w not in last]:
            self.lattices.learn(new)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.fromiter((last[w] for ws in words for w in ws), np.int64, sizes.sum())
        place = np.arange(len(ends)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        seed = _mixed(np.repeat(_mixed(np.array(keys, np.int64).view(np.uint64)), sizes) + place.astype(np.uint64))
        ids, count = self.lattices.sample(ends, seed)
        per_text = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(sizes)])]
        return [self._with_bytes(ids[a:b]) for a, b in zip(per_text[:-1], per_text[1:], strict=True)]

    def _with_bytes(self, ids: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(ids < 0)
        if not len(at):
            return ids
        parts = [[self.model.bytes[b] for b in chr(BLANK if c == -LITERAL else -c).encode()] for c in ids[at].tolist()]
        sizes = np.ones(len(ids), np.int64)
        sizes[at] = list(map(len, parts))
        out = np.repeat(ids, sizes)
        out[np.repeat(ids < 0, sizes)] = [b for p in parts for b in p]
        return out


@functools.lru_cache(1)
def _sampler(path: str) -> Sampler:
    return Sampler(path)


def sample_pieces(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, n_pieces, ids, lossless`` for every row of ``documents``: a segmentation of the
    text drawn from the model's lattice of pieces, and whether decoding gives the text back.

    The draws are seeded by the id, so they come out the same on every run and for repeated
    rows; null ids share a seed. A null text is empty and has no pieces. Characters without a
    piece, and the sign that stands for blanks, are encoded as bytes. Other columns are not read.
    """
    import public_tokenizers

    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(path)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = part.column(2).to_pylist()
                ids = sampler.encode(texts, part.column(1).to_pylist())
                same = [sampler.model.decode(i) == t.encode() for i, t in zip(ids, texts, strict=True)]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), lists, pa.array(same)], names=["doc_id", "n_pieces", "ids", "lossless"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("doc_id").cast("long")), F.coalesce("text", F.lit("")))
    return rows.mapInArrow(draw, "doc_id long, n_pieces long, ids array<int>, lossless boolean")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_pieces(table(spark, sf_dir, "documents"))
