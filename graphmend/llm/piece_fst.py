"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is compiled into the parts of a transducer: the normaliser
(spaces become the meta symbol, a dummy prefix is added), one arc for each
piece, and byte arcs for characters without a piece.  Composed with an input
these give a lattice; encoding is its shortest path in the tropical
semiring.

* Unigram models: an arc weighs minus the piece's score.
* BPE models: scores are merge ranks, whose sum says nothing, so the lattice is
  composed with an acceptor over neighbouring pieces: a step from piece ``u``
  to ``v`` weighs 0 if merging the text ``uv`` by rank ends in exactly ``u, v``,
  and infinity if not.  A sequence is what BPE gives if and only if all its
  neighbours are such pairs, so one path of finite weight is left.

Pieces never hold a space after another character, so words with the space
before them are independent; each distinct word is searched once.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmend.llm.common import bounded_batches, text_of
from graphmend.llm.word_cache import RAW, WordCache, space_parts

META = "▁"
# Field numbers and values of the public SentencePiece model format.
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_UNIGRAM, _BPE = 1, 2


def _fields(data: bytes):
    """``(number, value)`` of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at:at + n]
        at += n


class PieceTransducer:
    """Encoder and decoder compiled from a model file."""

    def __init__(self, path: str, cache: int = 400_000):
        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        self.pieces: list[str] = []
        self.scores: list[float] = []
        kinds: list[int] = []
        for number, value in top:
            if number == 1:
                p = dict(_fields(value))
                self.pieces.append(p.get(1, b"").decode("utf-8"))
                self.scores.append(float(np.frombuffer(p[2], "<f4")[0]) if 2 in p else 0.0)
                kinds.append(p.get(3, _NORMAL))
        trainer = dict(_fields(b"".join(v for n, v in top if n == 2)))
        normal = dict(_fields(b"".join(v for n, v in top if n == 3)))
        self.model = trainer.get(3, _UNIGRAM)
        self.prefix = bool(normal.get(3, 1))
        if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or _USER in kinds:
            raise ValueError("only models with the identity normaliser, kept white space and no user symbols are supported")
        self.vocab = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == _NORMAL}
        self.unknown = kinds.index(_UNKNOWN)
        byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == _BYTE}
        self.byte_ids = [byte_id[b] for b in range(256)] if len(byte_id) == 256 else None
        if any(META in p.lstrip(META) for p in self.vocab):
            raise ValueError("a piece holds a space after another character")
        self._index()
        self.output = [b"" if k == _CONTROL else b" \xe2\x81\x87 " if k == _UNKNOWN else bytes([int(p[3:5], 16)]) if k == _BYTE
                       else p.replace(META, " ").encode() for p, k in zip(self.pieces, kinds)]
        self._pairs: dict[tuple[str, str], bool] = {}
        self._reached: dict[str, bool] = {}
        self._limit = cache
        self._words = WordCache(space_parts, lambda p: array("I", self.word_ids(p[1:] if p[:1] == RAW else " " + p)).tobytes())

    def _index(self) -> None:
        """Prefixes of all pieces, with whether the prefix is a piece itself."""
        self.prefixes = {p[:k]: False for p in self.vocab for k in range(1, len(p))}
        self.prefixes.update(dict.fromkeys(self.vocab, True))

    # -- arcs -------------------------------------------------------------
    def _merge(self, text: str) -> list[str]:
        """Symbols that merging by rank leaves of a short text."""
        rank, scores = self.vocab, self.scores
        sym = list(text)
        while True:
            best, at = -math.inf, -1
            for k in range(len(sym) - 1):
                i = rank.get(sym[k] + sym[k + 1])
                if i is not None and scores[i] > best:
                    best, at = scores[i], k
            if at < 0:
                return sym
            sym[at:at + 2] = [sym[at] + sym[at + 1]]

    def neighbours(self, u: str, v: str) -> bool:
        """Weight of the acceptor: whether ``v`` may follow ``u`` in a BPE model."""
        key = (u, v)
        ok = self._pairs.get(key)
        if ok is None:
            if len(self._pairs) > self._limit:
                self._pairs.clear()
            ok = self._pairs[key] = self._merge(u + v) == [u, v]
        return ok

    def reached(self, v: str) -> bool:
        """Whether merging the text of an arc ends in that one piece, so that it may begin a path."""
        ok = self._reached.get(v)
        if ok is None:
            if len(self._reached) > self._limit:
                self._reached.clear()
            ok = self._reached[v] = self._merge(v) == [v]
        return ok

    # -- composition and shortest path ---------------------------------------
    def _arcs(self, text: str, at: int) -> list[str]:
        """Labels of the arcs that leave a lattice state, shortest first, by a walk down the piece prefixes."""
        out, z, n = [text[at]], at + 2, len(text)
        prefixes = self.prefixes
        while z <= n:
            v = text[at:z]
            piece = prefixes.get(v)
            if piece is None:
                break
            if piece:
                out.append(v)
            z += 1
        return out

    def _path_bpe(self, text: str) -> list[str]:
        """The only finite path: states are (position, last piece), dead ones are remembered."""
        if text in self.vocab and self.reached(text):
            return [text]
        path: list[str] = []
        todo = [self._arcs(text, 0)]
        at, dead = 0, set()
        while at < len(text):
            options = todo[-1]
            while options:
                v = options.pop()
                if (at, v) not in dead and (self.neighbours(path[-1], v) if path else self.reached(v)):
                    path.append(v)
                    at += len(v)
                    if at < len(text):
                        todo.append(self._arcs(text, at))
                    break
            else:
                todo.pop()
                v = path.pop()
                at -= len(v)
                dead.add((at, v))
        return path

    def _path_unigram(self, text: str) -> list[str]:
        """Viterbi over positions; a character without a piece weighs more than any piece."""
        low = max(-min(self.scores), 0.0) + 10.0
        best: list[tuple[float, str]] = [(0.0, "")] + [(math.inf, "")] * len(text)
        for at in range(len(text)):
            for v in self._arcs(text, at):
                w = best[at][0] + (-self.scores[self.vocab[v]] if v in self.vocab else low)
                if w < best[at + len(v)][0]:
                    best[at + len(v)] = (w, v)
        path, at = [], len(text)
        while at:
            path.append(best[at][1])
            at -= len(path[-1])
        return path[::-1]

    def word_ids(self, word: str) -> list[int]:
        """Ids of a text by the shortest path, without the dummy prefix."""
        text = word.replace(" ", META)
        out: list[int] = []
        for v in (self._path_bpe if self.model == _BPE else self._path_unigram)(text):
            i = self.vocab.get(v)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in v.encode("utf-8", "surrogatepass"))
            else:
                out.append(self.unknown)
        return out

    # -- texts -----------------------------------------------------------
    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        return self._words.encode([" " + t if self.prefix and t else t for t in texts])

    def decode(self, ids) -> str:
        """The text of an id sequence; broken byte runs become U+FFFD."""
        text = b"".join(map(self.output.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


_LOADED: dict[str, PieceTransducer] = {}


def transducer(path: str) -> PieceTransducer:
    """One transducer for each worker process and model file."""
    if path not in _LOADED:
        _LOADED[path] = PieceTransducer(path)
    return _LOADED[path]


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)``: piece ids of every whole text.

    Null and empty texts have no ids.  Repeated rows and null ids stay as they
    are; other columns are not read; an empty table gives an empty result.
    """
    import pyarrow as pa

    bounded_batches(docs.sparkSession, 4)

    def kernel(batches):
        fst = transducer(model)
        for b in batches:
            parts = fst.encode(b.column(1).to_pylist())
            flat = pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32())
            ends = pa.array(np.r_[0, np.cumsum([len(p) // 4 for p in parts])], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "ids"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return src.mapInArrow(kernel, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)`` of id sequences; null sequences give the empty text."""
    import pyarrow as pa

    bounded_batches(encoded.sparkSession, 4)

    def kernel(batches):
        fst = transducer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([fst.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    src = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return src.mapInArrow(kernel, "doc_id long, text string")


def piece_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_ids, ids_crc32, decoded_sha256, round_trip)`` of every whole text.

    Encodes and decodes like ``encode_pieces`` and ``decode_pieces`` in one pass;
    only digests leave the task.  ``ids_crc32`` is unsigned, over the ids as
    little-endian unsigned 32-bit integers.
    """
    import pyarrow as pa

    bounded_batches(docs.sparkSession, 4)

    def kernel(batches):
        fst = transducer(model)
        for b in batches:
            texts = b.column(1).to_pylist()
            parts = fst.encode(texts)
            back = [fst.decode(array("I", p)) for p in parts]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(p) // 4 for p in parts], pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                pa.array([x == y for x, y in zip(back, texts)], pa.bool_())],
                names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return src.mapInArrow(kernel, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
