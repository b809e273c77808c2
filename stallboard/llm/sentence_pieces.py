"""Operator 13: SentencePiece BPE encoding by a merge-type prefix table, and decoding.

SentencePiece joins, again and again, the neighbouring symbols whose concatenation is the piece of
the highest score (the leftmost of equals). Any run of tokens that this leaves is also what it
leaves of that run's own text, so each prefix of a text has one last token, and a token can follow
another exactly if the two survive side by side when their text is encoded alone. The table
stores the last token of every prefix: an automaton over all pieces lists the pieces that end at a
place, and the one that is compatible with the last token before it is stored. Reading the table
from the end backwards gives the ids. No symbol is ever merged in a text.

Compatibility of two tokens replays only the merges of both in order of score and asks whether a
merge across their border would have come first; answers are remembered.

No merge joins two characters that are neighbours in no piece, so texts are cut there (in
particular before a space mark after another character). Each distinct segment is encoded once
and its ids are gathered for every place it stands at. Characters without a piece become the ids of
their bytes (or the unknown id if the model has none).

Supported are BPE models with an identity normalizer, without user-defined or unused pieces;
others raise ValueError.

Nulls and empties: null and empty texts have no ids and decode to an empty text. Repeated rows
are encoded alike. An empty table gives an empty result. ``ids`` and ``decoded`` columns of the
input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stallboard.llm.common import byte_slices

#: Fixed value: the mark that SentencePiece writes for a space.
SPACE = "▁"
SLICE_BYTES = 4 << 20
#: Segments and pairs of tokens that a worker remembers; beyond that it starts anew.
REMEMBERED_SEGMENTS = 250_000
REMEMBERED_PAIRS = 250_000
NEVER = 1 << 62


class PieceTable:
    """Pieces, their merge order, and the automaton of a model file."""

    def __init__(self, path: str):
        import ahocorasick

        self.library = library(path)
        self._check(self.library)
        lib, size = self.library, self.library.vocab_size()
        normal = [k for k in range(size) if not (lib.is_control(k) or lib.is_unknown(k) or lib.is_byte(k))]
        self.names = {k: lib.id_to_piece(k) for k in normal}
        scores = sorted({lib.get_score(k) for k in normal}, reverse=True)
        order = {s: k for k, s in enumerate(scores)}
        #: piece -> place in the order of merges, equal scores share one
        self.rank = {name: order[lib.get_score(k)] for k, name in self.names.items()}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = lib.unk_id()
        self.has_bytes = all(lib.is_byte(k) for k in self.bytes)
        self.size = size
        self.automaton = ahocorasick.Automaton()
        self.sides: dict[int, tuple] = {}
        for k, name in self.names.items():
            steps = self._merges(name)
            if steps is not None:
                self.sides[k] = steps
                self.automaton.add_word(name, (k, len(name)))
        self.automaton.make_automaton()
        self.token = {self.names[k]: k for k in self.sides}
        self.length = [len(self.names.get(k, "")) for k in range(size)]
        #: neighbours in some piece, as a table of hashes: a false hit only makes a segment longer
        self.neighbours = np.zeros(1 << 22, bool)
        for name in self.names.values():
            points = np.frombuffer(name.encode("utf-32-le"), np.uint32)
            self.neighbours[_neighbour_hash(points)] = True
        self.pairs: dict[int, bool] = {}
        self.chars: dict[str, int] = {}
        self.forget()

    @staticmethod
    def _check(lib) -> None:
        from sentencepiece import sentencepiece_model_pb2 as model

        proto = model.ModelProto()
        proto.ParseFromString(lib.serialized_model_proto())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        kinds = {p.type for p in proto.pieces}
        piece = model.ModelProto.SentencePiece
        if (train.model_type != model.TrainerSpec.BPE or norm.precompiled_charsmap or not norm.add_dummy_prefix
                or norm.remove_extra_whitespaces or not norm.escape_whitespaces or train.treat_whitespace_as_suffix
                or {piece.USER_DEFINED, piece.UNUSED} & kinds):
            raise ValueError("only BPE models with an identity normalizer and plain pieces are supported")

    def _merges(self, name: str) -> tuple[tuple, tuple, str, str] | None:
        """How a piece's own characters merge: (merge order, symbol at the right end after it) of every merge, the
        same for the left end, and the first symbols at both ends; None if they do not become the piece."""
        symbols = list(name)
        right, left = [], []
        while len(symbols) > 1:
            best, at = min((self.rank.get(a + b, NEVER), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])))
            if best == NEVER:
                return None
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
            right.append((best, symbols[-1]))
            left.append((best, symbols[0]))
        return tuple(right), tuple(left), name[-1], name[0]

    def _side(self, token: int) -> tuple:
        """Merges of a token; a number past the vocabulary is a character without a piece."""
        return self.sides[token] if token < self.size else ((), (), chr(token - self.size), chr(token - self.size))

    def compatible(self, a: int, b: int) -> bool:
        """Whether the texts of two tokens, side by side, are encoded as just these tokens."""
        key = a << 22 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._replay(a, b)
        return known

    def _replay(self, a: int, b: int) -> bool:
        first, _, end, _ = self._side(a)
        _, second, _, begin = self._side(b)
        i = j = 0
        while True:
            across = self.rank.get(end + begin, NEVER)
            one = first[i][0] if i < len(first) else NEVER
            two = second[j][0] if j < len(second) else NEVER
            # of equal scores the leftmost goes first: in a, across, in b
            if across < one and across <= two:
                return False
            if one <= two and one < NEVER:
                end, i = first[i][1], i + 1
            elif two < NEVER:
                begin, j = second[j][1], j + 1
            else:
                return True

    def encode_segment(self, text: str) -> list[int]:
        """Ids of one text (space marks in place of spaces) by its prefix table."""
        whole = self.token.get(text)
        if whole is not None:
            return [whole]
        last = [-1] * (len(text) + 1)
        known, compatible = self.pairs.get, self.compatible
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            if end > length:
                before = last[end - length]
                if before < 0:
                    continue
                fits = known(before << 22 | token)
                if not (compatible(before, token) if fits is None else fits):
                    continue
            last[end] = token
        if last[-1] < 0:
            last = self._with_unknown(text)
        out, at, size, length = [], len(text), self.size, self.length
        while at:
            token = last[at]
            if token < size:
                out.append(token)
                at -= length[token]
            else:
                at -= 1
                out.extend([self.bytes[x] for x in reversed(text[at].encode())] if self.has_bytes else [self.unknown])
        return out[::-1]

    def _with_unknown(self, text: str) -> list[int]:
        """The prefix table of a text in which characters without a piece are tokens of their own."""
        last = [-1] * (len(text) + 1)
        ending: dict[int, list[tuple[int, int]]] = {}
        for end, found in self.automaton.iter(text):
            ending.setdefault(end + 1, []).append(found)
        for end, char in enumerate(text, 1):
            own = ending.get(end, []) if char in self.rank else [*ending.get(end, []), (self.size + ord(char), 1)]
            for token, length in own:
                before = last[end - length]
                if end == length or before >= 0 and self.compatible(before, token):
                    last[end] = token
                    break
        return last

    def forget(self) -> None:
        self.segments = pa.array([], pa.large_string())
        self.starts = np.zeros(1, np.int64)
        self.ids = np.empty(0, np.int32)

    def _numbers(self, parts: pa.Array) -> np.ndarray:
        """Place of each segment among the remembered ones; new ones are encoded."""
        coded = parts.dictionary_encode()
        distinct = coded.dictionary
        known = pc.index_in(distinct, value_set=self.segments)
        fresh = distinct.filter(pc.is_null(known))
        if len(fresh):
            if len(self.segments) + len(fresh) > REMEMBERED_SEGMENTS:
                self.forget()
                fresh = distinct
            own = [self.encode_segment(s) for s in fresh.to_pylist()]
            self.ids = np.concatenate([self.ids, np.fromiter((x for ids in own for x in ids), np.int32)])
            self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum([len(x) for x in own])))
            self.segments = pa.concat_arrays([self.segments, fresh])
            known = pc.index_in(distinct, value_set=self.segments)
        return known.to_numpy(zero_copy_only=False).astype(np.int64)[coded.indices.to_numpy(zero_copy_only=False)]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of each text in them) of whole texts."""
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        ends = np.cumsum([len(t) for t in marked], dtype=np.int64)
        joined = "".join(marked)
        if not joined:
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        cut = np.ones(len(points) + 1, bool)
        cut[1:-1] = ~self.neighbours[_neighbour_hash(points)]
        cut[ends] = True
        begin = np.flatnonzero(cut)
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        bounds = np.concatenate(([0], np.cumsum(width)))[begin]
        data = np.frombuffer(joined.encode(), np.uint8)
        parts = pa.Array.from_buffers(pa.large_string(), len(begin) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds)), pa.py_buffer(data)])
        number = self._numbers(parts)
        lens = self.starts[number + 1] - self.starts[number]
        upto = np.concatenate(([0], np.cumsum(lens)))
        place = np.repeat(self.starts[number] - upto[:-1], lens) + np.arange(upto[-1])
        return self.ids[place], upto[np.searchsorted(begin, np.concatenate(([0], ends)))]


def _neighbour_hash(points: np.ndarray) -> np.ndarray:
    """A 22-bit hash of every two neighbouring code points."""
    mixed = points[:-1] * np.uint32(0x9E3779B1) + points[1:] * np.uint32(0x85EBCA6B)
    return mixed >> np.uint32(10)


@lru_cache(maxsize=2)
def library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def piece_table(path: str) -> PieceTable:
    return PieceTable(path)


def encode(docs: DataFrame, model: str, decoded: bool = False) -> DataFrame:
    """All columns of ``docs`` with ``ids``: the ids of the whole text by the model file ``model``; with ``decoded``
    also the text that the library's decoder makes of them, as ``decode`` adds it, in the same pass."""
    own = docs.drop("ids", "decoded") if decoded else docs.drop("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model)
        for batch in byte_slices(batches, "text", SLICE_BYTES):
            ids, offsets = table.encode(batch.column("text").cast(pa.string()).to_pylist())
            new = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))]
            if decoded:
                new.append(pa.array([table.library.decode(ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:])], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *("ids", "decoded")[:len(new)]])

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * decoded
    return own.mapInArrow(run, T.StructType([*own.schema.fields, *fields]))


def decode(coded: DataFrame, model: str) -> DataFrame:
    """All columns of ``coded`` with ``decoded``: the text of its ``ids`` by the library's own decoder (null ids: empty)."""
    own = coded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = library(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                texts = [decoder.decode(x.as_py() or []) for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("decoded", T.StringType())]))
