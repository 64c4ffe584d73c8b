"""Offset-preserving SentencePiece encoding and decoding.

Method: a text is normalised by longest-prefix matching against the model's compiled character map (a double-array
trie followed by replacement strings), recording for every normalised byte the source bytes it stands for; white
space is escaped and the dummy prefix put in front. Every piece is then projected to its span of original bytes by that
alignment. Where the map is empty the alignment has a closed form, and spans are one cumulative sum.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MARK = "▁"
#: Segments that a worker keeps, and as many older ones.
KEPT = 300_000
#: Characters of a text up to which it is looked up together with others.
TOGETHER = 1 << 22


class CharacterMap:
    """The model's precompiled character map: longest-prefix lookup in its double array."""

    def __init__(self, blob: bytes):
        self.units: array = array("I")
        self.strings = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units.frombytes(blob[4 : 4 + size])
            self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """The length of the longest key that is a prefix of data[at:], and its replacement."""
        units, best = self.units, None
        if not units:
            return None
        node = 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for i in range(at, len(data)):
            byte = data[i]
            node ^= byte
            unit = units[node]
            if (unit & ((1 << 31) | 0xFF)) != byte:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if (unit >> 8) & 1:
                start = units[node] & ((1 << 31) - 1)
                best = i + 1 - at, self.strings[start : self.strings.index(b"\0", start)]
        return best


class Encoding(NamedTuple):
    ids: list[int]
    ends: list[int]
    """The end of each piece's span of source bytes; a span begins where the last one ended."""
    covered: int
    """Source bytes that the pieces cover together."""


class Encoder:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.plain = not self.map.units and self.prefix and not self.trim and self.escape
        reach = any(MARK in p.piece.lstrip(MARK) for p in model.pieces)
        self.separable = self.plain and not reach and not model.trainer_spec.treat_whitespace_as_suffix
        # source bytes of each piece where nothing is mapped: a byte piece has one, a space mark stands for one
        self.widths = np.array([1 if p.type == 6 else len(p.piece.encode()) - 2 * p.piece.count(MARK) for p in model.pieces])
        self.decimal = [str(i) for i in range(len(model.pieces))]
        self.bare = [self.sp.piece_to_id(MARK)]
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.code, self.width = ("H", 2) if len(model.pieces) <= 1 << 16 else ("I", 4)
        self._cut = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+").findall

    def normalise(self, data: bytes) -> tuple[bytes, list[int]]:
        """The normalised bytes, and for each place between them (one more than bytes) the source place."""
        out, align, at = bytearray(), [], 0
        space = MARK.encode() if self.escape else b" "
        if self.trim:
            while data[at : at + 1] == b" ":
                at += 1
        if self.prefix and at < len(data):
            out += space
            align += [at] * len(space)
        while at < len(data):
            if (found := self.map.longest(data, at)) is None:
                first = data[at]
                step = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                new = data[at : at + step]
            else:
                step, new = found
            for n, byte in enumerate(new):
                if byte == 32:
                    if self.trim and out.endswith(space):
                        continue
                    out += space
                    align += [at] * len(space)
                else:
                    out.append(byte)
                    align.append(at if found else at + n)
            at += step
        if self.trim:
            while out.endswith(space):
                del out[-len(space) :], align[-len(space) :]
        return bytes(out), [*align, len(data)]

    def _spans(self, pieces: list[tuple[str, bool]], align: list[int]) -> list[int]:
        """Where each piece ends in the source: its place among the normalised bytes, by the recorded alignment."""
        places = accumulate(1 if byte else len(piece.encode("utf-8", "surrogatepass")) for piece, byte in pieces)
        return [align[p] for p in places]

    def encode(self, text: str | None, spans: bool = True) -> Encoding:
        """The library's ids for a whole text and, with spans, where each piece ends in the text's UTF-8 bytes."""
        if not text:
            return Encoding([], [], 0)
        if self.plain and MARK not in text:
            # nothing is mapped: a mark stands for one blank, but the dummy prefix for nothing, and all else for itself
            ids = self.sp.encode(text)
            ends = np.cumsum(self.widths[ids]) - 1
            return Encoding(ids, ends.tolist() if spans else [], int(ends[-1]))
        proto = self.sp.encode(text, return_type="proto")
        ids = [p.id for p in proto.pieces]
        _, align = self.normalise(common.utf8(text))
        ends = self._spans([(p.piece, self.sp.is_byte(p.id)) for p in proto.pieces], align)
        return Encoding(ids, ends, ends[-1] if ends else 0)

    def _learn(self, asked: set[str]) -> None:
        """Encode in few calls what isn't known yet of some segments. When enough is known, what has been met since the last
        time becomes the older half of the memory, and what isn't met again goes with it."""
        missing = asked.difference(self.kept)
        if len(self.kept) + len(missing) > KEPT:
            self.older, self.kept, missing = self.kept, {}, asked
        kept, older, new = self.kept, self.older, []
        for s in missing:
            ids = older.get(s)
            if ids is None:
                new.append(s)
            else:
                kept[s] = ids
        for at in range(0, len(new), 10_000):
            some = new[at : at + 10_000]
            for s, ids in zip(some, self.sp.encode(some, num_threads=1), strict=True):
                kept[s] = array(self.code, ids or self.bare).tobytes()

    def packed(self, texts: list[str | None], end: bytes) -> bytes:
        """The ids of whole texts as little-endian integers of two bytes (four, for a vocabulary beyond 65,536), each text ended by `end`.

        Texts are cut where no piece reaches across, and a segment that comes again isn't encoded again. Each segment stands
        behind one space mark, and the dummy prefix is such a mark, so a text of words with single blanks is segments
        throughout: such texts are looked up together.
        """
        if not self.separable:
            return b"".join(array(self.code, self.sp.encode(t or "")).tobytes() + end for t in texts)
        plain = [t for t in texts if t and self._single(t)]
        looked = iter(self._looked_up(plain, end))
        return b"".join(next(looked) if t and self._single(t) else self._cut_up(t) + end for t in texts)

    @staticmethod
    def _single(text: str) -> bool:
        return len(text) <= TOGETHER and MARK not in text and "  " not in text and text[0] != " " and text[-1] != " "

    def _cut_up(self, text: str | None) -> bytes:
        if not text:
            return b""
        first, *rest = self._cut(text)
        rest = [s[1:] for s in rest]
        self._learn(set(rest))
        return array(self.code, self.sp.encode(first)).tobytes() + b"".join(map(self.kept.__getitem__, rest))

    def _looked_up(self, texts: list[str], end: bytes) -> Iterator[bytes]:
        if not texts:
            return
        words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = words.flatten().dictionary_encode()
        known = coded.dictionary.to_pylist()
        self._learn(set(known))
        pieces = list(map(self.kept.__getitem__, known))
        kind = np.dtype(f"<u{self.width}")
        flat = np.frombuffer(b"".join(pieces), kind)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // self.width
        index = coded.indices.to_numpy()
        taken = size[index]
        after = np.cumsum(taken)
        ids = flat[np.repeat((np.cumsum(size) - size)[index] - (after - taken), taken) + np.arange(int(after[-1]))]
        edges = np.concatenate((np.zeros(1, np.int64), after))[words.offsets.to_numpy()].tolist()
        data = ids.tobytes()
        for a, b in zip(edges, edges[1:]):
            yield data[a * self.width : b * self.width] + end

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per worker and model."""
    return Encoder(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for b in batches:
        found = [enc.encode(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([e.ids for e in found], pa.list_(pa.int32())), pa.array([[0, *e.ends[:-1]] if e.ends else [] for e in found], pa.list_(pa.int32())), pa.array([e.ends for e in found], pa.list_(pa.int32()))], names=["id", "ids", "begins", "ends"])


def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    for b in batches:
        out = [], [], [], []
        for text in b.column("text").to_pylist():
            e = enc.encode(text)
            shown = ",".join([enc.decimal[i] for i in e.ids])
            covered = sum(map(int.__sub__, e.ends, [0, *e.ends[:-1]]))
            for column, value in zip(out, (len(e.ids), sha(shown), sha(enc.decode(e.ids)), covered), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True))], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"])


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([None if i is None else enc.decode(i) for i in b.column("ids").to_pylist()], pa.string())], names=["id", "decoded"])


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids, begins, ends): each piece's id and its span of the text's UTF-8 bytes, one row per input row.

    Null and empty texts give empty arrays. A dummy prefix has an empty span, a byte piece has its byte, and of the byte
    pieces of a mapped character the last has its bytes. Null and repeated ids are carried as they are; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = common.arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), partial(_encode, path=model_path), f"id {kind}, ids array<int>, begins array<int>, ends array<int>")
    return rows.withColumnRenamed("id", id_col)


def decode_pieces(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (doc_id, decoded); null ids decode to null, no ids to an empty text."""
    kind = dict(encoded.dtypes)[id_col]
    rows = common.arrow_map(encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), partial(_decode, path=model_path), f"id {kind}, decoded string")
    return rows.withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes): encode_pieces and decode_pieces in one pass, as digests."""
    kind = dict(docs.dtypes)[id_col]
    rows = common.arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), partial(_digest, path=model_path), f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, covered_bytes bigint")
    return rows.withColumnRenamed("id", id_col)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
