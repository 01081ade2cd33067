"""SentencePiece encoding and decoding with the source bytes of every piece."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .charmap import CharMap, normalise
from .common import engine

#: Texts that are encoded together in a worker; it bounds memory only.
TOGETHER = 128
FIELDS = "ids array<int>, offsets array<int>, decoded string"


class PieceEncoder:
    """A sentencepiece model with longest-prefix normalisation and byte spans.

    ``encode`` normalises a text through the model's compiled map, with the
    source of every byte of the normal form, has the library segment that
    normal form (by the same model without a normaliser of its own), lays the
    pieces along it, checks that they spell it, and projects each to the
    source. It gives per text its ids and ``offsets``: piece i stands for the
    source bytes ``offsets[i]`` to ``offsets[i + 1]``. Every source byte is in
    one span: what normalisation drops belongs to the piece before it (at the
    start: the first). A byte piece spans its own byte where the map copies
    the character.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.spec = sentencepiece_model_pb2.NormalizerSpec()
        self.spec.CopyFrom(proto.normalizer_spec)
        self.chars = CharMap(self.spec.precompiled_charsmap, [p.piece for p in proto.pieces if p.type == 4])
        proto.normalizer_spec.Clear()
        proto.normalizer_spec.name = "identity"
        proto.normalizer_spec.add_dummy_prefix = proto.normalizer_spec.remove_extra_whitespaces = proto.normalizer_spec.escape_whitespaces = False
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.is_byte = np.array([p.type == 6 for p in proto.pieces])
        self.spelt_by_ids = proto.trainer_spec.byte_fallback
        # what each id spells in the normal form, in one array
        spelling = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.encode() for p in proto.pieces]
        self.size = np.array([len(x) for x in spelling], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.spelling = np.frombuffer(b"".join(spelling), np.uint8)

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        spec, whole = self.spec, [t or "" for t in texts]
        normal = [normalise(t, self.chars, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces) for t in whole]
        strings = [n.decode() for n, _ in normal]
        if not self.spelt_by_ids:  # an unknown piece says what it stands for only in the library's own message
            return [self._laid([(p.id, 1 if self.is_byte[p.id] else len(p.piece.encode())) for p in self.segmenter.encode(n, return_type="proto").pieces], *m, t) for n, m, t in zip(strings, normal, whole, strict=True)]
        out = []
        for found, (norm, source), t in zip(self.segmenter.encode(strings, num_threads=1), normal, whole, strict=True):
            ids = np.array(found, np.int32)
            size = self.size[ids]
            at = np.repeat(self.first[ids] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            if self.spelling[at].tobytes() != norm:
                raise ValueError("the pieces don't spell the normal form")
            out.append(self._projected(ids, size, source, t))
        return out

    def _laid(self, parts: list[tuple[int, int]], norm: bytes, source: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([n for _, n in parts], np.int64)
        if size.sum() != len(norm):
            raise ValueError("the pieces don't cover the normal form")
        return self._projected(np.array([k for k, _ in parts], np.int32), size, source, text)

    @staticmethod
    def _projected(ids: np.ndarray, size: np.ndarray, source: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.zeros(len(ids) + 1, np.int32)
        offsets[:-1] = source[np.cumsum(size) - size]
        offsets[:1] = 0
        offsets[-1] = len(text.encode())
        return ids, offsets

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids alone."""
        return [np.array(x, np.int32) for x in self.library.encode(texts, num_threads=1)]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.library.decode([x.tolist() for x in ids], num_threads=1) if ids else []


def piece_encoder(path: str) -> PieceEncoder:
    return engine(("pieces", path), lambda: PieceEncoder(path))


def lists(arrays: list[np.ndarray], kind=None) -> pa.ListArray:
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int32), kind or pa.int32()))


def encoded(text: Column, model_path: str, decode: bool = True) -> Column:
    """A struct of ``ids``, ``offsets`` (source bytes) and ``decoded`` (null unless asked for).

    A null text is the empty text: no ids, offsets [0], decoded ''. Texts of
    any length are encoded whole.
    """
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int32())), ("decoded", pa.string())])

    @F.arrow_udf(FIELDS)
    def encode(texts: pa.Array) -> pa.Array:
        encoder, parts = piece_encoder(model_path), []
        for at in range(0, len(texts), TOGETHER):
            got = encoder.encode(texts[at : at + TOGETHER].to_pylist())
            ids = [x[0] for x in got]
            back = pa.array(encoder.decode(ids) if decode else [None] * len(ids), pa.string())
            parts.append(pa.StructArray.from_arrays([lists(ids), lists([x[1] for x in got]), back], fields=list(kind)))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return encode.asNondeterministic()(text)
