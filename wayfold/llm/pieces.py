"""SentencePiece encoding and decoding by vectorised merge rounds.

Reads the pieces of a byte-pair model file itself (protobuf fields: pieces = 1 with piece = 1, score = 2, type = 3)
and encodes as the sentencepiece library does with it: spaces become U+2581 and one more is put in front; characters
merge by falling score, from the left; unknown characters become byte pieces. No piece holds U+2581 behind another
character, and none longer than one character holds a line feed, so a text falls into segments that never share a
piece. Segments repeat: each new one of a batch is merged once, all together (`merges.MergeTable`).
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.merges import MergeTable
from wayfold.llm.packing import grouped

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Segments that a worker remembers, and the longest that it does.
CACHED, CACHED_CHARS = 250_000, 48

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        else:
            raise ValueError(f"not a model file: wire type {kind}")
        yield tag >> 3, value


def read_model(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) of each id."""
    out = []
    for number, value in _fields(data):
        if number == 1:
            one = dict(_fields(value))
            out.append((one.get(1, b"").decode("utf-8"), one.get(2, 0.0), one.get(3, NORMAL)))
    return out


class Pieces:
    """Encodes and decodes with one model."""

    def __init__(self, data: bytes):
        model = read_model(data)
        if any(kind in (USER, UNUSED) for _, _, kind in model):
            raise ValueError("models with user-defined or unused pieces are not supported")
        ids = {p: k for k, (p, _, kind) in enumerate(model) if kind == NORMAL}
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in ids):
            raise ValueError("pieces that hold U+2581 behind another character, or a line feed, are not supported")
        self.byte_ids = np.full(256, -1, dtype=np.int64)
        for k, (p, _, kind) in enumerate(model):
            if kind == BYTE:
                self.byte_ids[int(p[3:-1], 16)] = k
        if (self.byte_ids < 0).any():
            raise ValueError("models without byte pieces are not supported")
        symbols = dict(ids)
        for p in ids:
            for c in p:
                symbols.setdefault(c, len(model) + len(symbols))  # part of a piece, yet no piece itself
        self.n_ids = len(model)
        place = {p: k for k, p in enumerate(sorted(ids, key=lambda p: (-model[ids[p]][1], ids[p])))}
        rows = [(symbols[p[:k]], symbols[p[k:]], place[p], ids[p]) for p in ids for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        self.table = MergeTable(*(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)))
        self.symbol_of = np.full(0x110000, -1, dtype=np.int32)
        for s, k in symbols.items():
            if len(s) == 1:
                self.symbol_of[ord(s)] = k
        self.known_char = np.zeros(0x110000, dtype=bool)
        self.known_char[[ord(p) for p in ids if len(p) == 1]] = True
        #: What decode() puts for an id: bytes, U+2581 as a space.
        self.surface = [p.replace(SPACE, " ").encode() if kind == NORMAL else bytes([int(p[3:-1], 16)]) if kind == BYTE else b" \xe2\x81\x87 " if kind == UNKNOWN else b"" for p, _, kind in model]
        self.kind = [kind for _, _, kind in model]
        self.known: dict[str, tuple[int, bytes, bytes]] = {}

    def segments(self, texts: list[str]) -> list[list[str]]:
        """A text's segments; an empty text has none."""
        find = re.compile(rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+").findall
        return [find((SPACE + t).replace(" ", SPACE)) if t else [] for t in texts]

    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments, one after the other, and how many each has."""
        chars = np.frombuffer("".join(segments).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        sym = self.symbol_of[chars]
        sym[sym < 0] = (-1 - chars[sym < 0]).astype(np.int32)  # keeps what character it was
        lengths = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        sym, counts = self.table.merge(sym, lengths)
        bad = (sym < 0) | (sym >= self.n_ids)
        if not bad.any():
            return sym.astype(np.int64), counts
        # unknown characters: their UTF-8 bytes
        char_of = {int(k): c for c, k in ((c, self.symbol_of[c]) for c in np.flatnonzero(self.symbol_of >= self.n_ids))}
        word = np.repeat(np.arange(len(counts)), counts)
        at, ids, n = np.flatnonzero(bad), sym.astype(np.int64), np.ones(len(sym), dtype=np.int64)
        codes = [chr(-1 - s if s < 0 else char_of[s]).encode("utf-8", "replace") for s in sym[at].tolist()]
        n[at] = [len(c) for c in codes]
        out = np.repeat(ids, n)
        out[np.repeat(bad, n)] = self.byte_ids[np.frombuffer(b"".join(codes), dtype=np.uint8)]
        return out, np.bincount(np.repeat(word, n), minlength=len(counts))

    def encode(self, texts: list[str]) -> list[list[int]]:
        segments = self.segments(texts)
        ids, counts = self.encode_segments([s for one in segments for s in one])
        ends, out, at, k = np.cumsum(counts), [], 0, 0
        for one in segments:
            k += len(one)
            end = int(ends[k - 1]) if k else 0
            out.append(ids[at:end].tolist())
            at = end
        return out

    def decode(self, ids: list[int]) -> str:
        """As the library does: control pieces vanish, the space put in front goes, bytes that are no UTF-8 become U+FFFD."""
        return self.text_of(b"".join([self.surface[k] for k in ids]))

    @staticmethod
    def text_of(surface: bytes) -> str:
        return (surface[1:] if surface[:1] == b" " else surface).decode("utf-8", "replace")

    def _learn(self, new: list[str]) -> dict[str, tuple[int, bytes, bytes]]:
        ids, counts = self.encode_segments(new)
        flat, out, at = ids.tolist(), {}, 0
        for s, n in zip(new, counts.tolist(), strict=True):
            own = flat[at : at + n]
            out[s] = (n, (",".join(map(str, own)) + ",").encode(), b"".join([self.surface[k] for k in own]))
            at += n
        return out

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text: number of ids, SHA-256 of the ids in decimal with commas between, SHA-256 of what decode() makes of them."""
        segments, known = self.segments(texts), self.known
        new = set().union(*segments)
        new = [s for s in new if s not in known]
        found = self._learn(new) if new else {}
        if len(known) < CACHED:
            known.update((s, x) for s, x in found.items() if len(s) <= CACHED_CHARS)
        out = []
        for one in segments:
            parts = [known.get(s) or found[s] for s in one]
            ids = b"".join([p[1] for p in parts])[:-1]
            decoded = self.text_of(b"".join([p[2] for p in parts]))
            out.append((sum([p[0] for p in parts]), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        return out


_models: dict[int, Pieces] = {}


def model(data: bytes) -> Pieces:
    """One per worker and model file; workers are used again for later tasks."""
    key = zlib.crc32(data)
    if key not in _models:
        _models.clear()
        _models[key] = Pieces(data)
    return _models[key]


def _sent(documents: DataFrame, path: str):
    with open(path, "rb") as f:
        return documents.sparkSession.sparkContext.broadcast(f.read())


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array), decoded (text) of every row. A null text counts as empty: no ids, an empty decoded text."""
    data = _sent(documents, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = model(data.value)
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in grouped(texts):
                coded = own.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(coded, pa.list_(pa.int32())), pa.array([own.decode(x) for x in coded], pa.string())], names=["doc_id", "ids", "decoded"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest_documents(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``documents`` (doc_id, text).

    One narrow pass, no shuffle. Null and empty texts have no ids: both digests are of the empty string. Repeated rows
    are repeated; columns other than doc_id and text are ignored; a table without rows gives none.
    """
    data = _sent(documents, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = model(data.value)
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in grouped(texts):
                n, x, y = zip(*own.digests(texts[a:b]), strict=True)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(x), pa.array(y)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ENCODED)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
