"""Best-fit packing of token sequences by the sum-of-squares rule.

Every document becomes its token ids followed by a separator id; one longer than the capacity is cut into pieces of
the capacity, and the last may be shorter. Pieces go into sequences of at most ``capacity`` ids. A piece goes where
the sum, over the residual gaps, of the squared number of open sequences with that gap becomes smallest, so that no
gap piles up; longer pieces come first.

Scale: ids are made once per document, in Arrow batches; only (doc_id, piece, start, length, crc) goes on. Pieces
are dealt at random into blocks of a bounded number of pieces, each packed in one task. What lies in sequences that
a block leaves visibly open is dealt into new, fewer blocks until one block holds the rest, so the loss from cutting
the work into blocks does not add up. No step needs more memory than one block.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import keep
from wayfold.llm.merges import MergeTable

CAPACITY = 2048
#: Pieces that one task packs at once.
BLOCK = 16_384
#: A sequence of a block is final if it lacks at most this share of the capacity.
CLOSED_GAP = 0.002
#: Rounds in which a block's emptiest sequences are packed again, and the shares of the sequences taken.
ROUNDS, SHARES = 6, (0.02, 0.05, 0.1, 0.3)
#: Token chunks that a worker remembers, and the longest chunk that it does.
CACHED, CACHED_CHARS = 400_000, 48
#: Characters that are split and encoded together.
GROUP_CHARS = 2_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"

#: Control characters that Python's split() takes as white space and the tokenizer does not.
_NOT_BLANK = ("\x1c", "\x1d", "\x1e", "\x1f")


#: Characters of chunks that are merged here: printable ASCII and Latin letters that normal form C leaves alone.
_PLAIN = re.compile("[!-~\u00c0-\u012f\u0131-\u024f]*")
_LETTERS = "a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: The tokenizer's own division into words, for plain chunks in lower case.
_WORDS = re.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")
_WORD_END = "</w>"
_BLANK = re.compile(r"[ \t\n\r]")


def parts_of(text: str, most: int) -> Iterator[str]:
    """Parts of about ``most`` characters, cut before white space."""
    at = 0
    while len(text) - at > 2 * most and (found := _BLANK.search(text, at + most)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


class ChunkEncoder:
    """Ids of whole texts as little-endian uint32 bytes.

    The tokenizer drops white space and no token spans it, so a text's ids are those of its chunks between white
    space, one after the other. Chunks repeat: each is encoded once per group of texts, and short ones once per worker
    as long as there is room. Plain chunks are merged in numpy, all new ones of a group together; any others go to the
    tokenizers library, and so do all if the definition is not the one that the fast way is made for.
    """

    def __init__(self, definition: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition.decode("utf-8"))
        self.known: dict[str, bytes] = {}
        self.table = None
        spec = json.loads(definition)
        if spec["model"].get("type") == "BPE" and spec["model"].get("end_of_word_suffix") == _WORD_END and "'re|'ve|'m|'ll|'d" in json.dumps(spec["pre_tokenizer"]):
            vocab, merges = spec["model"]["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
            rows = [(vocab[a], vocab[b], k, vocab[a + b]) for k, (a, b) in enumerate(merges)]
            self.table = MergeTable(*(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)))
            # byte-level alphabets write printable bytes as themselves and the others as characters from 256 on, in order
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(shown))}
            self.inner = np.array([vocab[letter[b]] for b in range(256)], dtype=np.int32)
            self.last = np.array([vocab[letter[b] + _WORD_END] for b in range(256)], dtype=np.int32)

    def _merged(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of plain chunks."""
        words = _WORDS.findall("\n".join(chunks).lower())
        new = list(set(words) - {"\n"})
        coded = [w.encode() for w in new]
        lengths = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        flat = np.frombuffer(b"".join(coded), dtype=np.uint8)
        symbols, ends = self.inner[flat], np.cumsum(lengths) - 1
        symbols[ends] = self.last[flat[ends]]
        ids, counts = self.table.merge(symbols, lengths)
        data, stops = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        of = {w: data[a:b] for w, a, b in zip(new, [0, *stops], stops, strict=False)}
        out, at, own = {}, 0, []
        for w in words:
            if w == "\n":
                out[chunks[at]] = own[0] if len(own) == 1 else b"".join(own)
                at, own = at + 1, []
            else:
                own.append(of[w])
        out[chunks[at]] = b"".join(own)
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. A very long one is encoded in parts that end before white space."""
        if any(len(t) > 2 * GROUP_CHARS for t in texts):
            return [b"".join([self._ids([part])[0] for part in parts_of(t, GROUP_CHARS)]) for t in texts]
        return self._ids(texts)

    def _ids(self, texts: list[str]) -> list[bytes]:
        chunks = [[t] if any(c in t for c in _NOT_BLANK) else t.split() for t in texts]
        known, new = self.known, set()
        for one in chunks:
            new.update(one)
        new = [c for c in new if c not in known]
        plain = [c for c in new if _PLAIN.fullmatch(c) and "<|" not in c] if self.table else []
        found = self._merged(plain) if plain else {}
        other = [c for c in new if c not in found]
        encoded = self.tokenizer.encode_batch_fast(other, add_special_tokens=False)
        found.update((c, np.asarray(e.ids, dtype="<u4").tobytes()) for c, e in zip(other, encoded, strict=True))
        if len(known) < CACHED:
            known.update((c, b) for c, b in found.items() if len(c) <= CACHED_CHARS)
        return [b"".join([known.get(c) or found.get(c, b"") for c in one]) for one in chunks]


_encoders: dict[int, ChunkEncoder] = {}


def encoder(definition: bytes) -> ChunkEncoder:
    """One per worker and tokenizer; workers are used again for later tasks."""
    key = zlib.crc32(definition)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = ChunkEncoder(definition)
    return _encoders[key]


def cut(doc_id: int | None, ids: bytes, capacity: int) -> Iterator[tuple]:
    """(doc_id, piece, start, length, crc32 of the ids) of a document's pieces."""
    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
        part = ids[at : at + 4 * capacity]
        yield doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)


def grouped(texts: list[str], most: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` characters each (one row at least)."""
    begin = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = 0) -> DataFrame:
    """One row per piece of every row of ``documents`` (doc_id, text). A null text counts as empty and gives one
    piece, the separator. ``tokenizer``: the path of a tokenizers JSON file; its bytes are sent to the executors
    (its size does not grow with the data)."""
    with open(tokenizer, "rb") as f:
        definition = documents.sparkSession.sparkContext.broadcast(f.read())
    end = np.asarray([separator], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in grouped(texts):
                rows = [p for i, x in zip(ids[a:b], encoder(definition.value).ids(texts[a:b]), strict=True) for p in cut(i, x + end, capacity)]
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each piece, for pieces in the order given.

    With N[g] open sequences of gap g, putting a piece of length s into gap g changes the sum of N squared by
    2 (N[g-s] - N[g] + 1), by 1 - 2 N[s] if it fills the gap, and by 2 N[capacity-s] + 1 if it opens a sequence.
    The smallest change wins; ties go to the smaller gap, and an open sequence before a new one.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    used, top = 0, capacity + 1
    for k, s in enumerate(lengths.tolist()):
        best, gap = 2 * count[capacity - s] + 1 if s < capacity else 0, capacity
        if s < capacity:
            have = count[s:capacity]
            change = 2 * (count[: capacity - s] - have + 1)
            change[0] = 1 - 2 * have[0]
            change[have == 0] = top * len(lengths)
            at = int(change.argmin())
            if have[at] and change[at] <= best:
                gap = s + at
        if gap == capacity:
            seq, used = used, used + 1
        else:
            seq = open_by_gap[gap].pop()
            count[gap] -= 1
        where[k], offset[k] = seq, capacity - gap
        if gap > s:
            open_by_gap[gap - s].append(seq)
            count[gap - s] += 1
    return where, offset


def packed_block(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The sequence of each piece of a block, for pieces in falling order of length.

    The rule is an online one: early choices leave gaps that later pieces would have filled. So the pieces of the
    emptiest sequences are taken out and placed again by the same rule, from small to larger shares of the sequences,
    as long as rounds of this save any.
    """
    seq, _ = sum_of_squares(lengths, capacity)
    used = int(seq.max(initial=-1)) + 1
    least = -(-int(lengths.sum()) // capacity)
    for _ in range(ROUNDS):
        before = used
        for share in SHARES:
            fill = np.bincount(seq, weights=lengths, minlength=used)
            open_ones = np.argsort(fill, kind="stable")[: max(8, int(used * share))]
            at = np.flatnonzero(np.isin(seq, open_ones))
            again, _ = sum_of_squares(lengths[at], capacity)
            if used > least and again.max(initial=-1) < len(open_ones):
                names = np.sort(open_ones)
                seq[at] = names[again]
                # names that are free now go to the last sequences
                seq = np.unique(seq, return_inverse=True)[1]
                used = int(seq.max()) + 1
        if used == before or used == least:
            break
    return seq


def offsets(seq: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places within the sequences, in the order of the pieces."""
    order = np.argsort(seq, kind="stable")
    ends = np.cumsum(lengths[order])
    first = np.flatnonzero(np.diff(seq[order], prepend=-1))
    base = np.repeat((ends - lengths[order])[first], np.diff(first, append=len(order)))
    out = np.empty(len(seq), dtype=np.int64)
    out[order] = ends - lengths[order] - base
    return out


def _packer(capacity: int, level: int, last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        lengths = rows["length"].to_numpy()
        seq = packed_block(lengths, capacity)
        offset = offsets(seq, lengths)
        fill = np.bincount(seq, weights=lengths, minlength=1)
        done = fill[seq] >= capacity * (1 - CLOSED_GAP) if not last else np.ones(len(seq), dtype=bool)
        return rows.drop(columns=["block"]).assign(sequence_id=(level << 56) + (int(key[0]) << 24) + seq, offset=offset, final=done)

    return run


def pack(rows: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` from 1 to ``capacity``. No key deals the rows out, so
    that repeated ids or lengths cannot make a block hot; null ids and repeated rows are packed like any other, ties fall
    either way, and no rows give none."""
    done, rest, level, before = [], keep(rows), 0, None
    while True:
        n = rest.count()
        # pieces that fill no sequence in any company (all just over half the capacity, say) are not dealt on and on
        blocks, last = max(1, -(-n // block)), n <= block or (before is not None and 2 * n > before)
        before = n
        dealt = rest.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(level)), F.lit(blocks)))
        out = dealt.groupBy("block").applyInPandas(_packer(capacity, level, last), PACKED + ", final boolean")
        if last:
            done.append(out.drop("final"))
            break
        out = keep(out)
        done.append(out.where("final").drop("final"))
        rest, level = out.where("not final").drop("final", "sequence_id", "offset"), level + 1
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = 0) -> DataFrame:
    """Packs all rows of ``documents``: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one separator; a repeated row is packed again; a table without rows gives none; columns
    other than doc_id and text are ignored. Ties between equal pieces may fall either way.
    """
    return pack(pieces(documents, tokenizer, capacity, separator), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
