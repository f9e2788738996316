"""Near-duplicate documents by SimHash fingerprints and a self-join of binary tries.

Fingerprint: bit k is set if it is set in over half of the hashes of a text's word shingles. Either 64 bits of the XXH64
hashes (seed 42) of the shingles, or several words of 64 bits from mixed sums of the hashes of a shingle's words. All
hashes of a batch are computed together in numpy, on the bytes of the texts.

Join: two words of 64 bits that differ in at most d bits agree in one of over d blocks; more than that, blocks lie on a
ring, and from one of them on every run of l blocks holds at most l d / blocks of the differing bits. So each distinct
word is turned so that each block in turn comes first, and dealt out by that block's value. A task holds the turned words
sorted, which is a binary trie (a node is a range). It walks pairs of nodes down together, adding the bits in which their
prefixes differ, and drops a pair once these exceed what its depth allows. Nodes whose ranges are one component already
are not walked again, so a large group of near copies costs no walk over all its pairs, and a task returns at most one
link per fingerprint. `components` joins the tasks' links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import fresh, keep, parts
from wayfold.llm.components import components
from wayfold.llm.packing import grouped

SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Of `keep_one`: words of 64 bits in a fingerprint, the bits in which two of them may differ, and all of them together:
#: of 256 bits that is a cosine of 0.88, which sets of shingles have at a Jaccard similarity of 0.79.
STAGE_SHINGLE, WORDS, NEAR, TOTAL = 5, 4, 7, 40
#: Shingles hashed at once; pairs of trie nodes walked at once; pairs compared directly below a node pair; turned
#: fingerprints that a task should get.
SLICE, WALK, LEAF, PER_TASK = 400_000, 400_000, 64, 400_000

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_GOLDEN, _MIX1, _MIX2 = (np.uint64(p) for p in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: A-Z in lower case, every separator as a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
#: Each bit of a byte in a byte of its own.
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], dtype=np.uint64)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64(data: bytes, start: np.ndarray, length: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many slices of ``data`` at once."""
    data = data + bytes(8)
    u8 = np.frombuffer(data, dtype=np.uint8)
    u64 = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    u32 = np.ndarray((len(data) - 3,), "<u4", data, 0, (1,))
    mix = lambda acc, k: _turn(acc + k * _P2, 31) * _P1
    s = np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(start), s + _P5, dtype=np.uint64)
        at = start.astype(np.int64)
        if (long := np.flatnonzero(length >= 32)).size:
            acc = [np.full(len(long), v, dtype=np.uint64) for v in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            here, stripes, k = at[long].copy(), length[long] // 32, 0
            on = np.arange(len(long))
            while on.size:
                for j in range(4):
                    acc[j][on] = mix(acc[j][on], u64[here[on] + 8 * j])
                here[on] += 32
                k += 1
                on = on[stripes[on] > k]
            whole = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
            for a in acc:
                whole = (whole ^ mix(np.uint64(0), a)) * _P1 + _P4
            h[long], at[long] = whole, here
        h += length.astype(np.uint64)
        left = start + length - at
        for least in (8, 16, 24):
            on = np.flatnonzero(left >= least)
            g = h[on] ^ mix(np.uint64(0), u64[at[on] + (least - 8)])
            h[on] = _turn(g, 27) * _P1 + _P4
        at, left = at + (left // 8) * 8, left % 8
        on = np.flatnonzero(left >= 4)
        h[on] = _turn(h[on] ^ (u32[at[on]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[on] += 4
        left = left % 4
        for k in range(3):
            on = np.flatnonzero(left > k)
            h[on] = _turn(h[on] ^ (u8[at[on] + k].astype(np.uint64) * _P5), 11) * _P1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def _split(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts with one space between, where each begins, its bytes, and the words of each text."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join([b"", *coded, b""]).translate(_FOLD)
    blank = np.frombuffer(data, dtype=np.uint8) == 32
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    sizes = np.flatnonzero(~blank[:-1] & blank[1:]) + 1 - starts
    ends = np.cumsum([len(c) + 1 for c in coded])
    words = np.diff(np.searchsorted(starts, ends), prepend=0)
    solid = np.frombuffer(data, dtype=np.uint8)[1:][~(blank[1:] & blank[:-1])].tobytes()
    return solid, np.cumsum(sizes + 1) - (sizes + 1), sizes, words


def _shingles(words: np.ndarray, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """In slices: the text, the first and the last word of each shingle (fewer words: the whole sequence)."""
    n = shingle_counts(words, shingle)
    first, begin = np.cumsum(words) - words, np.cumsum(n) - n
    total = int(n.sum())
    for a in range(0, total, SLICE):
        doc = np.searchsorted(begin + n, np.arange(a, min(total, a + SLICE)), side="right")
        word = first[doc] + np.arange(a, a + len(doc)) - begin[doc]
        yield doc, word, word + np.minimum(words[doc], shingle) - 1


def shingle_counts(words: np.ndarray, shingle: int) -> np.ndarray:
    return np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))


def _count_bits(counts: np.ndarray, h: np.ndarray, doc: np.ndarray) -> None:
    """Adds the set bits of a slice's hashes to the counts of their texts."""
    # runs of one document with at most 255 shingles: a byte holds a bit's count
    new = np.flatnonzero(np.diff(doc, prepend=-1))
    place = np.arange(len(doc)) - np.repeat(new, np.diff(new, append=len(doc)))
    cuts = np.flatnonzero(place % 255 == 0)
    firsts = np.flatnonzero(np.diff(doc[cuts], prepend=-1))
    by_byte = h.view(np.uint8).reshape(-1, 8)
    for j in range(8):
        runs = np.add.reduceat(_SPREAD[by_byte[:, j]], cuts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        counts[doc[cuts][firsts], 8 * j : 8 * j + 8] += np.add.reduceat(runs, firsts, axis=0)


def _majority(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    set_bits = (2 * counts > n[:, None]).astype(np.uint64)
    return (set_bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def fingerprints(texts: list[str], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text (uint64); 0 if it has no word."""
    solid, starts, sizes, words = _split(texts)
    counts = np.zeros((len(texts), 64), dtype=np.int64)
    for doc, word, last in _shingles(words, shingle):
        _count_bits(counts, xxh64(solid, starts[word], starts[last] + sizes[last] - starts[word], seed), doc)
    return _majority(counts, shingle_counts(words, shingle))


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th of several hashes made from one."""
    with np.errstate(over="ignore"):
        x = h + np.uint64(k + 1) * _GOLDEN
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


def long_fingerprints(texts: list[str], shingle: int = STAGE_SHINGLE, n_words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Fingerprints of ``n_words`` times 64 bits (texts, n_words). A shingle's hash is the sum of the XXH64 hashes of its
    words, each times a power of an odd number by its place, mixed anew for each 64 bits."""
    solid, starts, sizes, words = _split(texts)
    own = np.concatenate([xxh64(solid, starts[a : a + SLICE], sizes[a : a + SLICE], seed) for a in range(0, len(starts), SLICE)]) if len(starts) else np.empty(0, dtype=np.uint64)
    counts = np.zeros((n_words, len(texts), 64), dtype=np.int64)
    with np.errstate(over="ignore"):
        for doc, word, last in _shingles(words, shingle):
            h, power = np.zeros(len(doc), dtype=np.uint64), np.uint64(1)
            for k in range(shingle):
                inside = word + k <= last
                h += np.where(inside, own[np.minimum(word + k, last)] * power, np.uint64(0))
                power = power * _P1
            for k in range(n_words):
                _count_bits(counts[k], mixed(h, k), doc)
    n = shingle_counts(words, shingle)
    return np.stack([_majority(c, n) for c in counts], axis=1)


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each node's smallest known fellow) after linking i with j."""
    while True:
        a, b = label[i], label[j]
        if not (apart := a != b).any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (closer := label[label]).tobytes() != label.tobytes():
            label = closer


class Trie:
    """Sorted keys; nodes are ranges [lo, hi) of keys with a common prefix. ``allowed``: the differing bits that prefixes
    of each length may have (without it, ``distance``). ``more``: further words of each key, which may differ in
    ``total`` bits together with it."""

    def __init__(self, keys: np.ndarray, prefix: int, distance: int, allowed: list[int] | None = None, more: np.ndarray | None = None, total: int = 0):
        self.keys, self.prefix, self.distance, self.more, self.total = keys, prefix, distance, more, total
        self.allowed = allowed or [distance] * 65
        self.label = np.arange(len(keys))

    def middle(self, depth: int, lo: np.ndarray) -> np.ndarray:
        """Where the keys of a node that begins at ``lo`` turn from 0 to 1 in bit ``depth`` (from the top)."""
        bit = np.uint64(63 - depth)
        return np.searchsorted(self.keys, ((self.keys[lo] >> bit) | np.uint64(1)) << bit, side="left")

    def near(self, i: np.ndarray, j: np.ndarray) -> None:
        off = np.bitwise_count(self.keys[i] ^ self.keys[j])
        ok = np.flatnonzero(off <= self.distance)
        if ok.size and self.more is not None:
            i, j = i[ok], j[ok]
            ok = np.flatnonzero(off[ok] + np.bitwise_count(self.more[i] ^ self.more[j]).sum(axis=1, dtype=np.int64) <= self.total)
        if ok.size:
            self.label = unite(self.label, i[ok], j[ok])

    def leaves(self, alo, ahi, blo, bhi) -> None:
        """Compares all keys below pairs of small nodes."""
        n = (ahi - alo) * (bhi - blo)
        total = np.cumsum(n)
        for a, b in zip(*self._slices(total), strict=True):
            m = n[a:b]
            k = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            wide = np.repeat(bhi[a:b] - blo[a:b], m)
            i, j = np.repeat(alo[a:b], m) + k // wide, np.repeat(blo[a:b], m) + k % wide
            self.near(i[i < j], j[i < j])

    @staticmethod
    def _slices(total: np.ndarray, most: int = 4_000_000) -> tuple[list[int], list[int]]:
        cuts = np.searchsorted(total, np.arange(most, int(total[-1]) if len(total) else 0, most), side="right")
        cuts = np.unique(np.concatenate([[0], cuts, [len(total)]])).tolist()
        return cuts[:-1], cuts[1:]

    def walk(self) -> np.ndarray:
        """Labels after linking all keys that agree in the prefix, differ in no more bits than allowed at any depth and
        are near each other. Other near pairs may be linked, too."""
        if len(self.keys) < 2:
            return self.label
        top = self.keys >> np.uint64(64 - self.prefix)
        for step in (1, 2, 3, 4):  # cheap links first: they spare walks
            i = np.flatnonzero(top[step:] == top[:-step])
            self.near(i, i + step)
        lo = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
        hi = np.append(lo[1:], len(top))
        lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
        stack = [(self.prefix, lo, hi, lo, hi, np.zeros(len(lo), dtype=np.int8))]
        while stack:
            depth, alo, ahi, blo, bhi, off = stack.pop()
            if len(alo) > WALK:
                half = len(alo) // 2
                stack += [(depth, *(x[half:] for x in (alo, ahi, blo, bhi, off))), (depth, *(x[:half] for x in (alo, ahi, blo, bhi, off)))]
                continue
            turns = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])
            one = (turns[alo] == turns[ahi - 1]) & (turns[blo] == turns[bhi - 1]) & (self.label[alo] == self.label[blo])
            small = ((ahi - alo) * (bhi - blo) <= LEAF) | (depth >= 64)
            if (leaf := small & ~one).any():
                self.leaves(alo[leaf], ahi[leaf], blo[leaf], bhi[leaf])
            on = ~small & ~one
            if not on.any():
                continue
            alo, ahi, blo, bhi, off = (x[on] for x in (alo, ahi, blo, bhi, off))
            own = alo == blo
            am, bm = np.minimum(self.middle(depth, alo), ahi), np.minimum(self.middle(depth, blo), bhi)
            children = [
                (alo, am, blo, bm, off),
                (am, ahi, bm, bhi, off),
                (alo, am, bm, bhi, off + np.int8(1)),
                (am[~own], ahi[~own], blo[~own], bm[~own], off[~own] + np.int8(1)),
            ]
            alo, ahi, blo, bhi, off = (np.concatenate(x) for x in zip(*children, strict=True))
            fit = (ahi > alo) & (bhi > blo) & (off <= self.allowed[depth + 1]) & ~((alo == blo) & (ahi - alo == 1))
            if fit.any():
                stack.append((depth + 1, *(x[fit] for x in (alo, ahi, blo, bhi, off))))
        return self.label


def ring(distance: int) -> tuple[int, list[int]]:
    """Blocks of 64 bits for a distance under 64, and the differing bits that a prefix of each length may have in one of
    the turns that begin with a block."""
    blocks = 1 << distance.bit_length()
    width = 64 // blocks
    return blocks, [-(-n // width) * distance // blocks for n in range(65)]


def links(fps: DataFrame, rows: int, distance: int = DISTANCE, words: tuple[str, ...] = ("fp",), total: int = 0) -> DataFrame:
    """Links (u, v: numbers ``node``) that join the rows of ``fps`` (node, and ``words`` of 64 bits, longs, distinct
    together) into the components that all pairs would: those that differ in at most ``distance`` bits of one word and, if
    there are several, in ``total`` bits in all. ``rows``: how many there are; none give no link."""
    blocks, allowed = ring(distance)
    width, m = 64 // blocks, len(words)

    def turned(word: str, slot: int):
        n = width * (slot % blocks)
        key = F.col(word) if not n else F.shiftleft(word, n).bitwiseOR(F.shiftrightunsigned(word, 64 - n))
        rest = [F.col(w).alias(f"m{k}") for k, w in enumerate(w for w in words if w != word)]
        return F.struct(F.lit(slot).cast("short").alias("slot"), key.alias("key"), F.col("node").alias("node"), *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*([x.to_numpy() for x in b.columns] for b in batches), strict=True)]
        slot, key, node, *rest = columns
        for k in np.unique(slot).tolist():
            at = np.flatnonzero(slot == k)
            at = at[np.argsort(key[at].view(np.uint64), kind="stable")]
            more = np.stack([r[at].view(np.uint64) for r in rest], axis=1) if rest else None
            label = Trie(key[at].view(np.uint64), width, distance, allowed, more, total).walk()
            linked = np.flatnonzero(label != np.arange(len(label)))
            ends = node[at[linked]], node[at[label[linked]]]
            for a in range(0, len(linked), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in ends], names=["u", "v"])

    every = F.array(*(turned(w, j * blocks + k) for j, w in enumerate(words) for k in range(blocks)))
    dealt = fps.select(F.explode(every).alias("t")).select("t.*")
    n = max(parts(fps.sparkSession), -(-rows * blocks * m // PER_TASK))
    dealt = dealt.repartition(n, "slot", F.shiftrightunsigned("key", 64 - width))
    return dealt.mapInArrow(_safe(run), "u long, v long")


def _safe(run):
    """Runs on a partition without rows, too."""

    def each(batches):
        batches = [b for b in batches if b.num_rows]
        return run(batches) if batches else iter(())

    return each


def fingerprint_documents(documents: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row; a null text has no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            fps = [fingerprints(texts[a:b], shingle, seed) for a, b in grouped(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(fps).view(np.int64) if fps else [], pa.int64())], names=["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def root_fingerprints(marked: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, first, root) for every fingerprint of ``marked`` (doc_id, fp): its smallest doc_id, and the fingerprint that
    stands for all those reachable over links of at most ``distance`` differing bits. Equal fingerprints are one node,
    aggregated before the shuffle."""
    groups = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(groups.select("fp", F.col("fp").alias("node")), groups.count(), distance))
    return groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def group_fingerprints(marked: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, component_id) for every fingerprint of ``marked`` (doc_id, fp): the smallest doc_id of its component."""
    rooted = root_fingerprints(marked, distance)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return keep(rooted.join(least, "root").select("fp", "component_id"))


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``documents`` (doc_id, text).

    Null, empty and blank texts have the fingerprint zero and are linked like any other; repeated rows are repeated;
    rows that share a doc_id are judged each by its text; columns other than these two are ignored; no rows give none.
    """
    marked = keep(fingerprint_documents(documents, shingle))
    named = group_fingerprints(marked, distance)
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, shingle: int = STAGE_SHINGLE, words: int = WORDS, distance: int = NEAR, total: int = TOTAL) -> DataFrame:
    """The rows of ``documents`` without near copies, their columns as they are.

    Fingerprints of ``words`` times 64 bits over shingles of ``shingle`` words are linked if they differ in at most
    ``distance`` bits of one word and in ``total`` bits in all. Of each component one row stays: one with its smallest
    doc_id, or a row without an id if none has one. Components are told apart by their own numbers, as ids may repeat or
    be null; rows that share an id are judged each by its text. Null, empty and blank texts have the fingerprint zero and
    are copies of each other; repeated rows are copies; no rows give none.

    Only (row, doc_id, fingerprint) is grouped and linked; the texts are dealt once, by row, to meet the rows that stay.
    """
    row, named = fresh(documents, "row", "fingerprint")
    marked = keep(documents.withColumns({named: _fingerprint_udf(shingle, words)(F.col("text")), row: F.monotonically_increasing_id()}))
    w = tuple(f"w{k}" for k in range(words))
    thin = marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("row"), *(F.get(named, F.lit(k)).alias(c) for k, c in enumerate(w)))
    # the smallest id, nulls last; each distinct fingerprint gets a number
    groups = thin.groupBy(*w).agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row")).alias("best"))
    groups = keep(groups.withColumn("node", F.monotonically_increasing_id()))
    roots = components(links(groups.select("node", *w), groups.count(), distance, w, total))
    rooted = groups.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "best")
    stay = keep(rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias(row)))
    # by a shuffle at any size: the rows that stay grow with the documents
    return marked.join(stay.hint("merge"), row, "left_semi").select(*documents.columns)


def _fingerprint_udf(shingle: int, words: int):
    @F.pandas_udf("array<long>")
    def mark(text: pd.Series) -> pd.Series:
        texts = [t or "" for t in text]
        found = [long_fingerprints(texts[a:b], shingle, words).view(np.int64) for a, b in grouped(texts)]
        return pd.Series([x for part in found for x in part], dtype=object)

    return mark


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
