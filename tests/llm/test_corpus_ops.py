"""The corpus operators against plain versions of themselves, on small tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayfold.llm import language, licences, merges, packing, pieces, quality, queries, rules, sharding, simhash, topk, urls
from wayfold.llm.common import SEPARATORS, bounded_sample, held_out

WORD_BPE, PIECE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, piece string, fp string, m string, rank string, h string, row string, kept string"
WORDS = "the of and to in is for it on that with as be was are this by from shore licence river stone cloud Ärger école niño straße".split()


def document(rnd, n):
    return "".join(rnd.choice(WORDS) + rnd.choice([" ", " ", " ", ", ", ". ", ".\n", "\t"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls in every column, empty and long texts, exact and near copies, ties, repeated rows."""
    rnd = random.Random(5)
    base = document(rnd, 300)
    texts = [None, "", "   \n\t ", "12345 !!", "word", "two words", base, base, base + "extra", base.replace("river", "rover", 1), document(rnd, 6000), "x" * 30_000, "same line here now\n" * 40, "tok*** " * 60, "a\x00b \x1c c", "漢字 かな 🙂 text", "İstanbul ΣΑΣ ς", "<|endoftext|> it's don't <s> <0x0A>"]
    texts += ["Some text first.\nReleased under the MIT License.\nThen more of it."] + [document(rnd, rnd.randint(5, 400)) for _ in range(60)]
    out = [(k, t, [None, "en", "de", "en"][k % 4], [None, "a", "b", "a", "a"][k % 5], None if k % 7 == 0 else 1, *["x"] * 7) for k, t in enumerate(texts)]
    return [*out, out[6], out[6], out[1], (None, "no id at all but some words to read here anyway", "en", "a", 1, *["x"] * 7)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def view(rows, name="documents"):
    c = duckdb.connect()
    frame = pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    c.register("frame", frame)
    c.sql(f"CREATE TABLE {name} AS SELECT * FROM frame")
    return c


def word_lists(text):
    return [w for w in re.split(SEPARATORS, text or "") if w]


# -- packing ------------------------------------------------------------------------------------------------------


def test_chunks_encode_as_whole_texts(rows):
    tok = Tokenizer.from_file(WORD_BPE)
    with open(WORD_BPE, "rb") as f:
        encoder = packing.ChunkEncoder(f.read())
    rnd = random.Random(2)
    letters = "ab the in er'stdrevm  \n\t▁éßñ漢字😀́\x00\x1cABC019.,,''<|startoftext|>İÀ×÷ǅσΣς\x85\u2003"
    texts = [r[1] or "" for r in rows] + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(500)]
    for text, got in zip(texts, encoder.ids(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_long_texts_are_encoded_in_parts(rows, monkeypatch):
    with open(WORD_BPE, "rb") as f:
        encoder = packing.ChunkEncoder(f.read())
    texts = [r[1] or "" for r in rows]
    whole = encoder.ids(texts)
    monkeypatch.setattr(packing, "GROUP_CHARS", 50)
    assert encoder.ids(texts) == whole
    assert all("".join(packing.parts_of(t, 7)) == t for t in texts)


def test_sum_of_squares_takes_the_smallest_change():
    rnd, capacity = np.random.default_rng(0), 12
    lengths = rnd.integers(1, capacity + 1, 300)
    where, offset = packing.sum_of_squares(lengths, capacity)
    gaps: dict[int, int] = {}
    for s, b, o in zip(lengths.tolist(), where.tolist(), offset.tolist(), strict=True):
        count = Counter(g for g in gaps.values() if g)
        squares = {}
        for g in {*count, capacity}:
            if g >= s:
                after = Counter(count)
                if g in count and not (g == capacity):
                    after[g] -= 1
                if g > s:
                    after[g - s] += 1
                squares[g] = sum(n * n for n in after.values())
        took = gaps.get(b, capacity)
        assert squares[took] == min(squares.values()) and o == capacity - took
        gaps[b] = took - s


def check_packing(got, wanted):
    by_seq: dict = {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= packing.CAPACITY
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == wanted
    return by_seq


def expected_pieces(pairs):
    tok, out = Tokenizer.from_file(WORD_BPE), Counter()
    for doc_id, text in pairs:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            out[(doc_id, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()))] += 1
    return out


def test_packing(spark, docs, rows, none):
    got = packing.pack_documents(docs, WORD_BPE).collect()
    by_seq = check_packing(got, expected_pieces((r[0], r[1]) for r in rows))
    assert len(by_seq) <= math.ceil(sum(r["length"] for r in got) / 2048) + 1
    assert packing.pack_documents(none, WORD_BPE).count() == 0


def test_packing_in_several_blocks(spark):
    rnd = np.random.default_rng(3)
    lengths = rnd.integers(1, 700, 900)
    df = spark.createDataFrame([(7, k, 0, int(n), 0) for k, n in enumerate(lengths)], packing.PIECES)
    got = packing.pack(df, block=200).collect()
    by_seq = check_packing(got, Counter((7, k, 0, int(n), 0) for k, n in enumerate(lengths)))
    assert len(by_seq) <= math.ceil(lengths.sum() / 2048) + 3


def test_packing_ends_where_nothing_fills_a_sequence(spark):
    df = spark.createDataFrame([(k, 0, 0, 1500, k) for k in range(500)], packing.PIECES)
    got = packing.pack(df, block=100).collect()
    assert len({r["sequence_id"] for r in got}) == len(got) == 500


def test_blocks_come_near_the_lower_bound():
    lengths = np.sort(np.minimum(2047, np.random.default_rng(0).lognormal(6, 1, 5000).astype(int) + 1))[::-1]
    seq = packing.packed_block(lengths, 2048)
    fill, at = np.bincount(seq, weights=lengths), packing.offsets(seq, lengths)
    assert fill.max() <= 2048 and fill.min() > 0
    assert len(fill) <= math.ceil(lengths.sum() / 2048) + 3
    for s in range(0, len(fill), 50):
        own = np.flatnonzero(seq == s)
        assert sorted(at[own].tolist()) == (np.cumsum(lengths[own][np.argsort(at[own])]) - lengths[own][np.argsort(at[own])]).tolist()


# -- SentencePiece ------------------------------------------------------------------------------------------------


def test_pieces_equal_the_library(rows):
    ref = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    with open(PIECE_BPE, "rb") as f:
        own = pieces.Pieces(f.read())
    rnd = random.Random(1)
    letters = "ab the in er  \n\t▁éßñ漢字😀́\x00\x1cABC019.,,''<s><0x0A>  aaaa"
    texts = [r[1] or "" for r in rows] + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    for text, got in zip(texts, own.encode(texts), strict=True):
        assert got == ref.encode(text)
        assert own.decode(got) == ref.decode(got)


def test_piece_digests(docs, rows, none):
    ref = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    want = Counter()
    for r in rows:
        ids = ref.encode(r[1] or "")
        want[(r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(ref.decode(ids).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in pieces.digest_documents(docs, PIECE_BPE).collect()) == want
    assert pieces.digest_documents(none, PIECE_BPE).count() == 0
    full = pieces.encode_documents(docs.where("doc_id = 6"), PIECE_BPE).first()
    assert full["ids"] == ref.encode(rows[6][1]) and full["decoded"] == ref.decode(full["ids"])


def test_merging_in_rounds_equals_one_by_one():
    rnd = np.random.default_rng(4)
    left, right = (rnd.integers(0, 9, 30) for _ in range(2))
    keep = np.unique(left * 100 + right, return_index=True)[1]
    left, right = left[keep], right[keep]
    rank, result = rnd.permutation(len(left)), rnd.integers(0, 9, len(left))
    table, known = merges.MergeTable(left, right, rank, result), {(a, b): (k, c) for a, b, k, c in zip(left.tolist(), right.tolist(), rank.tolist(), result.tolist(), strict=True)}
    words = [rnd.integers(0, 9, rnd.integers(0, 40)) for _ in range(200)]
    sym, n = table.merge(np.concatenate(words), np.array([len(w) for w in words]))
    at = 0
    for w, m in zip(words, n.tolist(), strict=True):
        own = w.tolist()
        while best := min(((known[p][0], k) for k, p in enumerate(zip(own, own[1:], strict=False)) if p in known), default=None):
            own[best[1] : best[1] + 2] = [known[(own[best[1]], own[best[1] + 1])][1]]
        assert sym[at : at + m].tolist() == own
        at += m


# -- SimHash ------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = word_lists(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for k in range(64):
            counts[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * counts[k] > len(shingles))


def plain_long_fingerprint(text):
    """Four words of 64 bits, from Python's integers."""
    full, odd = (1 << 64) - 1, 0x9E3779B185EBCA87
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    own = [xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), seed=42) for w in word_lists(text)]
    runs = [own[i : i + 5] for i in range(len(own) - 4)] if len(own) >= 5 else [own] if own else []
    out = []
    for word in range(4):
        counts = [0] * 64
        for run in runs:
            x = (sum(h * pow(odd, k, 1 << 64) for k, h in enumerate(run)) + (word + 1) * 0x9E3779B97F4A7C15) & full
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
            x ^= x >> 31
            for k in range(64):
                counts[k] += x >> k & 1
        out.append(sum(1 << k for k in range(64) if 2 * counts[k] > len(runs)))
    return tuple(out)


def near_long(a, b):
    off = [(x ^ y).bit_count() for x, y in zip(a, b, strict=True)]
    return min(off) <= 7 and sum(off) <= 40


def near(a, b):
    return (a ^ b).bit_count() <= 3


def groups(fps, near=near):
    """Distinct fingerprints by union-find over all pairs."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if near(a, b):
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_near_duplicates(docs, rows, none):
    fps = [plain_fingerprint(r[1]) for r in rows]
    root, first = groups(fps), {}
    for r, f in zip(rows, fps, strict=True):
        if r[0] is not None:
            first[root[f]] = min(first.get(root[f], r[0]), r[0])
    want = Counter((r[0], f"{f:016x}", first.get(root[f])) for r, f in zip(rows, fps, strict=True))
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(none).count() == 0


def test_one_of_each_group_stays(docs, rows, none):
    fps = [plain_long_fingerprint(r[1]) for r in rows]
    root, first = groups(fps, near_long), {}
    for r, f in zip(rows, fps, strict=True):
        if r[0] is not None:
            first[root[f]] = min(first.get(root[f], r[0]), r[0])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and len(first) < len({r[0] for r in rows}) - 4
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(first.values())
    assert simhash.keep_one(none).count() == 0


def test_near_copies_go_and_others_stay(spark):
    rnd = random.Random(8)
    base = [[rnd.choice(WORDS) + str(rnd.randrange(400)) for _ in range(200)] for _ in range(60)]
    near_copies = []
    for words in base:
        words = list(words)
        for at in rnd.sample(range(10, 190, 45), 2):
            words[at] = "changed"  # two of 196 shingles of five words change per side for each: similarity 0.9
        near_copies.append(words)
    texts = [" ".join(w) for w in base + near_copies]
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert set(range(60)) <= kept and len(kept) <= 63


def test_rings_lose_no_pair():
    rnd = random.Random(3)
    for distance in (1, 3, 7, 10):
        blocks, allowed = simhash.ring(distance)
        for _ in range(300):
            x = sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, distance)))
            turns = [f"{((x << n) | (x >> (64 - n))) & (2**64 - 1):064b}" for n in range(0, 64, 64 // blocks)]
            assert any(all(t[:n].count("1") <= allowed[n] for n in range(65)) for t in turns)


def test_components_stay_apart_without_ids_and_with_repeated_ids(spark):
    rnd = random.Random(4)
    a, b, c, d = (" ".join(rnd.choice(WORDS) + str(rnd.randrange(999)) for _ in range(80)) for _ in range(4))
    data = [(None, c), (None, c), (None, d), (5, a), (5, b), (7, b), (None, b)]
    kept = simhash.keep_one(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [(None, c), (None, d), (5, a), (5, b)]))


def test_hash_of_slices():
    data = bytes(random.Random(1).randrange(256) for _ in range(3000))
    start, length = np.array([0, 5, 9, 100, 3, 0, 7, 7, 11]), np.array([0, 1, 3, 4, 8, 31, 32, 100, 2500])
    got = simhash.xxh64(data, start, length)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a : a + n], seed=42) for a, n in zip(start, length, strict=True)]


@pytest.mark.parametrize("prefix", [1, 16])
@pytest.mark.parametrize("spread", [8, 16, 64])
def test_trie_joins_what_all_pairs_would(prefix, spread):
    rng = np.random.default_rng(spread)
    keys = rng.integers(0, 2**63, size=12, dtype=np.uint64)[rng.integers(0, 12, 1200)]
    for _ in range(4):
        bit = rng.integers(0, spread, len(keys)).astype(np.uint64) * np.uint64(64 // spread)
        keys = np.where(rng.random(len(keys)) < 0.6, keys ^ (np.uint64(1) << bit), keys)
    keys = np.unique(keys)
    i, j = np.triu_indices(len(keys), 1)
    near = (np.bitwise_count(keys[i] ^ keys[j]) <= 3) & (keys[i] >> np.uint64(64 - prefix) == keys[j] >> np.uint64(64 - prefix))
    assert (simhash.Trie(keys, prefix, 3).walk() == simhash.unite(np.arange(len(keys)), i[near], j[near])).all()


def test_links_span_blocks(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**62, size=40)
    fps = {int(b) for b in base} | {int(b) ^ int(sum(1 << int(k) for k in rng.choice(62, 3, replace=False))) for b in base for _ in range(5)}
    df = spark.createDataFrame([(k, f) for k, f in enumerate(sorted(fps))], "doc_id long, fp long")
    root = groups(fps)
    first = {}
    for k, f in enumerate(sorted(fps)):
        first.setdefault(root[f], k)
    assert {(r["fp"], r["component_id"]) for r in simhash.group_fingerprints(df).collect()} == {(f, first[root[f]]) for f in fps}


# -- quality rules, licences --------------------------------------------------------------------------------------


def test_quality_rules_equal_sql(docs, rows, none):
    from conftest import same_rows

    same_rows(rules.quality_rules(docs), view(rows).sql(rules.oracle()))
    assert rules.quality_rules(none).count() == 0
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in rules.quality_rules(docs).where("kept").collect())


def test_base_counts(docs, rows):
    def plain(text):
        w, text = word_lists(text), text or ""
        lines = [x for x in text.split("\n") if word_lists(x)]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        twice = {g for g, n in Counter(grams).items() if n > 1}
        covered = {i + k for i, g in enumerate(grams) if g in twice for k in range(5)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)

    want = Counter((r[0], *plain(r[1])) for r in rows)
    assert Counter(tuple(r) for r in rules.quality_rules(docs).select("doc_id", *rules.BASE).collect()) == want


def test_small_groups_may_have_thresholds_of_their_own(spark):
    prose = lambda k, star: " ".join(WORDS[(k + j) % len(WORDS)] + ("*" if star else "") for j in range(24))
    data = [(k, prose(k, False), "en", "plain") for k in range(200)] + [(1000 + k, prose(k, True), "en", "starred") for k in range(5)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    kept = lambda n: rules.quality_rules(df, min_group=n).where("doc_id >= 1000 and kept").count()
    assert (kept(1), kept(rules.MIN_GROUP)) == (5, 0)


def test_thresholds_adapt_to_a_group(spark):
    rnd = random.Random(9)
    prose = lambda star: " ".join(rnd.choice(WORDS) + ("*" if rnd.random() < star else "") for _ in range(60))
    data = [(k, prose(0.02), "en", "plain") for k in range(150)] + [(1000 + k, prose(0.5), "en", "starred") for k in range(150)] + [(5000, prose(0.5), "en", "plain"), (5001, prose(1), "en", "rare")]
    got = {r["doc_id"]: r["kept"] for r in rules.quality_rules(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[k] for k in range(150)) and all(got[1000 + k] for k in range(150)) and not got[5000]


def test_licences_equal_sql(docs, rows, none):
    from conftest import same_rows

    got = licences.scan_licences(docs)
    same_rows(got, view(rows).sql(licences.oracle()))
    assert got.where("template = 'MIT/statement' and unit = 'line' and place = 1 and dice = 1").count() == 1
    assert licences.scan_licences(none).count() == 0


def test_a_notice_over_several_lines_is_found(spark):
    notice = licences.TEMPLATES["MIT/grant"]
    text = "Some heading\n\n" + "\n".join(re.findall(r".{1,60}(?: |$)", notice)) + "\n\nThe end."
    row = licences.scan_licences(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["template"], row["unit"], row["dice"]) == ("MIT/grant", "paragraph", 1.0)


def test_notices_within_running_text_are_found(spark):
    prose = " ".join(WORDS[k % len(WORDS)] for k in range(150))
    grant, mit, bsd = (licences.TEMPLATES[k] for k in ("MIT/statement", "MIT/licence", "BSD-3-Clause/licence"))
    broken = bsd.split()
    texts = [f"{prose} Copyright X. {grant} All rights reserved. {prose}", f"{prose}\n" + "\n".join(re.findall(r".{1,70}(?: |$)", mit)) + f"\n{prose}", prose + " " + " ".join([*broken[:100], "inserted", "words", *broken[100:]]) + " " + prose, prose]
    rows = licences.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["template"], r["unit"]) for r in rows] == [("MIT/statement", "window"), ("MIT/licence", "window"), ("BSD-3-Clause/licence", "window"), (None, None)]
    assert rows[0]["dice"] == rows[1]["dice"] == 1 and rows[0]["place"] == 152 and rows[2]["dice"] > 0.95


def test_markers_lose_no_match():
    marks = set(licences.markers(licences.TEMPLATES, 0.8))
    for text in licences.TEMPLATES.values():
        own = licences.template_bigrams(text)
        assert sum(not set(b.split()) & marks for b in own) < licences.least_common(len(own), 0.8)
    for n in range(1, 50):
        assert licences.least_common(n, 0.8) == min(c for m in range(1, 120) for c in range(min(n, m) + 1) if 2000 * c >= 800 * (n + m))
    assert not marks & licences.COMMON


def test_size_bounds_lose_nothing():
    for n in range(1, 60):
        low, high = licences.bounds(n, 0.8)
        for m in range(1, 120):
            assert (2000 * min(n, m) >= 800 * (n + m)) <= (low <= m <= high)


# -- search, URLs, shards -----------------------------------------------------------------------------------------


def plain_top_k(vectors, queries, k=10):
    """Every pair scored with Python's integers; (query, rank, id, score)."""
    out = []
    for q, v in queries:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i is None, i or 0) for i, w in vectors if i != q)
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(scored[:k])]
    return out


def test_exact_top_k(spark):
    from conftest import same_rows

    rng = np.random.default_rng(2)
    data = [(k, rng.normal(0, 0.1, 6).round(2).tolist(), "extra") for k in range(350)] + [(400, None, ""), (500, [0.1, None], ""), (600, [float("nan")] * 6, ""), (700, [float("inf")] * 6, ""), (800, [0.0] * 6, ""), (None, [0.3] * 6, "")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, score string")
    v = topk.usable(df)
    got = topk.top_k(v, v.where("vec_id % 100 = 0"))
    c = duckdb.connect()
    frame = pd.DataFrame([(k, e) for k, e, _ in data], columns=["vec_id", "embedding"])
    frame["vec_id"] = frame["vec_id"].astype("Int64")
    c.register("frame", frame)
    c.sql("CREATE TABLE embeddings AS SELECT vec_id, embedding::FLOAT[] AS embedding FROM frame")
    same_rows(got, c.sql(topk.oracle()))
    few = v.where("vec_id < 4")
    assert topk.top_k(few, few).groupBy("query_id").count().where("count <> 3").count() == 0
    assert topk.top_k(v.limit(0), v.limit(0)).count() == topk.top_k(v, v.limit(0)).count() == topk.top_k(v.limit(0), few).count() == 0


def test_top_k_over_several_blocks_of_both_sides(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = [(k if k % 50 else None, rng.integers(-3, 4, rng.integers(4, 6)).astype(float).tolist()) for k in range(900)] + [(7, [1.0, 1.0]), (8, [])]
    monkeypatch.setattr(topk, "BLOCK", 100)
    v = spark.createDataFrame(data, "vec_id long, v array<double>").repartition(3)
    asked = [(i, w) for i, w in data if i is not None and i % 7 == 3]
    got = topk.top_k(v, spark.createDataFrame(asked, v.schema), scale=1, query_bytes=1600)
    assert sorted(map(tuple, got.collect())) == sorted(plain_top_k(data, asked))


def test_top_k_of_huge_components_is_exact(spark):
    data = [(0, [1e20, 1.0]), (1, [1.0, 2.0]), (2, [1e30, 0.0]), (3, [-1e30, 0.0]), (4, [-2e30, 5.0]), (5, [1e300, 1e300])]
    v = spark.createDataFrame(data, "vec_id long, v array<double>").repartition(3)
    got = sorted(topk.top_k(v, v.where("vec_id = 0")).collect(), key=lambda r: r["rank"])
    assert [r["vec_id"] for r in got] == [5, 2, 1, 3, 4]
    assert [r["score"] for r in got] == [topk.LONG] * 3 + [-topk.LONG] * 2


def test_threshold_algorithm_stops_early():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 1000, (4000, 2)).astype(float)
    q = np.array([[3.0, 1.0], [-1.0, 2.0]])
    search = topk.Search(np.array([-1, -2]), q, 5)
    search.meet(np.arange(4000), np.zeros(4000, dtype=bool), rows)
    assert 0 < search.scored < 1000
    for k, name in enumerate((-1, -2)):
        at = int(np.flatnonzero(search.ids == name)[0])
        order = np.lexsort((np.arange(4000), -(rows @ q[k])))[:5]
        assert search.best[at].tolist() == order.tolist() and search.score[at].tolist() == (rows[order] @ q[k]).tolist()


PAGES = [
    (0, "http://a.org/x?y#z"), (1, "https://EXAMPLE.org/es/1"), (2, "http://b.example.org/en/12"), (3, "x://notexample.org/es/"), (4, "http://a.com/fr/1"), (5, "http://a.com/de/"),
    (6, "http://www.spam-farm.example.net/p"), (7, "http://spam-farm.example.org/p"), (8, None), (9, "no scheme"), (10, ""), (11, "http://"), (12, "http://a.org"), (13, "http://xspam-farm.example.com/"),
    (14, "a://b://c.com/fr/"), (15, "http://a.net?x=/fr/"), (16, "http://a..b.net/"), (17, "http://ÄÖ.com/fr/ü"), (None, "http://free-bets.example.com/de"), (6, "http://www.spam-farm.example.net/p"),
]


def test_urls_equal_sql(spark):
    from conftest import same_rows

    df = spark.createDataFrame([(*p, "x", "x") for p in PAGES], "page_id long, url string, html string, verdict string")
    c = duckdb.connect()
    frame = pd.DataFrame(PAGES, columns=["page_id", "url"])
    frame["page_id"] = frame["page_id"].astype("Int64")
    c.register("frame", frame)
    c.sql("CREATE TABLE pages AS SELECT * FROM frame")
    got = urls.judge_urls(df)
    same_rows(got, c.sql(urls.oracle()))
    assert urls.judge_urls(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "http://" + "a." * 50_000 + "spam-farm.example.net/"), (2, "http://" + "." * 100_000)], "page_id long, url string")
    assert [r["verdict"] for r in urls.judge_urls(long).orderBy("page_id").collect()] == ["block", "allow"]


@pytest.mark.parametrize("max_bytes", [64 << 20, 60])
def test_long_lists_in_parts(spark, max_bytes):
    """Every host asked for is judged rightly, whether all filters fit or not."""
    listed = spark.createDataFrame([(f"bad{k}.net",) for k in range(0, 900, 3)] + [("c.bad1.net",), (None,)], "domain string")
    hosts = [f"{p}bad{k}.net" for k in range(900) for p in ("", "a.b.")] + ["c.bad1.net", "x.c.bad1.net", "bad1.net.org"]
    pages = spark.createDataFrame([(k, f"x://{h}/") for k, h in enumerate(hosts)], "page_id long, url string")
    want = [h.endswith("c.bad1.net") or (h.endswith(".net") and int(h.rpartition("bad")[2][:-4]) % 3 == 0) for h in hosts]
    got = {r["page_id"]: r["verdict"] == "block" for r in urls.judge_urls(pages, rules=(), listed=listed, max_bytes=max_bytes).collect()}
    assert [got[k] for k in range(len(hosts))] == want
    assert 180 < urls.expected_bytes(301, 900) < 600 and urls.expected_bytes(0, 5) < 100


def test_cascade_is_exact_over_its_universe(spark):
    listed = {f"bad{k}.net" for k in range(0, 3000, 3)}
    keys = [f"bad{k}.net" for k in range(3000)]
    df = spark.createDataFrame([(k, k in listed) for k in keys], "key string, listed boolean")
    cascade = urls.build_cascade(df)
    assert len(cascade.levels) > 1
    assert cascade.listed(*urls._packed(keys)).tolist() == [k in listed for k in keys]
    assert urls.build_cascade(df.where("not listed")).levels == []


def test_hilbert_neighbours_touch():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        n = 1 << bits
        points = np.stack([g.reshape(-1) for g in np.meshgrid(*[np.arange(n)] * d, indexing="ij")])
        at = sharding.hilbert_index(points, bits)
        assert sorted(at.tolist()) == list(range(n**d))
        walk = points[:, np.argsort(at)]
        assert (np.abs(np.diff(walk, axis=1)).sum(axis=0) == 1).all()


def test_shards(spark, docs, rows, none):
    got = sharding.shard_documents(docs).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots: dict = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert (r["law"], r["grown_shard"]) == ("rows", None)
    assert set(slots) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.shard_documents(none).count() == 0


def plain_hilbert(point, bits):
    """Place along the curve, by halving the cube bit by bit with the turns of the corner met (Hamilton's way), for the
    orientation in which the first axis comes first."""
    n = len(point)
    x, m = list(point), 1 << (bits - 1)
    q = m
    while q > 1:  # undo the excess turns
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0], x[i] = x[0] ^ t, x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, m
    while q > 1:
        t ^= q - 1 if x[-1] & q else 0
        q >>= 1
    x = [v ^ t for v in x]
    return int("".join(str(v >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def test_shards_equal_a_plain_order(spark):
    """Codes, order and cuts of one table, in plain Python."""
    rnd = random.Random(6)
    data = [(k, "w " * rnd.randrange(60), rnd.choice(["de", "en", "es", None]), f"common-source-{rnd.randrange(30)}") for k in range(700)]
    data += [(k % 50, data[k % 7][1], data[k % 7][2], data[k % 7][3]) for k in range(100)]
    got = sharding.shard_documents(spark.createDataFrame(data, "doc_id long, text string, lang string, source string"))
    rows = [(i, len(t) + 16, zlib.crc32(t.encode()), lang, source) for i, t, lang, source in data]

    def number(text, skip):
        return None if text is None else int.from_bytes(text.encode()[skip : skip + 6].ljust(6, b"\0"), "big")

    dims = [[number(r[3], 0) for r in rows], [number(r[4], len("common-source-")) for r in rows], [r[1] for r in rows]]
    codes = []
    for values in dims:
        some = sorted(v for v in values if v is not None)
        edges = sorted({some[math.ceil(k / 62 * len(some)) - 1] for k in range(1, 62)})
        codes.append([0 if v is None else 1 + sum(e <= v for e in edges) for v in values])
    none_first = lambda v: (v is not None, v or "")
    order = sorted(range(len(rows)), key=lambda k: (plain_hilbert([c[k] for c in codes], 6), none_first(rows[k][3]), none_first(rows[k][4]), rows[k][1], rows[k][2], rows[k][0]))
    want, n = [], len(rows)
    for place, k in enumerate(order):
        shard = place * 40 // n
        want.append((*rows[k][:3], shard, place - -(-shard * n // 40)))
    assert sorted(tuple(r) for r in got.select("doc_id", "size", "text_crc32", "shard", "slot").collect()) == sorted(want)


def test_shards_prune(spark, tmp_path):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(0, 1, (4000, 2)))], "id long, x double, y double")
    out = sharding.hilbert_shards(df, ["x", "y"], ["id"], 16)
    sharding.write_shards(out, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    stats = sharding.shard_stats(back, ["x", "y"])
    assert back.count() == 4000 and stats.count() == 16
    for c in "xy":
        assert stats.where(f"min_{c} <= 0.5 and max_{c} >= 0.5").count() <= 10


# -- classifiers --------------------------------------------------------------------------------------------------


def test_gradients_by_differences():
    net = language.train(["hello world " * 8, "bonjour le mo" * 8], ["a", "b"], steps=2)
    net = language.Network(net.languages, *[p.astype(np.float64) for p in net.parameters()])
    x, y, w = np.random.default_rng(0).integers(97, 100, (5, 4)).astype(np.intp), np.array([0, 1, 0, 1]), np.full(4, 0.25)
    _, grads = language.gradients(net, x, y, w)
    for p, g in zip(net.parameters(), grads, strict=True):
        flat, own = p.reshape(-1), g.reshape(-1)
        for k in np.argsort(-np.abs(own))[:4]:
            was = flat[k]
            sides = []
            for step in (1e-3, -1e-3):
                flat[k] = was + step
                sides.append(language.gradients(net, x, y, w)[0])
            flat[k] = was
            assert (sides[0] - sides[1]) / 2e-3 == pytest.approx(own[k], abs=2e-4)


def test_positions_and_windows():
    x, of, real = language.windows([b"", b"a" * 64, b"b" * 65, b"c"])
    assert of.tolist() == [1, 2, 2, 3] and real.tolist() == [64, 64, 1, 1] and x.shape == (96, 4)
    assert x[16].tolist() == [97, 98, 98, 99] and x[17, 3] == 0 and x[15].tolist() == [0, 0, 98, 0] and x[80].tolist() == [0, 98, 0, 0]
    net = language.train(["abc " * 40, "xyz " * 40], ["p", "q"], steps=3)
    p = language.label_positions(net, x.astype(np.intp))
    assert p.shape == (96, 4, 2) and np.allclose(p.sum(axis=-1), 1, atol=1e-5)


def plain_probabilities(net, data):
    """The network byte by byte, from its equations: each position from its window and the context around that."""
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    total = np.zeros(len(net.languages))
    for a in range(0, len(data), 64):
        piece = [data[k] if 0 <= k < len(data) else 0 for k in range(a - 16, a + 80)]
        states = []
        for d, order in enumerate((range(96), range(95, -1, -1))):
            h, own = np.zeros(net.out.shape[0] // 2), {}
            (tz, tr, tn), (uz, ur, un) = net.table[d].astype(float), net.state[d].astype(float)
            for t in order:
                z, r = sigmoid(tz[piece[t]] + h @ uz), sigmoid(tr[piece[t]] + h @ ur)
                n = np.tanh(tn[piece[t]] + (r * h) @ un)
                h = own[t] = n + z * (h - n)
            states.append(own)
        for t in range(16, 16 + min(64, len(data) - a)):
            e = np.exp(np.concatenate([states[0][t], states[1][t]]) @ net.out + net.bias)
            total += e / e.sum()
    return total / len(data)


def test_prediction_equals_a_plain_network():
    net = language.train(["abc äöü " * 40, "xyz words " * 40, "ñandú luego " * 30], ["p", "q", "r"], steps=12)
    texts = ["abc", "xyz words äö" * 20, "ñ" * 33, "a" * 64, "q" * 65 + "ü"]
    assert language.predict(net, texts) == pytest.approx(np.array([plain_probabilities(net, t.encode()) for t in texts]), abs=2e-4)


def test_training_reads_whole_texts(spark, monkeypatch):
    """Only the ends of the texts tell the languages apart."""
    filler = "0 1 2 3 4 5 6 7 8 9 a " * 20
    data = [(k, filler + ("das ist nicht ein " if k % 2 else "this is not one of ") * 12, "de" if k % 2 else "en") for k in range(300)]
    net = language.train_on(spark.createDataFrame(data, "doc_id long, text string, lang string"), 200, 2_000)
    assert (language.predict(net, ["das ist nicht ein " * 5, "this is not one of " * 5]).argmax(axis=1) == [0, 1]).all()


def test_language_of_held_out_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(df).join(df.select("doc_id", "lang"), "doc_id")
    own = df.select("doc_id", held_out("doc_id").alias("h")).where("h").count()
    rows = got.where("held_out").collect()
    assert len(rows) == own and all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.95


def test_language_of_awkward_rows(docs, rows, none):
    got = language.identify(docs, sample=20)
    assert got.count() == len(rows)
    unknown = {r["doc_id"] for r in got.where("lang_pred = 'und' and score = 0").collect()}
    assert unknown == {0, 1, 2, 3}
    assert language.identify(none).count() == 0
    assert language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0
    kept = language.keep_identified(docs, sample=20, min_score=0.0)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 5
    assert not language.has_letter("½ ² 12_") and language.has_letter("² a") and not language.has_letter(None)


def test_statistics_of_a_text():
    text = "The cat\nthe cat THE\n\n!? 12 é|"
    got = dict(zip(quality.STATISTICS, quality.statistics(text), strict=True))
    data, words = text.encode(), text.split()
    n = len(data)
    want = {"log_bytes": math.log(1 + n), "log_words": math.log(9), "word_length": sum(map(len, words)) / 8, "longest_word": 3, "distinct_words": 7 / 8, "doubled_words": 0, "capital_words": 1 / 8, "lines": math.log(4), "line_words": 8 / 3, "distinct_lines": 1}
    want |= {"entropy": -sum(c / n * math.log2(c / n) for c in Counter(data).values()), "share_upper": 4 / n, "share_lower": 11 / n, "share_digit": 2 / n, "share_blank": sum(b in b" \n" for b in data) / n, "share_symbol": 1 / n, "share_bang": 2 / n, "share_high": 2 / n, "share_bar": 1 / n}
    assert all(got[k] == pytest.approx(v) for k, v in want.items())
    assert quality.statistics("")[:2] == [0, 0] and len(quality.statistics("")) == len(quality.STATISTICS)


def test_splits_equal_brute_force():
    """The best cut of each node by trying every statistic and every bin on the rows themselves."""
    rng = np.random.default_rng(1)
    x, node = rng.integers(0, quality.BINS, (400, 4)), rng.integers(0, 3, 400)
    g, h = rng.normal(size=400) + 0.3 * (x[:, 2] > 20), rng.uniform(0.1, 0.3, 400)
    feature, cut, gain = quality._split(x, g, h, node, 3)
    worth = lambda at: g[at].sum() ** 2 / (h[at].sum() + quality.L2)
    for k in range(3):
        own, best = np.flatnonzero(node == k), (0.0, -1, 0)
        for j in range(4):
            for b in range(quality.BINS - 1):
                low, high = own[x[own, j] <= b], own[x[own, j] > b]
                if min(len(low), len(high)) >= quality.LEAST:
                    best = max(best, (worth(low) + worth(high) - worth(own), j, b), key=lambda e: e[0])
        assert (gain[k], feature[k]) == (pytest.approx(best[0]), best[1])
        low = lambda b: set(own[x[own, best[1]] <= b])  # noqa: B023, E731
        assert low(cut[k]) == low(best[2])


def test_trees_equal_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    trees = quality.train(x[:1000], y[:1000])
    scores = trees.scores(x)
    for k in range(0, 1500, 97):
        total = trees.start
        for f, t, l, v in zip(trees.feature, trees.threshold, trees.left, trees.value, strict=True):
            node = 0
            while f[node] >= 0:
                node = l[node] + (x[k, f[node]] > t[node])
            total += v[node]
        assert scores[k] == pytest.approx(1 / (1 + math.exp(-total)))
    assert ((scores[1000:] > 0.5) == (y[1000:] > 0.5)).mean() > 0.95


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels)
    assert got.count() == docs.count()
    rows = got.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50 and np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95


def test_quality_of_awkward_rows(spark, docs, rows, none):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(3, None, 0), (None, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert quality.classify(none, labels).count() == 0
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_samples_are_bounded(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"))
    got = bounded_sample(df, "doc_id", 100).collect()
    every = sorted((r["h"] for r in df.select(F.xxhash64("doc_id").alias("h")).collect()), key=lambda h: h % 2**64)
    assert [r["h"] for r in got] == every[:100]
    assert bounded_sample(df.select(F.lit(1).alias("doc_id")), "doc_id", 100).count() == 100


# -- queries ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_sql(spark, sf, name):
    from conftest import same_rows

    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    same_rows(queries.QUERIES[name](spark, sf), c.sql(queries.ORACLE_SQL[name]))
