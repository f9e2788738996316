"""URL filters: host and path rules, then exact membership of a host in a list by a cascade of Bloom filters.

A cascade is built for a universe of keys, here every host of the corpus and every parent domain of one. Level 1 holds
the listed keys, level 2 the keys of the universe that are not listed yet pass level 1, level 3 the listed ones that
pass level 2, and so on until no key passes wrongly. A key of the universe is listed if the first level that it fails
is even, or if it passes all and their number is odd. There are no false answers in the universe, and no join.

Scale: the universe is made once (distinct hosts, aggregated before the shuffle); each level is built by tasks that OR
the bits of their keys; only filter words go to the driver and to the tasks. Keys are dealt by their hash into as many
parts as keep each part's cascade under about ``MAX_BYTES``; rows pass the parts one after the other, so no task ever
holds more than one part's filters, whatever the length of the list.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import keep
from wayfold.llm.simhash import xxh64

#: (verdict, rule); a rule is a host and a path that begins with "/".
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Listed domains: names of unwanted sites under each top-level domain.
UNWANTED = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED = tuple(f"{name}.example.{top}" for name in UNWANTED for top in ("com", "net", "org"))
#: Share of keys that pass a level wrongly, and the least share for level 1, which is otherwise listed / others.
PASS, LEAST_PASS = 0.1, 1e-4
MAX_BYTES, MAX_LEVELS, PART_SEED = 64 << 20, 64, 1_000_003


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits (equal lengths: the first by text), or null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        own, _, rest = rule.partition("/")
        found = F.when(((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}"), F.lit(rule)).otherwise(found)
    return found


@dataclass
class Level:
    bits: int
    hashes: int
    words: np.ndarray

    @staticmethod
    def shape(n: float, share: float) -> tuple[int, int]:
        return max(64, math.ceil(-n * math.log(share) / math.log(2) ** 2)), max(1, round(-math.log2(share)))


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    @staticmethod
    def positions(bits: int, hashes: int, seed: int, data: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """(keys, hashes) bit places."""
        h = xxh64(data, start, length, seed)
        with np.errstate(over="ignore"):
            steps = (h >> np.uint64(32)) | np.uint64(1)
            return ((h[:, None] + np.arange(hashes, dtype=np.uint64) * steps[:, None]) % np.uint64(bits)).astype(np.int64)

    def passed(self, data: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """How many levels each key passes before it fails one."""
        out, on = np.zeros(len(start), dtype=np.int64), np.arange(len(start))
        for k, level in enumerate(self.levels):
            at = self.positions(level.bits, level.hashes, k + 1, data, start[on], length[on])
            on = on[((level.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)]
            out[on] += 1
        return out

    def listed(self, data: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.passed(data, start, length) % 2 == 1

    def size(self) -> int:
        return sum(x.words.nbytes for x in self.levels)


def _packed(keys: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    coded = [k.encode("utf-8", "surrogatepass") for k in keys]
    length = np.array([len(c) for c in coded], dtype=np.int64)
    return b"".join(coded), np.cumsum(length) - length, length


def expected_bytes(listed: int, others: int) -> int:
    """About what the filters of a cascade take: each level below the first holds the keys that pass the one above."""
    share = min(PASS, max(LEAST_PASS, listed / max(1, others)))
    bits, n, m = Level.shape(listed, share)[0], others * share, listed * PASS
    while listed and n >= 1:
        bits += Level.shape(n, PASS)[0]
        n, m = m, n * PASS
    return bits // 8


def build_cascade(universe: DataFrame) -> Cascade:
    """From distinct keys: (key string, listed boolean)."""
    done = Cascade()
    total = {bool(r["listed"]): r["count"] for r in universe.groupBy("listed").count().collect()}
    others = total.get(False, 0)
    for k in range(MAX_LEVELS):
        side = universe.where("listed" if k % 2 == 0 else "not listed").select("key")
        n = total.get(True, 0) if k == 0 else side.mapInArrow(_left(done), "n long").agg(F.sum("n")).first()[0] or 0
        if not n:
            return done
        share = min(PASS, max(LEAST_PASS, n / max(1, others))) if k == 0 else PASS
        bits, hashes = Level.shape(n, share)
        words = np.zeros(-(-bits // 64), dtype=np.uint64)
        for r in side.mapInArrow(_bits(done, bits, hashes, k + 1), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
            words[r["word"]] = np.uint64(r["bits"] & (2**64 - 1))
        done = Cascade([*done.levels, Level(bits, hashes, words)])
    raise RuntimeError("the cascade does not end")


def _alive(done: Cascade, batch: pa.RecordBatch) -> tuple[bytes, np.ndarray, np.ndarray]:
    data, start, length = _packed(batch.column(0).to_pylist())
    on = done.passed(data, start, length) == len(done.levels)
    return data, start[on], length[on]


def _left(done: Cascade):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(_alive(done, batch)[1])], pa.int64())], names=["n"])

    return run


def _bits(done: Cascade, bits: int, hashes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(-(-bits // 64), dtype=np.uint64)
        for batch in batches:
            data, start, length = _alive(done, batch)
            at = Cascade.positions(bits, hashes, seed, data, start, length).reshape(-1)
            np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(words[used].view(np.int64))], names=["word", "bits"])

    return run


def domains(host: Column, longest: int) -> Column:
    """A host and its parent domains, those of at most ``longest`` bytes: no longer one can be listed. So the work for a
    host of any length is bounded."""
    labels = F.split(F.right(host, F.lit(longest + 1)), r"\.")
    n = F.size(labels)
    every = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.filter(every, lambda d: F.octet_length(d) <= longest)


def universe_of(hosts: DataFrame, listed: list[str] | tuple[str, ...] | DataFrame) -> tuple[DataFrame, int]:
    """(key, listed): the distinct hosts of the column ``host`` and their parent domains, and all listed keys; and the
    bytes of the longest listed key, beyond which a domain is not asked for."""
    spark = hosts.sparkSession
    given = listed.select(F.col(listed.columns[0]).alias("key")) if isinstance(listed, DataFrame) else spark.createDataFrame([(k,) for k in listed], "key string")
    given = given.where("key is not null").select("key", F.lit(1).alias("l"))
    longest = given.agg(F.max(F.octet_length("key"))).first()[0] or 0
    keys = hosts.where("host <> ''").select("host").distinct().select(F.explode(domains(F.col("host"), longest)).alias("key")).select("key", F.lit(0).alias("l"))
    return keep(keys.unionAll(given).groupBy("key").agg((F.max("l") == 1).alias("listed"))), longest


def part_of(data: bytes, start: np.ndarray, length: np.ndarray, parts: int) -> np.ndarray:
    """The part that each key is dealt to."""
    return (xxh64(data, start, length, PART_SEED) % np.uint64(parts)).astype(np.int64)


def _dealt(parts: int):
    """A pandas UDF: the part of a key."""

    @F.pandas_udf("int")
    def part(key: pd.Series) -> pd.Series:
        return pd.Series(part_of(*_packed(key.tolist()), parts).astype(np.int32))

    return part


def contains_domain(cascade: Cascade, longest: int, part: int = 0, parts: int = 1):
    """A pandas UDF: whether a host or a parent domain of it, of at most ``longest`` bytes and dealt to this part, is
    listed."""

    @F.pandas_udf("boolean")
    def listed(host: pd.Series) -> pd.Series:
        coded = [(h or "").encode("utf-8", "surrogatepass") for h in host]
        data = b".".join([*coded, b""])
        length = np.array([len(c) for c in coded], dtype=np.int64)
        ends = np.cumsum(length + 1) - 1
        dots = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == ord("."))
        # a domain begins at a host's start and behind each dot in it; the host's end closes all of them
        start = np.concatenate([ends - length, dots[~np.isin(dots, ends)] + 1]).astype(np.int64)
        of = np.concatenate([np.arange(len(coded)), np.searchsorted(ends, start[len(coded) :])])
        hit = np.zeros(len(coded), dtype=bool)
        some = (length[of] > 0) & (ends[of] - start <= longest)
        start, of = start[some], of[some]
        if parts > 1:
            some = part_of(data, start, ends[of] - start, parts) == part
            start, of = start[some], of[some]
        hit[of[cascade.listed(data, start, ends[of] - start)]] = True
        return pd.Series(hit)

    return listed


def judge_urls(pages: DataFrame, rules=RULES, listed=LISTED, max_bytes: int = MAX_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url).

    ``listed``: domains, as strings or as the first column of a DataFrame. A null url and one without ``://`` have neither
    host nor path, fit no rule and are allowed; repeated rows are repeated; other columns are ignored; no rows give none.
    Without a rule, a url is blocked if its host or a parent domain of that is listed.
    """
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    universe, longest = universe_of(rows.select("host"), listed)
    total = {bool(r["listed"]): r["count"] for r in universe.groupBy("listed").count().collect()}
    parts = max(1, -(-expected_bytes(total.get(True, 0), total.get(False, 0)) // max(1, max_bytes)))
    if parts > 1:
        universe = keep(universe.withColumn("part", _dealt(parts)(F.col("key"))))
    marked = rows.withColumn("bad", F.lit(False))
    for k in range(parts):
        cascade = build_cascade(universe.where(F.col("part") == k) if parts > 1 else universe)
        marked = marked.withColumn("bad", F.col("bad") | contains_domain(cascade, longest, k, parts)(F.col("host")))
        if k < parts - 1:
            marked = keep(marked)  # the filters of one part at a time
    ruled = marked.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.when(F.col("bad"), "block").otherwise("allow")
    for kind, rule in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(kind)).otherwise(verdict)
    return ruled.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def oracle(table: str = "pages") -> str:
    fits = []
    for kind, rule in sorted(RULES, key=lambda r: -len(r[1])):
        own, _, rest = rule.partition("/")
        fits.append((f"(host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{rest}')", rule, kind))
    rules = " ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in fits)
    kinds = " ".join(f"WHEN rule = '{r}' THEN '{k}'" for _, r, k in fits)
    bad = " OR ".join(f"host = '{k}' OR ends_with(host, '.{k}')" for k in LISTED)
    return f"""
    WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM {table}),
    parsed AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    ruled AS (SELECT *, CASE {rules} END AS rule FROM parsed)
    SELECT page_id, host, path, rule, CASE {kinds} WHEN {bad} THEN 'block' ELSE 'allow' END AS verdict FROM ruled
    """
