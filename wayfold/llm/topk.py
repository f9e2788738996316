"""Exact top-k by inner product with Fagin's threshold algorithm.

Per dimension there is a list of a block's vectors sorted by their component. All lists are read from both ends, a few
entries of each at a time, and each vector met for the first time is scored for all queries still asking, in one matrix
product. No vector that has not been met can score more than the sum over the dimensions of a query's component times
the component where the better end of that list has got to; once this bound is below a query's kth score, the rest of
the block cannot matter to it (an equal score still could, by a smaller id).

Scale: the queries, a stated set, are sent to the tasks in blocks of at most ``QUERY_BYTES``; candidates are read where
they lie and are never shuffled or copied. A task goes through its candidates in Arrow batches and carries each query's
k best along, so that a later batch starts from a kth score and most of its vectors are only compared with it. What a
task returns, at most k rows a query, is ranked by a window whose limit Spark applies before the shuffle. The work is
queries times rows by nature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import keep

K, SCALE, QUERY_EVERY = 10, 1024, 100
#: Bytes of the query vectors sent at once, candidates whose lists are made at once, cells of a score matrix.
QUERY_BYTES, BLOCK, CELLS = 32 << 20, 16_384, 2_000_000
#: List entries read at first from either end; doubled in each round.
READ = 8
#: Whole numbers under this are exact as doubles, and so are sums of products under it.
EXACT, LONG = 2.0**53, 2**63 - 1


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and v, without vectors that are null or hold a null or a component that is not finite. A null id stays."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kind = dict(embeddings.dtypes)["embedding"]
    v = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    return embeddings.where(F.col("embedding").isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def matrix(vectors: pa.ListArray) -> np.ndarray:
    """Rows of equal width as doubles; shorter vectors end in zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(vectors), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """The components times ``scale`` rounded down: doubles if all are exact, else Python's integers."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not y.size or np.abs(y).max() < EXACT:
        return y
    one = lambda v: int(v) * scale if abs(v) >= EXACT else int(np.floor(v * scale))  # noqa: E731  so large a double has no fraction
    return np.array([one(v) for v in x.reshape(-1).tolist()], dtype=object).reshape(x.shape)


class Search:
    """The k best of all candidates met so far, for a block of queries with distinct ids."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.q, self.k = ids[order], q[order], k
        shape = (len(ids), k)
        self.score, self.best, self.unnamed = np.full(shape, -np.inf), np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=bool)
        #: vectors scored, once for each query that asked
        self.scored = 0

    def _same_kind(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and rows of one width and kind in which no score can overflow or be rounded."""
        width = max(rows.shape[1], self.q.shape[1])
        q, rows = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (self.q, rows))
        most = [float(min(np.abs(x).max(), 1e300)) if x.size else 0.0 for x in (q, rows)]
        if q.dtype == object or rows.dtype == object or most[0] * most[1] * width >= EXACT:
            as_ints = lambda x: x if x.dtype == object else np.array([int(v) for v in x.reshape(-1)], dtype=object).reshape(x.shape)
            self.score = self.score.astype(object)
            return as_ints(q), as_ints(rows)
        return q, rows

    def meet(self, ids: np.ndarray, unnamed: np.ndarray, rows: np.ndarray) -> None:
        """Goes through a block of candidates: ids (``unnamed``: it is null) and whole numbers."""
        if not len(ids) or not len(self.ids):
            return
        q, rows = self._same_kind(rows)
        n, used = len(ids), np.flatnonzero((q != 0).any(axis=0))
        # the lists, and when the first of them gets to each vector from either end
        up = np.argsort(rows[:, used], axis=0, kind="stable")
        lists = np.take_along_axis(rows[:, used], up, axis=0)
        rank = np.empty_like(up)
        np.put_along_axis(rank, up, np.broadcast_to(np.arange(n)[:, None], up.shape), axis=0)
        # without a component of any query every vector scores 0, and no list is needed
        first = np.minimum(rank, n - 1 - rank).min(axis=1) if len(used) else np.zeros(n, dtype=np.int64)
        turn = np.argsort(first, kind="stable")
        reached = first[turn]
        plus, minus = (np.where(q[:, used] > 0, q[:, used], 0), np.where(q[:, used] < 0, q[:, used], 0))
        asking, at, depth = np.arange(len(q)), 0, READ
        while len(asking):
            to = int(np.searchsorted(reached, depth, side="left"))
            new = turn[at:to]
            step = max(1, CELLS // max(1, len(new)))
            for a in range(0, len(asking), step):
                self._score(asking[a : a + step], q, ids[new], unnamed[new], rows[new])
            if to >= n:
                return
            bound = plus[asking] @ lists[n - 1 - depth] + minus[asking] @ lists[depth]
            asking = asking[~(self.score[asking, -1] > bound)]
            at, depth = to, 2 * depth

    def _score(self, asking: np.ndarray, q: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, rows: np.ndarray) -> None:
        if not len(ids):
            return
        s = q[asking] @ rows.T
        self.scored += s.size
        # not the query's own rows
        of = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        own = np.flatnonzero((self.ids[of] == ids) & ~unnamed)
        line = np.minimum(np.searchsorted(asking, of[own]), len(asking) - 1)
        hit = asking[line] == of[own]
        s[line[hit], own[hit]] = -np.inf
        floor = self.score[asking, -1]
        if len(ids) > self.k and (low := np.flatnonzero(floor == -np.inf)).size:
            floor = floor.copy()
            floor[low] = np.sort(s[low], axis=1)[:, -self.k] if s.dtype == object else np.partition(s[low], -self.k, axis=1)[:, -self.k]
        i, j = np.nonzero((s >= floor[:, None]) & (s != -np.inf))
        if not len(i):
            return
        some = np.unique(i)
        old = asking[some]
        line = np.concatenate([np.repeat(old, self.k), asking[i]])
        score = np.concatenate([self.score[old].reshape(-1), s[i, j]])
        name = np.concatenate([self.best[old].reshape(-1), ids[j]])
        none = np.concatenate([self.unnamed[old].reshape(-1), unnamed[j]])
        order = np.lexsort((name, none, -score, line))
        begin = np.flatnonzero(np.diff(line[order], prepend=-1))
        take = order[(begin[:, None] + np.arange(self.k)).reshape(-1)]  # each line has its k old ones at least
        shape = (len(old), self.k)
        self.score[old], self.best[old], self.unnamed[old] = score[take].reshape(shape), name[take].reshape(shape), none[take].reshape(shape)

    def found(self) -> pa.RecordBatch:
        """query_id, vec_id, score (a long, at its limit if beyond it) and far, which orders scores beyond it."""
        i, j = np.nonzero(self.score != -np.inf)
        exact = [int(s) for s in self.score[i, j].tolist()]
        columns = [pa.array(self.ids[i]), pa.array(self.best[i, j], mask=self.unnamed[i, j])]
        columns += [pa.array([max(-LONG, min(LONG, s)) for s in exact], pa.int64()), pa.array([_far(s) for s in exact], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score", "far"])


def _far(score: int) -> str:
    """A text that is larger for the larger of two scores at the same limit of a long; empty for the others."""
    if -LONG < score < LONG:
        return ""
    digits = str(abs(score))
    return f"{len(digits):05d}{digits}" if score > 0 else f"{99_999 - len(digits):05d}{digits.translate(str.maketrans('0123456789', '9876543210'))}"


def _meeting(sent, k: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*sent.value, k)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                ids = part.column(0)
                search.meet(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), whole(matrix(part.column(1)), scale))
        yield search.found()

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: of each row of ``queries`` (vec_id, v) the k best rows of ``vectors`` (vec_id, v)
    but those with its own id; all if there are fewer. Components are taken times ``scale``, rounded down.

    Scores are exact whatever the components' size; one beyond a long is ranked by its value and shown as the long
    closest to it. Shorter vectors count as ending in zeros. Rows that share an id are vectors of their own as
    candidates, a row without an id is one too (last among equals); a query id that comes more than once asks with its
    smallest vector, and a query without an id does not ask. Other columns are ignored; no rows give none.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", "v")
    asked = keep(queries.where("vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v")))
    n, width = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    blocks = max(1, -(-n * 8 * max(1, width or 1) // query_bytes))
    met = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b) if blocks > 1 else asked
        table = part.toArrow().combine_chunks()  # at most about query_bytes
        ids, rows = (table.column(c).combine_chunks() if table.num_rows else pa.array([], t) for c, t in (("vec_id", pa.int64()), ("v", pa.list_(pa.float64()))))
        sent = spark.sparkContext.broadcast((ids.to_numpy(), whole(matrix(rows), scale)))
        own = vectors.mapInArrow(_meeting(sent, k, scale), "query_id long, vec_id long, score long, far string")
        met = own if met is None else met.unionAll(own)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("far"), F.asc_nulls_last("vec_id")))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))


def oracle(table: str = "embeddings") -> str:
    return f"""
    WITH vectors AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM {table}
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score
        FROM vectors a JOIN vectors b ON a.vec_id % {QUERY_EVERY} = 0 AND a.vec_id IS DISTINCT FROM b.vec_id)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= {K}
    """
