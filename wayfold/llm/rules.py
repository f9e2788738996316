"""Quality rules with thresholds that adapt to each language and source.

Everything is a DataFrame expression: no Python runs on the executors.

Ratios of a text are integers in thousandths. Their sketch is a histogram of these at most 1001 bins per group, so it
merges by adding counts, does not depend on the order or the division of the rows, and gives any quantile to within a
thousandth of its value (not of its rank: most ratios are 0, and so is their quantile). Counts are aggregated before the
shuffle and spread over bins, so that no group is hot. A group with fewer than ``min_group`` documents takes the
thresholds of its language, or else those of all documents, whose sketches are the merged ones of the groups below; with
``min_group`` 1 every group has its own.

A threshold is the upper quartile plus ``FENCE`` times the distance between the quartiles (at least ``LEAST_SPREAD``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import SEPARATORS, fresh, keep

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Ratios whose upper thresholds adapt, in thousandths.
RATIOS = ("symbols", "dup_lines", "repeats", "capitals")
#: Distance beyond the upper quartile in spreads, the least spread per ratio, and documents that make a group by default.
FENCE = 4
LEAST_SPREAD = {"symbols": 10, "dup_lines": 100, "repeats": 45, "capitals": 50}
MIN_GROUP = 100
#: Groups up to which their thresholds are broadcast (a row has under 100 bytes); beyond, Spark joins by shuffle.
BROADCAST_GROUPS = 50_000

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column, window: int) -> Column:
    """Words in windows of ``window`` words that are found twice or more, the first included. Windows are told apart
    by 64-bit hashes; only texts in which one comes twice are sorted."""
    n = F.size(words)
    hashes = F.when(
        n >= window,
        F.transform(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0))), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(window)))),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = _let(
            placed,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(s, lambda e, k: F.coalesce(F.get(s, k - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["x"] == e["x"], F.lit(False))),
                    lambda e: e["i"],
                )
            ),
        )
        begin = F.struct(F.lit(-window).alias("at"), F.lit(0).alias("n"))
        return F.aggregate(twice, begin, lambda acc, x: F.struct(x.alias("at"), (acc["n"] + F.least(F.lit(window), x - acc["at"])).alias("n")), lambda acc: acc["n"])

    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def measures(text: Column, window: int = WINDOW) -> Column:
    """A struct of the base counts, and of n_lines and n_capitals, of a text (null: no words)."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SEPARATORS), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = _let(words, lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), _repeat_words(w, window).alias("n_repeat_words")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), F.size(F.array_distinct(x)).alias("n_distinct")))
    return _let(
        F.struct(of_words.alias("w"), of_lines.alias("l")),
        lambda m: F.struct(
            m["w"]["n_words"].cast("long").alias("n_words"),
            m["w"]["word_chars"].cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (m["l"]["n_lines"] - m["l"]["n_distinct"]).cast("long").alias("n_dup_lines"),
            m["w"]["n_repeat_words"].cast("long").alias("n_repeat_words"),
            m["l"]["n_lines"].cast("long").alias("n_lines"),
            F.regexp_count(text, F.lit(r"[A-Z]")).cast("long").alias("n_capitals"),
        ),
    )


def _ratios(m: Column) -> dict[str, Column]:
    """Thousandths, rounded down; 0 where there is nothing to divide by."""
    part = lambda a, b: F.when(m[b] > 0, F.floor(F.lit(1000) * m[a] / m[b])).otherwise(F.lit(0)).cast("int")
    return {"symbols": part("n_symbols", "word_chars"), "dup_lines": part("n_dup_lines", "n_lines"), "repeats": part("n_repeat_words", "n_words"), "capitals": part("n_capitals", "word_chars")}


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def sketch(rows: DataFrame, by: list[str]) -> DataFrame:
    """Merges sketches (or builds them from rows with n = 1): counts by group, ratio and bin."""
    return rows.groupBy(*by, "ratio", "bin").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, by: list[str]) -> DataFrame:
    """One row per group: n documents, and per ratio the threshold."""
    w = Window.partitionBy(*by, "ratio")
    upto = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    run = sketches.withColumn("upto", upto).withColumn("all", F.sum("n").over(w))
    quartile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.col("bin")))
    found = run.groupBy(*by, "ratio").agg(quartile(1).alias("q1"), quartile(3).alias("q3"), F.max("all").alias("n"))
    least = F.create_map(*(F.lit(x) for kv in LEAST_SPREAD.items() for x in kv))
    fence = F.col("q3") + FENCE * F.greatest(F.col("q3") - F.col("q1"), least[F.col("ratio")])
    per = found.select(*by, "ratio", "n", fence.alias("fence"))
    return per.groupBy(*by).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("ratio") == r, F.col("fence"))).alias(r) for r in RATIOS))


def thresholds(measured: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source) -> thresholds, from rows with lang, source and a struct ``m`` of `measures`. Null languages and
    sources are groups of their own."""
    ratios = F.array(*(F.struct(F.lit(r).alias("ratio"), c.alias("bin")) for r, c in _ratios(F.col("m")).items()))
    each = measured.select("lang", "source", F.explode(ratios).alias("r")).select("lang", "source", "r.ratio", "r.bin", F.lit(1).cast("long").alias("n"))
    fine = keep(sketch(each, ["lang", "source"]))
    per_lang = keep(sketch(fine, ["lang"]))
    whole = fences(sketch(per_lang, []), []).first()  # one row of thresholds
    own, lang = fences(fine, ["lang", "source"]), fences(per_lang, ["lang"])
    lang = lang.select(F.col("lang").alias("l"), F.col("n").alias("n_lang"), *(F.col(r).alias(f"lang_{r}") for r in RATIOS))
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l")))
    pick = lambda r: F.when(F.col("n") >= min_group, F.col(r)).when(F.col("n_lang") >= min_group, F.col(f"lang_{r}")).otherwise(F.lit(whole[r] if whole else None).cast("int")).alias(r)
    return joined.select("lang", "source", *(pick(r) for r in RATIOS))


def judge(measured: DataFrame, name: str, min_group: int = MIN_GROUP) -> DataFrame:
    """``measured`` (lang, source, m, whatever else) with the verdict in a column ``name``: false if a base rule
    fails or a ratio is beyond its group's threshold."""
    limits = keep(thresholds(measured.select("lang", "source", "m"), min_group))
    l, s, *cols = fresh(measured, "lang_of", "source_of", *(f"most_{r}" for r in RATIOS))
    limits = limits.select(F.col("lang").alias(l), F.col("source").alias(s), *(F.col(r).alias(c) for r, c in zip(RATIOS, cols, strict=True)))
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    joined = measured.join(limits, measured["lang"].eqNullSafe(F.col(l)) & measured["source"].eqNullSafe(F.col(s)))
    within = F.lit(True)
    for c, value in zip(cols, _ratios(F.col("m")).values(), strict=True):
        within = within & (value <= F.col(c))
    return joined.withColumn(name, ~base_failed(F.col("m")) & within).drop(l, s, *cols)


def quality_rules(documents: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every row of ``documents`` (doc_id, text, lang, source).

    A null or empty text has no words and fails; repeated rows are repeated, and count in the sketches as often; other
    columns are ignored; no rows give none. The texts are read once and never shuffled.
    """
    measured = keep(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", measures(F.col("text")).alias("m")))
    judged = judge(measured, "kept", min_group)
    return judged.select("doc_id", *(F.col("m")[c].alias(c) for c in BASE), base_failed(F.col("m")).alias("base_failed"), "kept")


def keep_good(documents: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of ``documents`` that the rules keep, with their columns as they are. Null, empty and short texts go; a row
    that comes twice stays or goes twice; no rows give none."""
    columns = documents.columns
    row, m, kept = fresh(documents, "row", "m", "kept")
    whole = F.struct(*columns).alias(row)
    measured = keep(documents.select(whole, F.col("lang").alias("lang"), F.col("source").alias("source"), measures(F.col("text")).alias("m")))
    judged = judge(measured, kept, min_group)
    return judged.where(F.col(kept)).select(*(F.col(row)[c].alias(c) for c in columns))


def query(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_RATIO_SQL = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "capitals": ("n_capitals", "word_chars")}


def oracle(table: str = "documents") -> str:
    """The same rows in DuckDB's SQL; rows are told apart by their place, so that repeated ones count."""
    ratio = ", ".join(f"CASE WHEN {b} > 0 THEN (1000 * {a}) // {b} ELSE 0 END AS {r}" for r, (a, b) in _RATIO_SQL.items())
    stack = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS ratio, {r} AS bin FROM measured" for r in RATIOS)
    least = " ".join(f"WHEN '{r}' THEN {v}" for r, v in LEAST_SPREAD.items())

    def fence(by: str, name: str) -> str:
        group = f"{by}, " if by else ""
        return f"""{name}_run AS (SELECT {group}ratio, bin, sum(n) OVER (PARTITION BY {group}ratio ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {group}ratio) AS total
            FROM (SELECT {group}ratio, bin, count(*) AS n FROM stacked GROUP BY {group}ratio, bin)),
        {name}_q AS (SELECT {group}ratio, min(bin) FILTER (4 * upto >= total) AS q1, min(bin) FILTER (4 * upto >= 3 * total) AS q3, max(total) AS n FROM {name}_run GROUP BY {group}ratio),
        {name} AS (SELECT {group}max(n) AS n, {", ".join(f"max(q3 + {FENCE} * greatest(q3 - q1, CASE ratio {least} END)) FILTER (ratio = '{r}') AS {r}" for r in RATIOS)} FROM {name}_q {"GROUP BY " + by if by else ""})"""

    limit = lambda r: f"CASE WHEN g.n >= {MIN_GROUP} THEN g.{r} WHEN l.n >= {MIN_GROUP} THEN l.{r} ELSE a.{r} END"
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS text FROM {table}),
    split_words AS (SELECT k, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS x FROM docs),
    words AS (SELECT k, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split_words),
    windows AS (SELECT k, i, word AS w0, {", ".join(f"lead(word, {j}) OVER o AS w{j}" for j in range(1, WINDOW))} FROM words WINDOW o AS (PARTITION BY k ORDER BY i)),
    twice AS (SELECT k, i FROM windows WHERE w{WINDOW - 1} IS NOT NULL QUALIFY count(*) OVER (PARTITION BY k, {", ".join(f"w{j}" for j in range(WINDOW))}) > 1),
    covered AS (SELECT k, sum(gain) AS n FROM (SELECT k, least({WINDOW}, i - coalesce(lag(i) OVER (PARTITION BY k ORDER BY i), i - {WINDOW})) AS gain FROM twice) GROUP BY k),
    measured AS (SELECT doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {ratio} FROM (
        SELECT d.doc_id, d.lang, d.source, len(s.w)::BIGINT AS n_words, length(array_to_string(s.w, ''))::BIGINT AS word_chars,
            (length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
            (len(s.x) - len(list_distinct(s.x)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(s.x)::BIGINT AS n_lines,
            (length(d.text) - length(regexp_replace(d.text, '[A-Z]', '', 'g')))::BIGINT AS n_capitals
        FROM docs d JOIN split_words s USING (k) LEFT JOIN covered c USING (k))),
    stacked AS ({stack}),
    {fence("lang, source", "by_source")},
    {fence("lang", "by_lang")},
    {fence("", "over_all")}
    SELECT m.doc_id, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words,
        m.n_words < {MIN_WORDS} OR 100 * m.n_repeat_words > {MAX_REPEAT_PERCENT} * m.n_words AS base_failed,
        NOT (m.n_words < {MIN_WORDS} OR 100 * m.n_repeat_words > {MAX_REPEAT_PERCENT} * m.n_words) AND {" AND ".join(f"m.{r} <= {limit(r)}" for r in RATIOS)} AS kept
    FROM measured m JOIN by_source g ON m.lang IS NOT DISTINCT FROM g.lang AND m.source IS NOT DISTINCT FROM g.source
    JOIN by_lang l ON m.lang IS NOT DISTINCT FROM l.lang CROSS JOIN over_all a
    """
