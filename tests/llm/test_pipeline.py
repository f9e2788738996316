"""The pipeline against its stages done plainly."""

from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
from test_corpus_ops import check_packing, expected_pieces, groups, near_long, plain_long_fingerprint

from wayfold.llm import language, rules


def test_run_equals_plain_stages(spark, sf):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "simhash_dedup", "best_fit_packing"]
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    good = {r[0] for r in c.sql(f"SELECT doc_id FROM ({rules.oracle()}) WHERE kept").fetchall()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs.where(docs["doc_id"].isin([int(k) for k in good]))
    net = language.train_on(first)
    left = {r["doc_id"]: r["text"] for r in first.collect()}
    p = language.predict(net, list(left.values())).max(axis=1)
    left = {k: t for (k, t), s in zip(left.items(), p, strict=True) if language.has_letter(t) and s >= language.MIN_SCORE}
    fps = {k: plain_long_fingerprint(t) for k, t in left.items()}
    root, least = groups(fps.values(), near_long), {}
    for k in sorted(fps, reverse=True):
        least[root[fps[k]]] = k
    kept = sorted(least.values())
    assert 0 < len(kept) < docs.count()
    got = corpus_pipeline.run(spark, sf).collect()
    by_seq = check_packing(got, Counter(expected_pieces((k, left[k]) for k in kept)))
    assert len(by_seq) <= np.ceil(sum(r["length"] for r in got) / 2048) + 2
    assert public_tokenizers.path("word_bpe_49k.json")


def test_stages_return_the_columns_of_documents(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert out.schema == docs.schema, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
