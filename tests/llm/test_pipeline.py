import os

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from weirflow.llm import _common, bpe, quality, toxicity

from .test_native import plain_mix
from .test_ngram_join import brute_set
from .test_quality import brute as base

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_pipeline_against_brute_force(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    model = toxicity.learn_toxicity(docs, labels)
    rows = [r for r in docs.collect() if sum(model.severity(model.score(r.text))) < model.reject_at]
    assert len(rows) > 100
    clean = spark.createDataFrame(rows, docs.schema)
    trees = quality.learn_quality(clean, labels)

    def good(text):
        base, x = quality.features(text)
        return base[0] >= 10 and 100 * base[4] <= 20 * base[0] and trees.score(__import__("numpy").array([x]))[0] >= 0

    rows = [r for r in rows if good(r.text)]
    sets = {r.doc_id: brute_set(r.text) for r in rows}
    group = {i: i for i in sets}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                group[y] = x
    rows = [r for r in rows if find(r.doc_id) == r.doc_id]
    times = {r.doc_id: n for r, n in zip(rows, plain_mix([(r.doc_id, r.text, r.source) for r in rows]), strict=True)}
    c = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    want = sorted((r.doc_id, len(e.encode_ordinary(r.text))) for r in rows for _ in range(times[r.doc_id]))
    got = corpus_pipeline.run(spark, DIR)
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == want


def test_stages_on_awkward_rows(spark, awkward, empty, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    columns = list(corpus_pipeline.COLUMNS)
    for docs in (awkward, empty):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            out.write.mode("overwrite").parquet(str(tmp_path / "out"))
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert out.columns == columns


def test_awkward_rows_against_brute_force(spark, awkward, empty, tmp_path):
    """The whole pipeline without labels: the base rules, one of each component, mixed and encoded."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    alone = spark.createDataFrame([(None, "a text without an id that has more than ten words of its own", "en", None, 1, None, None, None)] * 2, awkward.schema)
    awkward = awkward.union(alone)
    awkward.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [r for r in awkward.collect() if base(r.text)[0] >= 10 and 100 * base(r.text)[4] <= 20 * base(r.text)[0]]
    rows.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0))
    sets, kept, group = [brute_set(r.text) for r in rows], [], list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                group[y] = x
    kept = [rows[i] for i in range(len(rows)) if find(i) == i]
    assert len(kept) > 20 and any(r.doc_id is None for r in kept)
    times = plain_mix([(r.doc_id, r.text, r.source) for r in kept])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    c = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    assert sorted(str((r.doc_id, r.ids)) for r in got) == sorted(str((r.doc_id, e.encode_ordinary(r.text))) for r, n in zip(kept, times, strict=True) for _ in range(n))


def test_only_the_result_stays(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(i, f"word{i} and some more words in a text of its own {i} {i}", "en", "s", 1) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    shared = tmp_path / "shared"
    shared.mkdir()
    monkeypatch.setattr(_common, "shared_root", lambda s: f"file://{shared}")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert [p.name.split("-")[1] for p in shared.iterdir()] == ["stage4"]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_pipeline_gives_the_ids(spark, awkward):
    c = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = corpus_pipeline.run(spark, DIR).collect()
    assert got and all(r.ids == e.encode_ordinary(text[r.doc_id]) and len(r.ids) == r.n_tokens for r in got)
    encoded = corpus_pipeline.encoding_stage(spark, awkward.where("n_chars is null or n_chars < 100"), DIR)
    want = [e.encode_ordinary(r.text or "") for r in awkward.where("n_chars is null or n_chars < 100").collect()]
    assert sorted(r.ids for r in encoded.collect()) == sorted(want)
