"""The pipeline's stages on a small table, each against what its operator decides."""

import re

import numpy as np
import public_tokenizers
import sentencepiece

import corpus_pipeline
from weftline.llm import personal_data, quality_rules, shingle_join

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stored(stage(spark, before, SF), "test")
        assert after.schema.simpleString() == docs.schema.simpleString(), name
        if name == "quality_rules":
            judged, _ = quality_rules.apply(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert ids(after) == ids(judged.where("kept")) and len(ids(after)) < 200
        elif name == "near_duplicates":
            assert ids(after) == ids(shingle_join.components(before).where("doc_id = component_id"))
            assert shingle_join.components(after).where("doc_id <> component_id").count() == 0
        elif name == "personal_data":
            assert ids(after) == ids(before)
            assert not any(personal_data.base_spans(r.text) for r in after.collect())
            assert all(r.n_chars == len(r.text) for r in after.collect())
        before = after
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    final = corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
    texts = {r.doc_id: r.text for r in before.collect()}
    assert len(final) == before.count() and all(r.ids == sp.encode(texts[r.doc_id]) for r in final)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50


def test_stages_with_odd_rows(spark):
    """Empty tables, null ids and texts, equal rows, ties, and columns that a stage might use itself: each has its defined result."""
    shape = "doc_id long, text string, lang string, source string, n_chars long, row int, copies int, spans string"
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(80))
    a, b = words(1), words(2) + " mail a@b.co"
    table = [(1, a, "en", "s", 9, 1, 1, "x"), (2, a, "en", "s", 9, 1, 1, "x"), (None, a, "en", "s", 9, 1, 1, "x"), (3, b, "en", None, 9, 1, 1, "x"), (3, b, "en", None, 9, 1, 1, "x"), (4, None, None, None, None, None, None, None), (5, "", "en", "s", 0, 1, 1, "x"), (None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(table, shape)
    stage = dict(corpus_pipeline.STAGES)
    sf = "/root/testdata/sf0.001"
    for name, fn in corpus_pipeline.STAGES:
        assert fn(spark, docs.limit(0), sf).count() == 0, name
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    assert ids(stage["quality_rules"](spark, docs, sf)) == [1, 2, 3, 3, None]
    assert ids(stage["near_duplicates"](spark, docs, sf)) == [1, 3, 3, 4, 5, None, None]
    covered = {(r.doc_id, r.text, r.n_chars) for r in stage["personal_data"](spark, docs, sf).collect()}
    assert (3, words(2) + " mail <EMAIL>", len(words(2)) + 13) in covered and (4, None, None) in covered and (1, a, len(a)) in covered
    assert set(ids(stage["source_mixing"](spark, docs, sf))) <= {1, 2, 3, 4, 5, None}
    got = {r.doc_id: r.ids for r in stage["sentencepiece"](spark, docs, sf).where("doc_id is not null").collect()}
    assert got[4] == [] and got[5] == [] and len(got[1]) > 80


def test_stages_like_brute_force(spark, tmp_path):
    """The whole pipeline's documents and texts against plain loops, on documents with exact and near copies and personal data."""
    rng = np.random.default_rng(1)
    table = []
    for k in range(60):
        words = [f"{'abcdefgh'[rng.integers(0, 8)]}{k}y{i}" for i in range(120)]
        table.append((3 * k, " ".join(words)))
        if k % 3 == 0:
            table.append((3 * k + 1, " ".join(words)))
        if k % 4 == 0:
            table.append((3 * k + 2, " ".join(words[:-4]) + f" mail u{k}@x.org"))
    table.append((999, "too short"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in table], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = [(i, t) for i, t in table if len(t.split()) >= 50]
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in kept for w in [t.split()]}
    link = lambda i, j: 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    left = [(i, t) for i, t in kept if not any(j < i and j // 3 == i // 3 and link(i, j) for j, _ in kept)]
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert set(got) <= {i for i, _ in left} and len(got) > 0.4 * len(left)  # Poisson of mean one leaves some out
    for i, t in left:
        if i in got:
            assert got[i] == sp.encode(re.sub(r"u\d+@x\.org", "<EMAIL>", t))
