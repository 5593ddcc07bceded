"""The pipeline, stage by stage, on one small folder."""

import importlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from test_near import heads
from webstrata.llm import langid, quality


def test_stages_follow_each_other(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema, seen = docs.schema, [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], folder)
        out.write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < 4:
            assert [(f.name, f.dataType) for f in seen[-1].schema] == [(f.name, f.dataType) for f in schema], name
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in seen]
    assert ids[1] == {
        r.doc_id for r in quality.assess(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1").collect()
    }
    assert ids[2] == {r.doc_id for r in langid.identify(seen[1]).where("lang_pred <> 'und' AND score >= 0.5").collect()}
    # The near-duplicate stage keeps the least id of each group of shingle sets at 0.8 and more.
    kept = heads([(r.doc_id, r.text) for r in seen[2].select("doc_id", "text").collect()])
    assert sorted(ids[3]) == kept and seen[3].count() == len(kept)
    assert ids[4] <= ids[3] and ids[5] == ids[4]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r.text for r in seen[4].select("text").collect()]
    tokens = sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in texts)
    packed = seen[5].toPandas()
    assert packed.length.sum() == tokens
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    assert packed.sequence_id.nunique() <= -(-tokens // 2048) + 1
    whole = corpus_pipeline.run(spark, folder).toPandas()
    assert len(whole) == len(packed) and np.isclose(whole.length.sum(), tokens)


def test_stages_take_odd_documents(spark, docs, folder):
    frame = docs([(1, None, None, None), (2, "", "en", "a"), (2, "", "en", "a"), (None, "word " * 300, "en", None)])
    for rows in (frame, frame.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, rows, folder).count() >= 0


def test_registered():
    assert entry.queries()["pipeline"] is importlib.import_module("corpus_pipeline").run
    assert len([q for q in entry.queries() if q.startswith("op")]) == 13
