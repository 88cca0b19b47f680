"""The pipeline over the smallest tables, against brute force stage by stage."""

import hashlib
import os

import pytest

import corpus_pipeline
from provenir.llm import bpe, mixing, toxicity
from tests.llm.test_linededup import plain as without_lines
from tests.llm.test_simhash import components, plain as print_of

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_stages(spark, tmp_path):
    docs, outs = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        outs.append(docs.collect())
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(raw, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in outs[0]} == {r.doc_id for r in raw.collect() if model.score(r.text) < 0.5}

    rows = sorted((r.doc_id, r.text) for r in outs[0])
    left = {i: w for (i, t), w in zip(rows, without_lines(rows).values()) if w or not t.strip()}
    assert {r.doc_id: r.text.split() for r in outs[1]} == left

    prints = {r.doc_id: print_of(r.text, 5) for r in outs[1]}
    roots = components(set(prints.values()))
    first = {}
    for i, v in sorted(prints.items()):
        first.setdefault(roots[v], i)
    assert sorted(r.doc_id for r in outs[2]) == sorted(first.values())

    want = []
    for r in mixing.pareto_mix(spark.read.parquet(f"{tmp_path}/2")).collect():
        want += [r.doc_id] * r.copies
    assert sorted(r.doc_id for r in outs[3]) == sorted(want)

    import public_tokenizers

    encoder = bpe.Encoder(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    assert sorted((r.doc_id, bytes(r.ids)) for r in outs[4]) == sorted((r.doc_id, encoder.encode(r.text)) for r in outs[3])


def test_ids_are_held_against_the_text(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Some text, é 漢 😀\n\n twice", "s"), (2, "", "s"), (3, None, None)], "doc_id long, text string, source string")
    for r in corpus_pipeline.encode(spark, docs, SF).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    real = corpus_pipeline.queries.encoder(spark)
    monkeypatch.setattr(real, "decode", lambda ids: ids)  # as if the ids stood for other bytes
    monkeypatch.setattr(corpus_pipeline.queries, "encoder", lambda spark: real)
    with pytest.raises(Exception, match="do not decode"):
        corpus_pipeline.encode(spark, docs, SF).collect()


def test_nulls_ties_repeats_and_clashing_names(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and a column that operators use themselves."""
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = [(1, f"{passage} one", "en", "s", 5), (2, f"{passage}\nand more of its own here", None, "s", None), (3, passage, "en", None, 5), (4, None, None, None, None), (5, "", "en", "s", 0), (6, " \n ", "en", "t", 3), (None, "no id at all " * 3, "en", "t", 1)]
    rows += [(7, "word " * 30_000, "en", "long", 1), (8, "same row", "en", "t", 8), (8, "same row", "en", "t", 8), (9, "same row", "en", "u", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'own' as Kept", "1 as p")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, str(tmp_path)).checkpoint()
        assert kept.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, (1, 2, 4, None, 7, 8)))
    assert "shared1 " not in kept.where("doc_id = 2").first().text and "of its own here" in kept.where("doc_id = 2").first().text
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in got]
    assert set(ids) <= {1, 2, 4, None, 7, 8} and len(ids) >= 4 and all(ids.count(i) <= 3 for i in set(ids))
    assert {r.n_tokens for r in got if r.doc_id == 4} <= {0} and all(r.decoded_sha256 for r in got)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
