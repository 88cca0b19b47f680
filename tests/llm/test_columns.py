"""Input columns whose names clash with the operators' own, in any case, come through every operator as they were."""

import pytest
from pyspark.sql import functions as F

from provenir.llm import bpe, importance, linededup, matroska, mixing, quality, secrets, simhash, toxicity, warc

NAMES = ("Kept", "Findings", "_salt", "_deal", "_shares", "_packet", "Score", "BLOB", "Log_Weight", "Removed_Lines", "Text_Left", "N_Words", "Size", "TARGET", "tie", "group", "place", "key", "p", "q", "w", "x", "v", "host", "content", "in_text", "a`b", "a.b", "id")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "one two three\nfour five\nsix\nseven", "s"), (2, "password=abcdef and more words here", "t"), (3, None, None), (None, "", "s"), (1, "one two three\nfour five\nsix\nseven", "s")]
    given = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return given.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES])


LABELS = "doc_id long, toxic int"
RUN = {
    "op1": lambda spark, d: mixing.pareto_mix(d),
    "op2": lambda spark, d: simhash.simhash_components(d),
    "op2_dedup": lambda spark, d: simhash.simhash_dedup(d),
    "op2_near": lambda spark, d: simhash.near_dedup(d),
    "op3": lambda spark, d: matroska.packets(d.withColumn("media", matroska.media(F.col("text")))),
    "op4": lambda spark, d: importance.importance_resample(d, d, 0.5, buckets=64),
    "op5": lambda spark, d: toxicity.toxicity_scores(d, spark.createDataFrame([(1, 0), (2, 1)], LABELS)),
    "op6": lambda spark, d: warc.round_trip(d.withColumnsRenamed({"doc_id": "page_id", "text": "html", "source": "url"})),
    "op7": lambda spark, d: secrets.secret_scan(d)[0],
    "op8": lambda spark, d: quality.quality_rules(d),
    "op9": lambda spark, d: d.select("*", bpe.n_tokens(bpe.ByteBpe(spark, _vocabulary(), ".").encode(F.col("text"))).alias("n_tokens")),
    "op10": lambda spark, d: linededup.line_dedup(d),
}
#: Operators that return columns of their own alone.
OWN = ("op2", "op6")
ROWS = {"op2_dedup": 3, "op2_near": 3}


def _vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("name", RUN)
def test_clashing_names(spark, docs, name):
    got = RUN[name](spark, docs)
    lower = [c.lower() for c in got.columns]
    assert len(set(lower)) == len(lower)
    rows = got.collect()
    assert name not in ROWS or len(rows) == ROWS[name]
    if name not in OWN:
        assert {c.lower() for c in docs.columns} <= set(lower) and len(rows) >= 3
        kept = [c for c in NAMES if c in got.columns]
        assert len(kept) >= len(NAMES) - 6
        assert all(r[c] == f"own {c}" for r in rows for c in kept)


def test_malformed_media_give_nulls_or_value_errors(spark):
    import random

    rng, good = random.Random(1), matroska.mux(bytes(range(256)) * 200)
    spoiled = [bytes(b) for b in (bytearray(good) for _ in range(400))]
    cases = []
    for content in spoiled:
        b = bytearray(content)
        for _ in range(rng.randrange(1, 6)):
            b[rng.randrange(min(len(b), 400))] = rng.randrange(256)
        cases.append(bytes(b[: rng.randrange(len(b))] if rng.random() < 0.3 else b))
    cases += [b"", b"\x1a", matroska.element(matroska.SEGMENT, matroska.element(matroska.CUES, matroska.element(matroska.POINT, b""))), matroska.element(matroska.SEGMENT, matroska.element(matroska.CLUSTER, matroska.element(matroska.GROUP, b"")))]
    cases += [matroska.element(matroska.SEGMENT, matroska.element(matroska.TRACKS, matroska.element(matroska.ENTRY, b""))), matroska.element(matroska.SEGMENT, matroska.element(matroska.CLUSTER, matroska.element(matroska.SIMPLE, b"\x81\0\0\x82\x05\xff\xff")))]
    bad = 0
    for content in cases:
        try:
            matroska.parse(content)
        except ValueError:
            bad += 1
    assert bad > 50
    media = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases[-40:])] + [(-1, bytearray(good)), (-2, None)], "i int, media binary").select("i", matroska.features(F.col("media")).alias("f"))
    got = {r.i: r.f for r in media.collect()}
    assert got[-1].payload_bytes == 51200 and got[-2] is None and got[39] is None
