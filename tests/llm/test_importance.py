import math

import numpy as np
from pyspark.sql import functions as F

from provenir.llm import importance


def test_weights_and_top_k_against_brute_force(spark, nasty):
    extra = spark.createDataFrame([(100 + i, f"good fine words {i}" if i % 2 else f"$$$ junk ### {i}") for i in range(60)], "doc_id long, text string")
    docs = nasty.select("doc_id", "text").unionByName(extra)
    target = extra.where("doc_id % 2 = 1")
    got = importance.importance_resample(docs, target, 0.5, buckets=512).collect()
    count = lambda rows: sum((np.bincount(importance.grams_of(r.text, 512), minlength=512) for r in rows), np.zeros(512, np.int64))
    ratio = importance.log_ratio(count(target.collect()), count(docs.collect()))
    assert all(math.isclose(r.log_weight, ratio[importance.grams_of(r.text, 512)].sum(), abs_tol=1e-9) for r in got)
    keys = sorted((r.gumbel_key for r in got), reverse=True)
    kept = [r.gumbel_key for r in got if r.kept]
    k = round(0.5 * len(got))
    assert sorted(kept, reverse=True) == keys[: len(kept)] and abs(len(kept) - k) <= 1


def test_repeated_rows_share_a_draw(spark):
    docs = spark.range(50).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b").alias("text"))
    assert len({r.kept for r in importance.importance_resample(docs, docs, 0.4).collect()}) == 1


def test_noise_samples_equal_documents_evenly(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("all alike").alias("text"))
    kept = [r.doc_id for r in importance.importance_resample(docs, docs, 0.3).where("kept").collect()]
    assert len(kept) == 600 and 200 < sum(i < 1000 for i in kept) < 400


def test_empty(empty, nasty):
    assert importance.importance_resample(empty, empty, 0.5).count() == 0
    assert importance.importance_resample(nasty, empty, 1.0).where("kept").count() == nasty.count()
    assert importance.importance_resample(nasty, empty, 0.0).where("kept").count() == 0


def test_the_target_is_bounded_and_no_text_is_shuffled(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("c").alias("Kept"))
    labels = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, 1).otherwise(0).alias("quality"))
    assert importance.labelled_target(docs, labels).count() == 200
    few = importance.labelled_target(docs, labels.unionByName(labels), most=7)
    assert few.count() == 7 and few.where("doc_id % 2 = 1").count() == 0
    assert sorted(few.collect()) == sorted(importance.labelled_target(docs, labels, most=7).collect())
    assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()
    narrow = importance.importance_resample(docs, few, 0.5, carry=["doc_id", "Kept"])
    assert narrow.columns == ["doc_id", "log_weight", "gumbel_key", "kept"] and narrow.where("kept").count() == 250


def test_weights_against_plain_models(spark):
    """Models and weights from tokens, hashes and sums written out in plain integers and floats."""
    import re
    from collections import Counter

    import xxhash

    texts = ["Good fine words, good ones!", "good fine", "junk $$$ ### Junk", "", None, "é漢 words_x 12 good", "fine " * 50]
    docs = spark.createDataFrame(list(enumerate(texts * 3)), "doc_id long, text string")
    target = docs.where("doc_id in (0, 1, 5)")

    def grams(text):
        tokens = re.findall(r"[^\W]+|[^\w\s]", (text or "").lower())
        hashes = [xxhash.xxh64(t.encode("utf-8")).intdigest() for t in tokens]
        pairs = [((a * 0x9E3779B185EBCA87 + b) * 0x9E3779B185EBCA87) % (1 << 64) for a, b in zip(hashes, hashes[1:])]
        return [(h >> 32) % 128 for h in hashes + pairs]

    raw, good = (Counter(g for t in some for g in grams(t)) for some in (texts * 3, [texts[0], texts[1], texts[5]]))
    ratio = lambda g: math.log((good[g] + 1) / (sum(good.values()) + 128)) - math.log((raw[g] + 1) / (sum(raw.values()) + 128))
    for r in importance.importance_resample(docs, target, 0.5, buckets=128).collect():
        assert math.isclose(r.log_weight, sum(map(ratio, grams(r.text))), abs_tol=1e-9)
