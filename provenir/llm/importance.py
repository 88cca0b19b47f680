"""Quality by importance resampling.

Two generative models over hashed n-grams, one of the target texts and one of the raw corpus, are bags of unigrams and
bigrams in BUCKETS buckets with add-one smoothing. A document's importance weight is the ratio of its probabilities under
the two, and a sample without replacement in proportion to the weights is drawn by Gumbel top-k: the k documents of
greatest log weight plus Gumbel noise. The raw model counts all documents, the target model all target texts it is given
(of labelled documents, labelled_target takes at most TARGET_ROWS); the noise is a hash of the document, so reruns agree.
The logarithm of a whole text's ratio is a sum over its grams, far wider than the noise where texts are long: the sample
then is close to the top k by weight, as in the published method.

Defined results: null and empty texts have log weight 0; rows equal in doc_id and text share one draw, and are taken or left
together; with no target texts all log weights are 0 and the sample is uniform; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.llm.common import carried, is_before_cut, prefix_cut, prefixed, prepare, quoted, text_key, uniform, written

BUCKETS = 1 << 14
#: Labelled documents that the target model is fitted on, at most.
TARGET_ROWS = 50_000
_TOKENS = re.compile(r"\w+|[^\w\s]").findall
_STEP = np.uint64(0x9E3779B185EBCA87)


class _Hashes(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word.encode())
        return out


_hashes = _Hashes()


def grams_of(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of a text's unigrams and bigrams: words and marks, lower case."""
    h = np.array([_hashes[w] for w in _TOKENS((text or "").lower())], np.uint64)
    pairs = (h[:-1] * _STEP + h[1:]) * _STEP
    return ((np.concatenate([h, pairs]) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Grams by bucket over all rows of texts (text). A task sends a row for each bucket, whatever it has read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(grams_of(x.as_py(), buckets), minlength=buckets)
        at = np.nonzero(total)[0]
        yield pa.record_batch({"bucket": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    rows = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if not target.sum():
        return np.zeros(len(target))
    return np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def log_weight(text: Column, ratio: np.ndarray) -> Column:
    @F.arrow_udf("double")
    def importance(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([float(ratio[grams_of(x.as_py(), len(ratio))].sum()) for x in batch], pa.float64())

    return importance(text)


def labelled_target(docs: DataFrame, labels: DataFrame, most: int = TARGET_ROWS) -> DataFrame:
    """The texts that the target model is fitted on: those of at most so many documents labelled as of good quality (labels:
    doc_id, quality), which are least by a hash of doc_id. So many ids go to all executors, and no text is shuffled."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    chosen = good.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")


def importance_resample(docs: DataFrame, target: DataFrame, share: float, seed: int = 1, buckets: int = BUCKETS, carry: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text, any others) with log_weight, gumbel_key and kept; share is that of rows to keep.

    carry: those of docs' columns that are wanted back (all, if not given). What comes back is written once beside its key,
    so that each text is read twice: for the raw model, and to be weighed."""
    prepare(docs.sparkSession)
    made = ("log_weight", "gumbel_key", "kept")
    ratio = log_ratio(counts(target, buckets), counts(docs, buckets))
    tie = text_key(F.lit(str(seed)), F.col("in_doc_id").cast("string"), F.col("in_text"))
    keyed = docs.select(*prefixed(docs)).withColumns({"lw": log_weight(F.col("in_text"), ratio), "tie": tie})
    wanted = docs if carry is None else docs.select(*map(quoted, carry))
    back = [quoted(f"in_{c}") for c in wanted.columns if c.lower() not in made]
    keyed = written(keyed.select(*back, "tie", "lw", (F.col("lw") - F.log(-F.log(uniform(F.col("tie"))))).alias("g")))
    span = keyed.agg(F.count("*").alias("n"), F.min("g").alias("lo"), F.max("g").alias("hi")).first()
    width = max((span["hi"] or 0.0) - (span["lo"] or 0.0), 1e-9)
    x = (F.lit(span["hi"] or 0.0) - F.col("g")) / F.lit(width)
    rows = keyed.select(F.lit("all").alias("group"), x.alias("x"), "tie", F.lit(1).cast("long").alias("w"))
    goals = docs.sparkSession.createDataFrame([("all", float(round(share * span["n"])))], "group string, goal double")
    cut = prefix_cut(rows, goals, levels=3).first()
    kept = is_before_cut(x, F.col("tie")) if cut else F.lit(False)
    out = keyed.withColumns({"cut_x": F.lit(cut["cut_x"] if cut else 0.0), "cut_tie": F.lit(cut["cut_tie"] if cut else "")})
    return out.select(*carried(wanted, made), F.col("lw").alias("log_weight"), F.col("g").alias("gumbel_key"), kept.alias("kept"))
