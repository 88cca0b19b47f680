"""Mixing sources to target weights by Pareto order sampling.

Each source gets a share of the corpus's words by weight. Within a source a document of weight v is worth rate * v copies,
MAX at most, the rate such that the copies' words sum to the source's target (so what is over for heavy documents goes to
lighter ones). The whole part is certain, and the rest is its inclusion probability p for one more copy. Documents
are ranked by [u / (1 - u)] / [p / (1 - p)] with u uniform from a hash of the row, and taken in this order until the
words taken come nearest to what the certain copies leave of the target: a sample of fixed size (in words) with unequal
probabilities.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a null weight or one that is
not positive is 1, and weights are rounded to a quarter of a power of two within 2**-16 and 2**16, so that a source has
at most 129 of them; rows equal in doc_id, text and weight share one draw, hence one decision; an empty table gives an
empty one; columns other than those named are carried along, and are kept apart from the operator's own by a prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenir.llm.common import carried, is_before_cut, prefix_cut, prefixed, prepare, quoted, salted_join, text_key, uniform, words_count


def source_targets(sizes: DataFrame, weights: Column, max_copies: int) -> DataFrame:
    """Targets by water-filling: min(max_copies * size, weight * level), the level such that they sum to all sizes.

    sizes: group, name (source), size; one row a source. weights: column over these and rn (1 for the first source by
    code point, null last). The windows run over one row a source, after the corpus has been summed."""
    everything = Window.partitionBy()
    ordered = sizes.withColumn("rn", F.row_number().over(Window.orderBy(F.col("name").asc_nulls_last())))
    ordered = ordered.withColumn("weight", weights.cast("double")).withColumn("cap", (max_copies * F.col("size")).cast("double"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rn").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(F.col("size")).over(everything).cast("double")
    level = (left - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    flagged = ordered.withColumn("all", left).withColumn("capped", F.col("cap") <= level * F.col("weight"))
    free = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    level = (F.col("all") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))) / free
    return flagged.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight"))).select("group", "size", "target")


def inclusion_rates(classes: DataFrame, max_copies: int) -> DataFrame:
    """(group, size, target, rate) of classes (group, size, target, v, words), a row for each weight v of a source: the rate
    at which min(max_copies, rate * v) copies of all words make the target; null where all are at max_copies."""
    per, most = Window.partitionBy("group"), float(max_copies)
    above = per.orderBy(F.col("v").desc()).rowsBetween(Window.unboundedPreceding, -1)
    worth = F.col("words") * F.col("v")
    rest = F.sum(worth).over(per) - F.coalesce(F.sum(worth).over(above), F.lit(0.0))
    rate = F.try_divide(F.col("target") - most * F.coalesce(F.sum("words").over(above), F.lit(0.0)), rest)
    full = F.coalesce(rate * F.col("v") >= most, F.lit(False))
    flagged = classes.withColumn("words", F.col("words").cast("double")).withColumn("full", full)
    taken = most * F.coalesce(F.sum(F.when(F.col("full"), F.col("words"))), F.lit(0.0))
    left = F.nullif(F.sum(F.when(~F.col("full"), worth)), F.lit(0.0))
    return flagged.groupBy("group", "size", "target").agg((F.first("target") - taken).alias("left"), left.alias("worth")).select("group", "size", "target", F.try_divide("left", "worth").alias("rate"))


def pareto_mix(docs: DataFrame, weights: Column | None = None, max_copies: int = 3, importance: str | None = None, seed: int = 1) -> DataFrame:
    """docs (doc_id, text, source, any others) with size, source_size, target and copies.

    weights: a source's weight, by default 1, 2, 3, repeating in order of sources. importance: a column with a
    document's own positive weight within its source; without it all documents of a source are alike."""
    prepare(docs.sparkSession)
    weights = (F.col("rn") - 1) % 3 + 1 if weights is None else weights
    made = ("size", "source_size", "target", "copies")
    own = docs.select(*prefixed(docs))
    tie = text_key(F.lit(str(seed)), F.col("in_doc_id").cast("string"), F.col("in_text"))
    value = quoted(f"in_{importance}").cast("double") if importance else F.lit(1.0)
    level = F.least(F.lit(64), F.greatest(F.lit(-64), F.round(4 * F.log2(F.when(value > 0, value)))))
    v = F.pow(F.lit(2.0), F.coalesce(level, F.lit(0)) / 4)
    own = own.select("*", words_count(F.col("in_text")).alias("w"), tie.alias("tie"), F.coalesce(F.concat(F.lit("s"), "in_source"), F.lit("n")).alias("group"), v.alias("v"))

    # The only thing kept of a row is what the draw needs: a few dozen bytes, not the text.
    narrow = own.select("group", F.col("in_source").alias("name"), "tie", "w", "v").checkpoint()
    classes = narrow.groupBy("group", "name", "v").agg(F.sum("w").alias("words")).checkpoint()
    targets = source_targets(classes.groupBy("group", "name").agg(F.sum("words").alias("size")), weights, max_copies)
    targets = inclusion_rates(classes.join(targets, "group"), max_copies).checkpoint()
    drawn = _odds(salted_join(narrow, targets, "group", F.col("tie")), max_copies)
    goals = drawn.groupBy("group").agg((F.max("target") - F.sum(F.col("certain") * F.col("w"))).cast("double").alias("goal"))
    cuts = prefix_cut(drawn.where("p > 0").select("group", "x", "tie", "w"), goals)
    known = targets.join(cuts, "group", "left").checkpoint()

    out = _odds(salted_join(own, known, "group", F.col("tie")), max_copies)
    extra = F.coalesce(F.when((F.col("p") > 0) & is_before_cut(F.col("x"), F.col("tie")), 1), F.lit(0))
    return out.select(*carried(docs, made), F.col("w").alias("size"), F.col("size").alias("source_size"), "target", (F.col("certain") + extra).cast("int").alias("copies"))


def _odds(rows: DataFrame, max_copies: int) -> DataFrame:
    """Certain copies, inclusion probability p of one more, and the Pareto rank q as x = q / (1 + q)."""
    most = F.lit(float(max_copies))
    worth = F.when(F.col("size") > 0, F.least(most, F.coalesce(F.col("rate") * F.col("v"), most))).otherwise(0.0)
    rows = rows.withColumn("e", worth).withColumn("certain", F.floor("e").cast("long")).withColumn("p", F.col("e") - F.col("certain"))
    u = uniform(F.col("tie"))
    rows = rows.withColumn("q", F.when(F.col("p") > 0, (u / (1 - u)) * ((1 - F.col("p")) / F.col("p"))))
    return rows.withColumn("x", F.col("q") / (1 + F.col("q")))
