"""Quality rules: base measures of a text, and cross-document line frequency.

Lines are normalised (letters as lower case, digits as 0, white space as one space) and hashed; for each host the
distinct documents that hold a line are counted, exact copies of a document as one. A line over the host's limit is
boilerplate and is removed, and a document that keeps too few words or too small a share of them is rejected.

Everything is DataFrame functions. Words and windows are arrays within a row, so nothing but line hashes is shuffled.

Defined results: a null text has no words and fails the base rules; a null host is a host of its own; lines without a
word are not counted; repeated rows are one document in counts and get equal results; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.llm.common import WORD, carried, dealt_join, prefixed, prepare, quoted, salted_join, written

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

#: A line is removed if more than LEAST_COPIES documents of the host, and more than this share of them, hold it.
LEAST_COPIES, LINE_SHARE = 20, 0.005
#: A document is depleted if fewer words than this remain, or a smaller share of them.
LEAST_WORDS, LEAST_SHARE = 10, 0.3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def repeated_words(words: Column, size: int = 8) -> Column:
    """Words in windows of that many words which the text has twice or more, first ones included."""

    def covered(sorted_: Column) -> Column:
        n = F.size(sorted_)
        twice = F.filter(sorted_, lambda x, i: ((i > 0) & (F.get(sorted_, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(sorted_, i + 1)["h"] == x["h"])))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        step = lambda done, i: F.struct((done["sum"] + F.least(F.lit(size), i + size - done["end"])).alias("sum"), (i + size).alias("end"))
        start = F.struct(F.lit(0).alias("sum"), F.lit(-size).alias("end"))
        return F.aggregate(places, start, step, lambda done: done["sum"])

    def of(words: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, size)))
        keyed = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(keyed(h), covered)))

    return let(words, lambda w: F.when(F.size(w) > size, of(w)).otherwise(F.lit(0))).cast("long")


def base_measures(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    words = words_of(text)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(line), "123456789", "000000000"), SPACE + "+", " "))


def removed_words(docs: DataFrame, least: int = LEAST_COPIES, share: float = LINE_SHARE) -> DataFrame:
    """(host, content, removed, frequent, n): words in lines over the host's limit, those lines' hashes and the number of
    equal documents, for documents (host, content, text) that have some.

    Copies of a document, and a line's holders, are summed up where they are read. A host's frequent lines are few (lines
    of more than a share of its documents, so at most a document's lines over that share), and so is the side that a
    frequent line's very many holders are dealt out against."""
    lines = docs.select("host", "content", F.explode(F.split("text", "\n", -1)).alias("line"))
    each = lines.select("host", "content", F.xxhash64(normalised(F.col("line"))).alias("line"), F.regexp_count("line", F.lit(WORD)).alias("words")).where("words > 0")
    # Repeated rows count the same lines again: times over the rows of the content. Both are stored, as they are read twice.
    held = written(each.groupBy("host", "content", "line").agg(F.max("words").alias("words"), F.count("*").alias("times")))
    copies = written(docs.groupBy("host", "content").agg(F.count("*").alias("copies")))
    counts = held.groupBy("host", "line").agg(F.count("*").alias("n"))
    hosts = copies.groupBy("host").agg((F.count("*") * share).alias("limit"))
    frequent = salted_join(counts.where(F.col("n") > least), hosts, "host", F.col("line")).where("n > limit").select("host", "line", "n").checkpoint()
    gone = dealt_join(held, frequent, ["host", "line"], F.col("content"), "inner").groupBy("host", "content").agg(F.sum(F.col("words") * F.col("times")).alias("removed"), F.collect_set("line").alias("frequent"))
    return gone.join(copies, ["host", "content"]).select("host", "content", (F.col("removed") / F.col("copies")).cast("long").alias("removed"), "frequent", F.col("copies").alias("n"))


def without_lines(text: Column, frequent: Column) -> Column:
    """A text without its lines of these hashes; as it is where there are none."""
    stays = lambda x: ~F.array_contains(frequent, F.xxhash64(normalised(x)))
    return F.when(frequent.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n", -1), stays), "\n"))


def quality_rules(docs: DataFrame, host: str = "source", least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """docs (doc_id, text, a host, any others) with the base measures, base_failed, removed_words, kept and text_left, the text
    without its lines over the limit."""
    prepare(docs.sparkSession)
    added = {"host": F.coalesce(F.concat(F.lit("h"), quoted(f"in_{host}")), F.lit("n")), "content": F.xxhash64(F.coalesce("in_text", F.lit(""))), "text": F.coalesce("in_text", F.lit(""))}
    own = docs.select(*prefixed(docs)).withColumns(added)
    removed = removed_words(own.select("host", "content", "text")).checkpoint()
    base = base_measures(F.col("text"))
    measured = own.select("host", "content", *[quoted(f"in_{c}") for c in docs.columns], *[v.alias(k) for k, v in base.items()])
    # A text of very many copies is dealt to several tasks by doc_id.
    out = dealt_join(measured, removed, ["host", "content"], F.col("in_doc_id")).withColumn("removed", F.coalesce("removed", F.lit(0)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed")
    depleted = (F.col("removed") > 0) & ((left < least_words) | (left < least_share * F.col("n_words")))
    made = {**{k: F.col(k) for k in base}, "base_failed": failed, "removed_words": F.col("removed"), "kept": ~failed & ~depleted, "text_left": without_lines(F.col("in_text"), F.col("frequent"))}
    return out.select(*carried(docs, made), *[v.alias(k) for k, v in made.items()])
