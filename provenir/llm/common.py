"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenir.session import shared_dir, ship

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Arrow hands Python at most this many bytes of texts at once, however long single texts are.
ARROW_BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that every operator relies on: executors can import this package, batches to Python are
    bounded in bytes, and a checkpoint folder exists (the cluster's own is kept; one is set only where none is)."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    shared_dir(spark)
    return spark


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def prefixed(docs: DataFrame) -> list[Column]:
    """All columns of docs as in_<name>: nothing that an operator adds begins so, and none is lost or ambiguous."""
    return [quoted(c).alias(f"in_{c}") for c in docs.columns]


def carried(docs: DataFrame, made: Iterable[str]) -> list[Column]:
    """The prefixed columns under their own names, but for those that the operator makes; names compare without case, as
    Spark's do."""
    own = {m.lower() for m in made}
    return [quoted(f"in_{c}").alias(c) for c in docs.columns if c.lower() not in own]


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder below the shared one, for what lives as long as the session: it is removed when that ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return path


def written(df: DataFrame) -> DataFrame:
    """df written once as Parquet to the shared folder and read again: a cut in lineage that any executor can read."""
    path = f"{scratch(df.sparkSession, 'tables')}/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_count(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(*cols: Column) -> Column:
    """MD5 of the columns, each with its length, so that different rows have different keys; null is not empty."""
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), c)) for c in cols]
    return F.md5(reduce(lambda a, b: F.concat(a, F.lit("|"), b), parts))


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the first 13 hex digits of an MD5 key."""
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def prefix_cut(rows: DataFrame, goals: DataFrame, levels: int = 2) -> DataFrame:
    """Where to cut each group's rows, ordered by (x, tie), so that the weights before the cut come nearest to a goal.

    rows: group string, x double in [0, 1], tie string, w long. goals: group, goal double (one row a group).
    Returns group, cut_x, cut_tie: a row is before the cut if (x, tie) <= (cut_x, cut_tie); cut_x is -1 if none is.
    Rows with equal (x, tie) stay together. A group is never brought to one task: each level sums weights by 4,096
    intervals of x (partial sums before the shuffle), finds the interval that holds the goal, and keeps only its
    rows; the last holds about rows / 4096**levels of the group, which alone are ordered.
    """
    inside, before = rows, goals.withColumn("before", F.lit(0.0))
    for level in range(1, levels + 1):
        b = F.floor(F.col("x") * float(4096**level)).cast("long")
        inside = inside.withColumn("b", b)
        sums = inside.groupBy("group", "b").agg(F.sum("w").alias("bw"))
        run = Window.partitionBy("group").orderBy("b")
        found = (
            sums.join(before, "group")
            .withColumn("after", F.col("before") + F.sum("bw").over(run.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("group", "goal")
            .agg(F.min(F.when(F.col("after") >= F.col("goal"), F.struct("b", (F.col("after") - F.col("bw")).alias("before")))).alias("at"), F.max(F.struct("b", (F.col("after") - F.col("bw")).alias("before"))).alias("last"))
            .withColumn("at", F.coalesce("at", "last"))
            .select("group", "goal", F.col("at.b").alias("b"), F.col("at.before").alias("before"))
        )
        inside = inside.join(found.select("group", "b"), ["group", "b"], "left_semi")
        before = found.drop("b")
    units = inside.groupBy("group", "x", "tie").agg(F.sum("w").alias("w"))
    run = Window.partitionBy("group").orderBy("x", "tie")
    ends = (
        units.join(before, "group")
        .withColumn("after", F.col("before") + F.sum("w").over(run.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("group")
        .agg(
            F.max(F.when(2 * F.col("goal") > 2 * F.col("after") - F.col("w"), F.struct("x", "tie"))).alias("cut"),
            F.min("x").alias("first_x"),
        )
    )
    # Where nothing of the last interval is taken, everything before it is: the cut lies just before its first row.
    return ends.select("group", F.coalesce("cut.x", "first_x").alias("cut_x"), F.coalesce("cut.tie", F.lit("")).alias("cut_tie"))


def is_before_cut(x: Column, tie: Column) -> Column:
    return (x < F.col("cut_x")) | ((x == F.col("cut_x")) & (tie <= F.col("cut_tie")))


def dealt_join(rows: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "left") -> DataFrame:
    """rows joined with small (one row a key, with n: its rows in rows), a frequent key dealt to several tasks by spread.

    A key with more than one task's share of the rows that small counts (their number over the shuffle's partitions) is dealt
    out in four pieces a share, so that pieces fall evenly on tasks. There are fewer such keys than partitions, so they may
    be broadcast, and small grows by some five rows a partition. small is read three times: it should be stored. n is dropped."""
    parts = max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = small.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = small.where(F.col("n") * parts > total).select(*keys, F.ceil(F.col("n") * 4 * parts / F.lit(max(total, 1))).cast("int").alias("_shares"))
    deal = F.when(F.col("_shares").isNotNull(), F.pmod(F.xxhash64(spread), F.col("_shares"))).otherwise(0).cast("int")
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_deal", deal).drop("_shares")
    right = small.join(F.broadcast(hot), keys, "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1))).drop("_shares", "n")
    return left.join(right, [*keys, "_deal"], how).drop("_deal")


def salted_join(rows: DataFrame, small: DataFrame, key: str, spread: Column, salts: int = 32) -> DataFrame:
    """rows left-joined with a table of few rows, one a key; every key is dealt to several tasks by spread."""
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [key, "_salt"], "left").drop("_salt")
