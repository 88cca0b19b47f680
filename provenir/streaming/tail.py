"""Following an append-only chain. Ours: the log is read as files of rows and verified as it grows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from provenir.functions.canon import GENESIS, event_hash

CHAIN = "chain string, seq long, kind string, subject string, body string, at string, prev_hash string, hash string"


def read_chain(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(CHAIN.replace("at string", "`at` string")).parquet(folder)


def follow(chain: DataFrame) -> DataFrame:
    """(chain, seq, problem) of a stream of chain rows, each batch against the last row seen of its chain: altered (the row
    does not have its hash), late (a number that the chain has passed; it changes nothing), gap, broken.

    Rows are hashed by the engine; a batch is compared as columns, shifted by one; the state is one number and one hash."""
    made = event_hash(F.col("seq"), F.col("kind"), F.col("subject"), F.col("body"), F.col("at"), F.col("prev_hash"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, digest = state.get if state.exists else (0, GENESIS)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        late = rows["seq"] <= seq
        new = rows[~late]
        before, last = new["seq"].shift(fill_value=seq), new["hash"].shift(fill_value=digest)
        gap = new["seq"] != before + 1
        marks = {"altered": rows[~rows["good"]], "late": rows[late], "gap": new[gap], "broken": new[~gap & (new["prev_hash"] != last)]}
        if len(new):
            seq, digest = int(new["seq"].iloc[-1]), new["hash"].iloc[-1]
        state.update((seq, digest))
        yield pd.concat([pd.DataFrame({"chain": key[0], "seq": x["seq"], "problem": name}) for name, x in marks.items()])

    own = chain.select("chain", "seq", "prev_hash", "hash", F.coalesce(made == F.col("hash"), F.lit(False)).alias("good"))
    return own.groupBy("chain").applyInPandasWithState(step, "chain string, seq long, problem string", "seq long, hash string", "append", GroupStateTimeout.NoTimeout)
