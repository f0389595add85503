"""An annotation sample that takes aspects in order, each sentence once.

One aspect after the other takes its share of disagreements, then agreements, the
tickers in turn, and no sentence that an aspect before it has taken.  Here all
aspects propose at once and give up what an earlier one holds, round after
round, until no proposal changes: then each aspect's picks are those it would
have made in its turn, as the first can't change any more after one round, the
second after two, and so on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scratch import written


def _quota(per_aspect: int, share: float, disagreeing: str = "disagreeing"):
    wanted = F.least(F.col(disagreeing), F.lit(round(per_aspect * share)))
    return F.when(F.col("agree"), per_aspect - wanted).otherwise(wanted)


def shortlist(candidates: DataFrame, aspects: list[str], per_aspect: int, share: float, seed: str) -> DataFrame:
    """The candidates that can be picked at all: (aspect, agree, ticker, chunk_id, draw, order, quota).

    A group takes at most ``per_aspect`` sentences and loses at most
    ``per_aspect`` to each other aspect, so of each ticker only the first
    ``per_aspect`` * aspects by draw matter."""
    order = F.create_map(*[F.lit(x) for i, a in enumerate(aspects) for x in (a, i)])
    rows = candidates.where(F.col("aspect").isin(aspects)).select("aspect", "agree", "ticker", "chunk_id").distinct()
    sizes = rows.groupBy("aspect").agg(F.count_if(~F.col("agree")).alias("disagreeing"))
    drawn = rows.withColumn("draw", F.md5(F.concat_ws("/", F.lit(seed), F.col("chunk_id").cast("string"), "aspect")))
    place = F.row_number().over(Window.partitionBy("aspect", "agree", "ticker").orderBy("draw", "chunk_id"))
    first = drawn.withColumn("place", place).where(F.col("place") <= per_aspect * len(aspects)).drop("place")
    quoted = first.join(sizes, "aspect").withColumn("quota", _quota(per_aspect, share)).drop("disagreeing")
    return quoted.withColumn("order", order[F.col("aspect")])


def propose(listed: DataFrame, taken: DataFrame | None) -> DataFrame:
    """Each group's picks, without the sentences that an earlier aspect holds in ``taken``."""
    free = listed
    if taken is not None:
        holder = taken.groupBy("chunk_id").agg(F.min("order").alias("holder"))
        free = listed.join(holder, "chunk_id", "left").where(F.col("holder").isNull() | (F.col("holder") >= F.col("order"))).drop("holder")
    turn = F.row_number().over(Window.partitionBy("aspect", "agree", "ticker").orderBy("draw", "chunk_id"))
    place = F.row_number().over(Window.partitionBy("aspect", "agree").orderBy("turn", "ticker"))
    return free.withColumn("turn", turn).withColumn("place", place).where(F.col("place") <= F.col("quota"))


def stratified_sample(candidates: DataFrame, aspects: list[str], per_aspect: int = 50, disagree_share: float = 0.6, seed: str = "s", batch: int = 50) -> DataFrame:
    """Per aspect ``per_aspect`` sentences, a share of them disagreements: (item_id, batch, aspect, agree, ticker, chunk_id, place).

    ``candidates``: chunk_id, aspect, agree, ticker.  Order inside (aspect,
    agree, ticker) is by md5 of seed, sentence and aspect; the tickers take turns
    in the order of their names.  Aspects come in the order given and share no
    sentence.  If there are fewer disagreements than the share asks for, more
    agreements are wanted instead.  Items are numbered in an order drawn by hash,
    ``batch`` of them together.  Raises if the proposals haven't settled after
    one round an aspect, which can't happen."""
    listed = written(shortlist(candidates, aspects, per_aspect, disagree_share, seed))
    taken, marks = None, None
    for _ in range(len(aspects) + 1):
        now = written(propose(listed, taken).select("aspect", "order", "agree", "ticker", "chunk_id", "place"))
        # a digest of all proposals: equal ones are the same picks
        mark = tuple(now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("aspect", "agree", "chunk_id", "place")), F.lit(0))).first())
        if mark == marks:
            break
        taken, marks = now, mark
    else:
        raise RuntimeError("the proposals did not settle")
    shuffled = F.md5(F.concat_ws("/", F.lit(seed), F.lit("item"), F.col("chunk_id").cast("string"), "aspect"))
    # at most per_aspect * aspects picks are numbered
    i = F.row_number().over(Window.partitionBy(F.lit(seed)).orderBy("shuffled", "chunk_id"))
    numbered = taken.withColumn("shuffled", shuffled).withColumn("i", i)
    item = F.concat(F.lit("S"), F.when(F.col("i") < 1000, F.lpad(F.col("i").cast("string"), 3, "0")).otherwise(F.col("i").cast("string")))
    return numbered.select(item.alias("item_id"), (F.floor((F.col("i") - 1) / batch) + 1).cast("int").alias("batch"), "aspect", "agree", "ticker", "chunk_id", "place")
