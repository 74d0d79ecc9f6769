"""Exact duplicates by distributed radix partitioning, most significant bytes first.

All texts start in groups by their number of bytes. Each round splits every group by the texts' next
bytes, one digit of the radix: 64 bytes, then 16 times as many a round, 1 MiB at most. A text that is
alone in its group has no duplicate and leaves; so does a group whose texts have ended: what shared a
group until its end is equal, byte by byte. Nothing is compared by a digest.

A round counts its groups by an aggregation, which Spark combines before it shuffles, and joins the
rows with the groups that hold more than one; hot groups are the join's long side, which Spark splits.
The join is by sorting at every size, so each text moves once, in the first round, and again only in
rounds in which it still has company.
Rounds grow with the logarithm of the longest repeated text up to 1 MiB, and then with its MiB; only
rows that still have company are read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import stored

#: Bytes of the first digit, growth of a digit from round to round, bytes of a digit at most.
FIRST, GROWTH, MOST = 64, 16, 1 << 20
_ALL = 2**31 - 1


def exact_duplicates(docs: DataFrame, carried: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and the `carried` columns of every row of `docs` (doc_id, text).

    Rows whose texts are the same bytes are a group; null counts as empty, so null and empty texts
    are one group. The row with the largest doc_id stays (null ids count as the smallest; keep_id is
    null where a group has no other). Rows of a group that repeat that doc_id are told apart: one of
    them stays, which one is left open. Rows that repeat a doc_id with different texts are rows of
    different groups. Texts may be of any length. Other columns are not looked at, whatever their
    names. An empty table gives no rows.

    carried: columns of `docs` by name that go along with each row, such as a digest of the text.
    """
    carried = carried or {}
    rest = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    also = F.struct(*(c.alias(name) for name, c in carried.items())) if carried else F.lit(None).cast("int")
    state = docs.select(F.col("doc_id"), also.alias("also"), rest.alias("rest")).withColumn("size", F.length("rest")).withColumn("grp", F.col("size").cast("long"))
    done, start, width, longest, number = None, 0, FIRST, 1, 0
    while longest is not None and (number == 0 or longest > start):
        state = state.withColumn("digit", F.substring("rest", 1, width))
        counted = state.groupBy("grp", "digit").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id")).filter("n > 1")
        # numbers are given once, in a table, so that they stay whatever is read again
        groups = stored(counted.withColumn("class", F.monotonically_increasing_id()), "radix-groups")
        on = F.col("f.digit") == F.col("g.digit")
        both = state.alias("f").join(groups.alias("g").hint("merge"), on & (F.col("f.grp") == F.col("g.grp")), "left")
        goes_on = F.col("g.n").isNotNull() & (F.col("f.size") > start + width)
        state = stored(both.select(
            "f.doc_id", "f.also", "f.size", F.col("g.class").alias("grp"), F.coalesce("g.n", F.lit(1)).alias("group_size"), F.when(F.col("g.n").isNull(), F.col("f.doc_id")).otherwise(F.col("g.keep_id")).alias("keep_id"),
            F.monotonically_increasing_id().alias("row"), F.when(goes_on, F.substring("f.rest", width + 1, _ALL)).alias("rest")), "radix-rows")
        ended = state.filter("rest is null").drop("rest").withColumn("round", F.lit(number))
        done = ended if done is None else done.unionByName(ended)
        state = state.filter("rest is not null").select("doc_id", "also", "rest", "size", "grp")
        start, width, number = start + width, min(width * GROWTH, MOST), number + 1
        longest = state.agg(F.max("size")).first()[0]
    best = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # one row of those that repeat the id that stays
    again = done.filter(best & (F.col("group_size") > 1)).groupBy("round", "grp").agg(F.count("*").alias("n"), F.min("row").alias("first")).filter("n > 1").select("round", "grp", "first")
    if again.isEmpty():
        done = done.withColumn("kept", best)
    else:
        done = done.join(stored(again, "radix-again"), ["round", "grp"], "left").withColumn("kept", best & (F.col("first").isNull() | (F.col("first") == F.col("row"))))
    return done.select("doc_id", "keep_id", "group_size", "kept", *(F.col("also").getField(name).alias(name) for name in carried))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; see exact_duplicates."""
    found = exact_duplicates(docs, {"row": F.struct(*(F.col(f"`{c}`") for c in docs.columns))})
    return found.filter("kept").select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    """exact_duplicates with text_sha256 of each text (null: the empty text)."""
    return exact_duplicates(docs, {"text_sha256": F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)})
