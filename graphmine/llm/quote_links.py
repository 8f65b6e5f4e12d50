"""Chat formatting by quotation linking, in DataFrame functions only.

Quoted lines start with ``>`` marks; their number is the nesting level.  Runs of lines of one level are passages.
Passages and single lines are normalised and hashed, and joined to the paragraphs and lines that messages of the
same conversation wrote themselves: a quote goes to the last earlier message with that key.  The message that
most quoted characters of the lowest linked level come from is the one replied to.  Roots of reply chains are found by
pointer doubling; a conversation in reply order is sorted by (root, turn): threads by their first message, and every
reply after what it answers.

The last earlier message with a key is found per span of ``SPAN`` turns and then over spans, so that a key that a large
conversation repeats in every turn never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphmine.llm import runtime

#: Documented parameter: turns of a span.
SPAN = 1024
#: The mark of a quoted line, and the line that mail programs put above a quote.
QUOTED = r"^[ \t]*>"
MARKS = r"^[ \t]*((?:>[ \t]?)+)"
ATTRIBUTION = r"^On .{1,200} wrote:[ \t]*$"


def normal(text: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """One row for each line that is not blank: ``conv_id, turn, row`` (hash of the text)``, place, level, line`` (without its marks)."""
    lines = messages.select("conv_id", "turn", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("place", "raw"))
    marks = F.regexp_extract("raw", MARKS, 1)
    out = lines.select("conv_id", "turn", "row", "place", F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.regexp_replace("raw", MARKS, "").alias("line"))
    return out.where(F.col("line").rlike(r"\S"))


def passages(lines: DataFrame) -> DataFrame:
    """Runs of neighbouring lines of one level in a message: ``conv_id, turn, level, line`` (joined by spaces).

    Lines are gathered within one message only.
    """
    ordered = W.partitionBy("conv_id", "turn", "row").orderBy("place")
    new = (F.col("place") - F.lag("place").over(ordered) > 1) | (F.col("level") != F.lag("level").over(ordered))
    runs = lines.withColumn("run", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(ordered))
    joined = runs.groupBy("conv_id", "turn", "row", "level", "run").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("all"), F.count("*").alias("n"))
    return joined.where("n > 1").select("conv_id", "turn", "level", F.array_join(F.col("all.line"), " ").alias("line"))


def keys(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, level, key, size`` of all lines and passages of messages with an id and a turn."""
    once = messages.where("conv_id is not null and turn is not null").withColumn("__row", F.xxhash64("text")).dropDuplicates(["conv_id", "turn", "__row"])
    lines = parsed(once)
    every = lines.select("conv_id", "turn", "level", "line").union(passages(lines))
    text = normal(F.col("line"))
    return every.select("conv_id", "turn", "level", F.xxhash64(text).alias("key"), F.length(text).alias("size")).where("size > 0").distinct()


def origins(found: DataFrame) -> DataFrame:
    """``conv_id, turn, level, size, origin`` of all quoted keys that an earlier message wrote itself."""
    quotes = found.where("level > 0")
    own = found.where("level = 0").join(quotes.select("conv_id", "key").distinct(), ["conv_id", "key"], "left_semi")
    both = quotes.withColumn("own", F.lit(None).cast("long")).unionByName(own.withColumn("own", F.col("turn").cast("long"))).withColumn("span", F.floor(F.col("turn") / SPAN))
    spans = both.groupBy("conv_id", "key", "span").agg(F.max("own").alias("last"))
    earlier = spans.select("conv_id", "key", "span", F.max("last").over(W.partitionBy("conv_id", "key").orderBy("span").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    within = W.partitionBy("conv_id", "key", "span").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    near = both.withColumn("near", F.max("own").over(within)).where("level > 0")
    return near.join(earlier, ["conv_id", "key", "span"]).select("conv_id", "turn", "level", "size", F.coalesce("near", "before").alias("origin")).where("origin is not null")


def replies(found: DataFrame) -> DataFrame:
    """``conv_id, turn, reply_to``: one for each message that quotes another."""
    counted = origins(found).groupBy("conv_id", "turn", "level", "origin").agg(F.sum("size").alias("size"))
    top = F.max(F.struct((-F.col("level")).alias("level"), "size", "origin"))
    return counted.groupBy("conv_id", "turn").agg(top.alias("top")).select("conv_id", "turn", F.col("top.origin").alias("reply_to"))


def roots(links: DataFrame) -> DataFrame:
    """``conv_id, turn, reply_to, root_turn, depth`` by pointer doubling; a reply is later than what it answers, so chains end."""
    now = runtime.materialize(links.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("root_turn"), F.lit(1).alias("depth")), "chat-roots")
    while True:
        up = now.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("next"), F.col("depth").alias("more"))
        joined = now.join(up, ["conv_id", "root_turn"], "left")
        if joined.where("next is not null").isEmpty():
            return now
        now = runtime.materialize(joined.select("conv_id", "turn", "reply_to", F.coalesce("next", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "chat-roots")


def link(messages: DataFrame) -> DataFrame:
    """Per message ``conv_id, turn, role, reply_to, root_turn, depth, n_quoted`` (lines), ``max_level`` and ``body`` (without quotes).

    Sorted by (conv_id, root_turn, turn) a conversation is in reply order.  A message that quotes nothing known is its own
    root at depth 0.  Messages with a null conversation or turn are not linked; a null text has a null body; rows that
    repeat a conversation and turn are one message when quoted and each come out; an empty table gives an empty one.
    """
    found = runtime.materialize(keys(messages.select("conv_id", "turn", "text")), "chat-keys")  # read four times
    linked = roots(replies(found))
    runtime.drop_tables([found])
    at = linked.select(F.col("conv_id").alias("__c"), F.col("turn").alias("__t"), "reply_to", "root_turn", "depth")
    lines = F.split("text", "\n", -1)
    quoted = F.filter(lines, lambda x: x.rlike(QUOTED))
    levels = F.transform(quoted, lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", "")))
    own = F.filter(lines, lambda x: ~x.rlike(QUOTED) & ~x.rlike(ATTRIBUTION))
    body = F.when(F.size(quoted) > 0, F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", "")).otherwise(F.col("text"))
    some = messages.select("conv_id", "turn", "role", "text")
    out = some.join(at, (F.col("conv_id") == F.col("__c")) & (F.col("turn") == F.col("__t")), "left")
    return out.select(
        "conv_id", "turn", "role", "reply_to", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce(F.when(F.col("text").isNotNull(), F.size(quoted)), F.lit(0)).alias("n_quoted"), F.coalesce(F.array_max(levels), F.lit(0)).alias("max_level"), body.alias("body"),
    )
