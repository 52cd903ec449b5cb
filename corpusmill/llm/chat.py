"""Preference pairs rendered as one prompt and two masked completions, in DataFrame operations only.

Chosen and rejected conversations come as long tables (key, turn, role, text). The prompt is
their longest common prefix of turns: all turns before the first turn number at which the two
differ, in role, in text, or in how often a message stands there. It is rendered once, from the
chosen side; the turns from there on are that side's completion. The result is long as well, a
row per rendered message with its character range in ``prompt + completion``.

Training masks: only the assistant's text in a completion is trained on (``train_from`` and
``train_to`` are its range); elsewhere the range is empty, both its ends at the message's end.

Scale: prefixes and offsets are worked out on references, which hold a 64-bit digest and a length
in place of role and text, and which are dealt out once, by conversation and block of ``BLOCK`` turns;
all further steps on them are joins with tables of a row per block. So a conversation of any length
is never gathered in one row or task; a task holds the references of some blocks. Then each
message that is rendered meets its places once: a text moves one time, and one that stands on
both sides is not moved for the second.

Null roles and texts are rendered as empty ones. Messages at the same turn stand in order of their
digests; repeated rows are repeated messages and are compared by number. Rows without a key or a
turn take no part. A key on one side only has an empty prompt and one completion. Equal sides have
a prompt and no completion. Empty tables give an empty result. Extra columns are ignored. Texts of any
length are rendered whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import cut, named

#: Turns in a block of the two-level prefix sums.
BLOCK = 64
HEAD, TAIL = "<|{}|>\n", "<|end|>\n"
_PARTS = ("prompt", "chosen", "rejected")


def _head(role: str) -> Column:
    before, after = HEAD.split("{}")
    return F.concat(F.lit(before), F.col(role), F.lit(after))


def _messages(df: DataFrame, key: str) -> DataFrame:
    """(src, at, role, text, h) of the rows that take part."""
    k, turn, role, text = named([key, "turn", "role", "text"])
    rows = df.select(k.alias("src"), turn.cast("long").alias("at"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.where("src is not null and at is not null").withColumn("h", F.xxhash64("role", F.lit("|"), "text"))


def references(messages: DataFrame) -> DataFrame:
    """(pair_id, turn, h, trained, head, chars, src, at) for ``messages(src, at, role, text, h)`` in their own places."""
    return messages.select(F.col("src").alias("pair_id"), F.col("at").alias("turn"), "h", (F.col("role") == "assistant").alias("trained"), F.length(_head("role")).alias("head"), F.length("text").alias("chars"), "src", "at")


def place(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair_id, part, turn, nth, n, src, at, h, start, size, train_from, train_to) from two tables of references.

    ``n`` equal messages stand one after the other from ``start`` on, each of ``size`` characters; ``nth`` is the first one's
    number at its turn, and the training range is that of the first one.
    """
    own = ["pair_id", "block"]
    rows = chosen.withColumn("side", F.lit(1)).unionByName(rejected.withColumn("side", F.lit(0)))
    rows = rows.withColumn("block", F.floor(F.col("turn") / BLOCK)).repartition(*own)
    source = lambda side: F.min(F.when(F.col("side") == side, F.struct("src", "at")))
    found = rows.groupBy(*own, "turn", "h", "trained", "head", "chars").agg(F.sum("side").cast("int").alias("nc"), F.sum(1 - F.col("side")).cast("int").alias("nr"), source(1).alias("c"), source(0).alias("r"))
    found = cut(found, "chat-found")
    # the first turn with a message that one side has more often than the other, told to each block of the pair
    fork = found.groupBy("pair_id").agg(F.min(F.when(F.col("nc") != F.col("nr"), F.col("turn"))).alias("fork"))
    found = found.join(found.select(*own).distinct().join(fork, "pair_id"), own)
    common = F.col("fork").isNull() | (F.col("turn") < F.col("fork"))
    item = lambda part, n, s: F.struct(F.lit(part).alias("part"), n.alias("n"), s["src"].alias("src"), s["at"].alias("at"))
    sides = F.when(common, F.array(item("prompt", F.col("nc"), F.col("c")))).otherwise(F.array(item("chosen", F.col("nc"), F.col("c")), item("rejected", F.col("nr"), F.col("r"))))
    size = F.col("head").cast("long") + F.col("chars") + len(TAIL)
    rows = found.select(*own, "turn", "h", "trained", "head", "chars", size.alias("size"), F.inline(F.filter(sides, lambda x: x["n"] > 0)))
    rows = cut(rows, "chat-parts")

    blocks = rows.groupBy(*own).agg(*(F.coalesce(F.sum(F.when(F.col("part") == p, F.col("n") * F.col("size"))), F.lit(0)).alias(p) for p in _PARTS))
    before = Window.partitionBy("pair_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    whole = Window.partitionBy("pair_id")
    sum_before = lambda p: F.coalesce(F.sum(p).over(before), F.lit(0))
    starts = {"prompt": sum_before("prompt"), **{p: F.sum("prompt").over(whole) + sum_before(p) for p in _PARTS[1:]}}
    blocks = blocks.select(*own, *(c.alias(f"{p}_start") for p, c in starts.items()))

    rows = rows.join(blocks, own)
    first = F.coalesce(*(F.when(F.col("part") == p, F.col(f"{p}_start")) for p in _PARTS))
    inside = Window.partitionBy(*own, "part").orderBy("turn", "h", "head").rowsBetween(Window.unboundedPreceding, -1)
    at_turn = Window.partitionBy(*own, "part", "turn").orderBy("h", "head").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"start": first + F.coalesce(F.sum(F.col("n") * F.col("size")).over(inside), F.lit(0)), "nth": F.coalesce(F.sum("n").over(at_turn), F.lit(0)) + 1})
    trained = (F.col("part") != "prompt") & F.col("trained")
    text_from = F.col("start") + F.col("head")
    return rows.select("pair_id", "part", "turn", "nth", "n", "src", "at", "h", "start", "size", F.when(trained, text_from).otherwise(F.col("start") + F.col("size")).alias("train_from"), F.when(trained, text_from + F.col("chars")).otherwise(F.col("start") + F.col("size")).alias("train_to"))


def render(placed: DataFrame, messages: DataFrame) -> DataFrame:
    """(pair_id, part, turn, nth, role, segment, start, end, train_from, train_to): the messages in their places."""
    one = messages.groupBy("src", "at", "h").agg(F.min(F.struct("role", "text")).alias("m")).select("src", "at", "h", "m.*")
    rows = placed.join(one, ["src", "at", "h"]).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    on = F.col("i") * F.col("size")
    return rows.select(
        "pair_id", "part", "turn", (F.col("nth") + F.col("i")).alias("nth"), "role", F.concat(_head("role"), "text", F.lit(TAIL)).alias("segment"),
        (F.col("start") + on).alias("start"), (F.col("start") + on + F.col("size")).alias("end"), (F.col("train_from") + on).alias("train_from"), (F.col("train_to") + on).alias("train_to"),
    )


def format_preferences(chosen: DataFrame, rejected: DataFrame, key: str = "conv_id") -> DataFrame:
    """(pair_id, part, turn, nth, role, segment, start, end, train_from, train_to) of two tables (key, turn, role, text).

    ``part``: prompt, chosen or rejected; ``nth``: the message's number at its turn; ``start`` and
    ``end``: its characters in prompt + completion, 0-based, end exclusive.
    """
    sides = [_messages(chosen, key), _messages(rejected, key)]
    return render(place(*map(references, sides)), sides[0].unionByName(sides[1]))


def swapped_replies(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References of each conversation, and of its turns before its last assistant turn followed by the last assistant
    reply of its neighbour (ids 2k and 2k + 1), if both have one; else of those turns alone."""
    every = cut(references(messages), "chat-references")
    # one row a conversation; of several replies at that turn the one of the largest digest
    last = every.where("trained").groupBy("src").agg(F.max(F.struct("at", "h", "head", "chars")).alias("m")).select("src", "m.*")
    kept = every.join(last.select("src", F.col("at").alias("last")), "src", "left").where("last is null or turn < last").drop("last")
    other = last.select(F.col("src").bitwiseXOR(F.lit(1)).alias("pair_id"), "src", "at", "h", "head", "chars")
    reply = last.select(F.col("src").alias("pair_id"), F.col("at").alias("turn")).join(other, "pair_id").withColumn("trained", F.lit(True))
    return every, kept.unionByName(reply.select(kept.columns))


def format_swapped(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """``format_preferences`` of each conversation and its swapped one, whose texts are read from the one table."""
    messages = _messages(conversations, key)
    return render(place(*swapped_replies(messages)), messages)
