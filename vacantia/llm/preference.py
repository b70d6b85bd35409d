"""Preference formatting: pairs of conversations as one prompt and two masked completions.

The longest common prefix of turns of the chosen and the rejected conversation is
rendered once, as the prompt; what follows is rendered for each side, with a mask
of the character spans that a loss may use (what assistants say, and the end mark
of their turns). A pair is one row with the turns of both sides as arrays; prefix,
prompt and masks are expressions over the two arrays, without another shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored

#: The rendering of a turn: head, role, head end, text, tail.
HEAD, MIDDLE, TAIL = "<|im_start|>", "\n", "<|im_end|>\n"
#: Answers of a bucket, about; buckets are stretches of the order in which partners are sought.
BUCKET = 1 << 16
SPANS = "array<struct<begin:int,end:int>>"


def _said(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    t = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("user")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return t.filter("conv_id IS NOT NULL")


def gathered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and its turns, an array of (turn, role, text) in order; rows without a conv_id are left out.

    A null role is 'user', a null text is empty, a null turn comes first; rows that
    repeat conversation, turn, role and text count once, and turns with one number
    are in order of role and text. A conversation is one training row, so its own
    turns, and no others, meet in one group; repeated rows are dropped before that."""
    t = _said(conversations, conv_id, turn, role, text)
    return t.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))


def _rendered(t: Column) -> Column:
    return F.concat(F.lit(HEAD), t["role"], F.lit(MIDDLE), t["text"], F.lit(TAIL))


def _spans(turns: Column) -> Column:
    """What assistants say in the rendered turns, and the end mark of each such turn."""
    begin = len(HEAD) + len(MIDDLE)

    def step(acc: Column, t: Column) -> Column:
        end = acc["at"] + F.length(_rendered(t))
        span = F.struct((acc["at"] + F.lit(begin) + F.length(t["role"])).cast("int").alias("begin"), (end - 1).cast("int").alias("end"))
        return F.struct(end.cast("int").alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans")), step)["spans"]


def paired(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Pairs of two tables of turns (pair_id, position, role, text): pair_id, chosen and rejected,
    arrays of (role, text) by position. Pairs that only one side has are left out."""
    kinds = [d.select("pair_id", F.lit(k).alias("side"), F.struct("position", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")) for k, d in enumerate((chosen, rejected))]
    side = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == k, F.col("t")))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    both = kinds[0].unionByName(kinds[1]).filter("pair_id IS NOT NULL").groupBy("pair_id").agg(side(0).alias("chosen"), side(1).alias("rejected"))
    return both.filter("size(chosen) > 0 AND size(rejected) > 0")


def formatted(pairs: DataFrame) -> DataFrame:
    """pairs: pair_id, chosen and rejected (arrays of structs with role and text).

    pair_id, prefix_turns, prompt, and for either side its completion and mask, the
    spans (begin, end) of its characters that are trained on. Equal conversations have
    no completion on either side; no common turn gives an empty prompt."""
    plain = lambda c: F.transform(c, lambda t: F.struct(F.coalesce(t["role"], F.lit("user")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    p = pairs.select("pair_id", plain("chosen").alias("chosen"), plain("rejected").alias("rejected"))
    other = F.array_position(F.zip_with("chosen", "rejected", lambda x, y: ~x.eqNullSafe(y)), True)  # the shorter side is null beyond its end
    p = p.withColumn("prefix_turns", F.when(other > 0, other - 1).otherwise(F.size("chosen")).cast("long"))
    n = F.col("prefix_turns").cast("int")
    p = p.withColumns({"prompt": F.slice("chosen", 1, n), "chosen": F.slice("chosen", n + 1, F.size("chosen")), "rejected": F.slice("rejected", n + 1, F.size("rejected"))})
    text = lambda c: F.array_join(F.transform(c, _rendered), "")
    return p.select("pair_id", "prefix_turns", text("prompt").alias("prompt"), text("chosen").alias("chosen_completion"), _spans(F.col("chosen")).alias("chosen_mask"), text("rejected").alias("rejected_completion"), _spans(F.col("rejected")).alias("rejected_mask"))


def _partners(answers: DataFrame) -> DataFrame:
    """id and next: for each answer (id, answer) the next one that differs from it, in the
    order of the MD5 of ids and around its end; none if all answers are equal.

    In that order equal answers stand scattered. A bucket is a stretch of the order;
    of each, two rows go to the driver: its first, and its first that differs from that."""
    buckets = max(1, -(-answers.count() // BUCKET))
    place = F.md5(F.col("id").cast("string"))
    number = F.conv(F.substring(place, 1, 8), 16, 10).cast("long")
    rows = answers.select("id", place.alias("place"), F.xxhash64("answer").alias("h"), F.floor(number * buckets / (1 << 32)).cast("long").alias("bucket"))
    order = Window.partitionBy("bucket").orderBy("place", "id")
    rows = rows.withColumn("before", F.lag("h").over(order))
    back = Window.partitionBy("bucket").orderBy(F.desc("place"), F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.last(F.when(F.col("h") != F.col("before"), F.col("id")), ignorenulls=True).over(back))
    rows = stored(rows, "pref-order")
    row = F.struct("place", "id", "h")
    heads = rows.groupBy("bucket").agg(F.min(row).alias("first"), F.min(F.when(F.col("h") != F.col("before"), row)).alias("second")).orderBy("bucket").collect()
    n, after, other = len(heads), [], None
    for k in reversed(range(2 * n)):
        first, second = heads[k % n]["first"], heads[k % n]["second"]
        if k < n:
            after.append((heads[k]["bucket"], *follows))
        if second is not None:
            other = second["id"]
        elif k < 2 * n - 1 and follows[1] != first["h"]:
            other = follows[0]
        follows = (first["id"], first["h"], other)  # what the bucket before meets
    after = rows.sparkSession.createDataFrame(after, "_bucket long, a long, a_h long, b long")
    found = rows.join(small(after), F.col("bucket") == F.col("_bucket"))
    return found.select("id", F.coalesce("inside", F.when(F.col("a_h") != F.col("h"), F.col("a")), "b").alias("next")).filter("next IS NOT NULL")


def swapped_answers(conversations: DataFrame, **columns: str) -> DataFrame:
    """Pairs for data without preferences: every conversation with an assistant turn is
    chosen; its rejected twin has, in place of its last assistant turn and what follows,
    the last assistant turn of the next conversation (by the MD5 of ids) that answers
    differently. If no other conversation does, there is no pair."""
    names = {"conv_id": "conv_id", "turn": "turn", "role": "role", "text": "text"} | columns
    said = _said(conversations, **names).filter("role = 'assistant'")
    answers = stored(said.groupBy(F.col("conv_id").alias("id")).agg(F.max(F.struct("turn", "text"))["text"].alias("answer")), "pref-answers")
    other = answers.select(F.col("id").alias("_next"), F.col("answer").alias("swapped"))
    twins = _partners(answers).join(other, F.col("next") == F.col("_next")).select("id", "swapped")
    both = gathered(conversations, **names).join(twins, F.col("conv_id") == F.col("id"))
    last = F.array_max(F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == "assistant"))
    plain = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    swap = F.array(F.struct(F.lit("assistant").alias("role"), F.col("swapped").alias("text")))
    return both.select(F.col("conv_id").alias("pair_id"), plain.alias("chosen"), F.concat(F.slice(plain, 1, last - 1), swap).alias("rejected"))
