"""Chat formatting by multi-party perspective rotation.

For every participant the dialogue is rendered with that speaker as the assistant and the others as named
users; the mask covers what the assistant says.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import written

END = "<|end|>\n"
ASSISTANT = "<|assistant|>\n"
#: Characters that can't stand in a name, and the percent sign that stands for them.
ESCAPED = "%|<> \t\n\x0b\x0c\r"
#: So many characters of a text take part in the order of turns; a hash of all of it comes next.
ORDERED_CHARS = 256


def speaker_name(role: Column) -> Column:
    """The role with a percent code for each character of ESCAPED, so that two roles never get one name."""
    return reduce(lambda name, c: F.replace(name, F.lit(c), F.lit(f"%{ord(c):02X}")), ESCAPED, role)


def _ranked(base: DataFrame) -> DataFrame:
    """Adds rank: a turn's place in its conversation, from 0, by turn, role and text.

    No task holds a conversation: turns are sorted into ranges over conversation and order, counted by range, and
    a turn's rank is its place in its range after the counts of the ranges before.
    """
    order = ["turn", "role", "__head", "__hash"]
    keyed = base.withColumn("__head", F.substring("body", 1, ORDERED_CHARS)).withColumn("__hash", F.xxhash64("body")).withColumn("__tie", F.monotonically_increasing_id())
    ranges = written(keyed.repartitionByRange("conv_id", *order, "__tie").withColumn("__range", F.spark_partition_id()), "chat-ranges")
    held = ranges.groupBy("conv_id", "__range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = written(held.select(F.col("conv_id").alias("c"), F.col("__range").alias("r"), F.coalesce(before, F.lit(0)).alias("offset")), "chat-offsets")
    place = F.row_number().over(Window.partitionBy("__range", "conv_id").orderBy(*order, "__tie")) - 1
    placed = ranges.withColumn("place", place)
    ranked = placed.join(offsets, (placed["__range"] == offsets["r"]) & placed["conv_id"].eqNullSafe(offsets["c"]))
    return written(ranked.select("conv_id", "turn", "role", "body", (F.col("offset") + F.col("place")).alias("rank")), "chat-ranked")


def _placed(rows: DataFrame, speakers: DataFrame, saved: Column) -> DataFrame:
    """c, participant, p, opening, text_start: each participant's parts, and the characters of their rendering before each.

    These are sums of lengths; no text goes along. A conversation's parts are in one task, as a few numbers each.
    """
    sizes = rows.groupBy("conv_id", F.col("part").alias("p")).agg(F.sum("size").alias("total"))
    own = rows.groupBy(F.col("conv_id").alias("o"), F.col("role").alias("r"), F.col("part").alias("q")).agg(F.count("*").alias("own"))
    grid = sizes.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("conv_id")
    grid = grid.join(own, F.col("c").eqNullSafe(F.col("o")) & (F.col("participant") == F.col("r")) & (F.col("p") == F.col("q")), "left")
    rendered = F.col("total") - F.coalesce("own", F.lit(0)) * saved
    before = F.sum(rendered).over(Window.partitionBy("c", "participant").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    return grid.select("c", "participant", "p", "opening", F.coalesce(before, F.lit(0)).cast("long").alias("text_start"))


def rotate_perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", context_roles: tuple[str, ...] = ("system",), turns_per_row: int | None = None
) -> DataFrame:
    """conv_id, participant, part, first_turn, n_turns, text, masks, n_masked, text_start, opening_chars: a row per
    conversation, participant and part.

    Turns stand in order of turn, then role, then text (nulls first; texts that agree in their first ORDERED_CHARS
    characters by a hash); repeated rows stay. Each distinct role is a participant but for `context_roles`, which are
    rendered as they are in every perspective, and null roles, which are users without a name. A conversation
    without a participant gives no row. A null text is empty, a null conv_id is a conversation of its own.

    A row holds a whole dialogue, so its size is that of the longest one. Where a conversation may be too long for
    a row, `turns_per_row` cuts each dialogue into parts of so many turns by their rank; `first_turn` is the rank of
    the first one. Each later part begins with the conversation's first context turn once more (not counted in
    n_turns), so that every part has its context. Then no task holds more than one part of a conversation. Parts are
    pieces of one rendering: without their first `opening_chars` characters, in order of part, they are the text of the
    whole dialogue, in which a part begins at `text_start`; a mask less opening_chars plus text_start is the mask there.

    `masks` holds (start, end) in code points of the row's text: the assistant's words and their end mark. Marks
    inside texts are escaped ("<|" becomes "<\\|"), so a text can't open a turn.
    """
    base = turns.select(
        turns[conv_col].alias("conv_id"), turns[turn_col].alias("turn"), turns[role_col].alias("role"), F.replace(F.coalesce(turns[text_col], F.lit("")), F.lit("<|"), F.lit("<\\|")).alias("body")
    )
    named = lambda kind, role: F.concat(F.lit(f"<|{kind}"), speaker_name(role), F.lit("|>\n"))
    context = F.coalesce(F.col("role").isin(*context_roles), F.lit(False))
    head = F.when(context, named("", F.col("role"))).when(F.col("role").isNull(), F.lit("<|user|>\n")).otherwise(named("user name=", F.col("role")))
    if turns_per_row is None:
        rows = base.withColumn("part", F.lit(0).cast("long"))
        order = ["turn", "role", F.substring("body", 1, ORDERED_CHARS), F.xxhash64("body")]
        rows = rows.withColumn("rank", (F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)) - 1).cast("long"))
    else:
        rows = _ranked(base).withColumn("part", F.floor(F.col("rank") / turns_per_row))
    rows = rows.withColumn("context", context).withColumn("head", head)
    size = F.char_length("head") + F.char_length("body") + len(END)
    at = F.sum(size).over(Window.partitionBy("conv_id", "part").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    parts = (
        rows.withColumn("at", F.coalesce(at, F.lit(0)))
        .groupBy("conv_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "context", "role", "head", "body", "at"))).alias("turns"))
    )
    speakers = base.where(F.col("role").isNotNull() & ~F.col("role").isin(*context_roles)).select(F.col("conv_id").alias("c"), F.col("role").alias("participant")).distinct()
    speaker = F.col("participant")
    # heads of the speaker's own turns are shorter by this than where they are named
    saved = F.char_length(named("user name=", speaker)) - len(ASSISTANT)
    if turns_per_row is None:
        speakers = speakers.select("c", "participant", F.lit(0).cast("long").alias("p"), F.lit("").alias("opening"), F.lit(0).cast("long").alias("text_start"))
    else:
        openings = rows.where("context").groupBy(F.col("conv_id").alias("o")).agg(F.min_by(F.concat("head", "body", F.lit(END)), "rank").alias("opening"))
        speakers = speakers.join(openings, F.col("c").eqNullSafe(F.col("o")), "left").drop("o")
        speakers = _placed(rows.withColumn("size", size), speakers, saved)
    # both written, so that adaptive execution can split a conversation of very many parts
    pairs = written(parts, "chat-parts").join(written(speakers, "chat-speakers"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    pairs = pairs.withColumn("opening", F.when(F.col("part") > 0, F.coalesce("opening", F.lit(""))).otherwise(F.lit("")))
    own = lambda t: F.coalesce(t["role"] == speaker, F.lit(False))
    text = F.transform("turns", lambda t: F.concat(F.when(own(t), F.lit(ASSISTANT)).otherwise(t["head"]), t["body"], F.lit(END)))

    def mask(t: Column, k: Column) -> Column:
        begin = F.char_length("opening") + t["at"] - k * saved + len(ASSISTANT)
        return F.struct(begin.cast("int").alias("start"), (begin + F.char_length(t["body"]) + len(END) - 1).cast("int").alias("end"))  # the line feed isn't learned

    return pairs.select(
        "conv_id",
        "participant",
        "part",
        F.col("turns")[0]["rank"].alias("first_turn"),
        F.size("turns").cast("long").alias("n_turns"),
        F.concat("opening", F.array_join(text, "")).alias("text"),
        F.transform(F.filter("turns", own), mask).alias("masks"),
        "text_start",
        F.char_length("opening").cast("long").alias("opening_chars"),
    ).withColumn("n_masked", F.aggregate("masks", F.lit(0).cast("long"), lambda acc, m: acc + m["end"] - m["start"]))
