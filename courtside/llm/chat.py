"""Chat formatting: quotation linking and reply-ordered conversations, in DataFrame functions only.

A line that begins with ``>`` marks is quoted, one level per mark (white space between marks is ignored). Lines of the
same level that follow each other are a passage. A passage is normalised (lower case, runs of letters and digits only)
and hashed whole, by paragraph, by line and by sentence, and so is what a message says itself; lines that a mail program
has wrapped do not matter to paragraphs and sentences. A quoted hash joins the first message of the conversation that
said it, if that is an earlier one. The message answered is the one with the shallowest link, then the most linked words, then the latest turn. Threads (root and depth) come from pointer
doubling, whose rounds grow with the logarithm of the deepest thread.

The result has one row per input row; ``(conv_id, thread_root, turn)`` orders a conversation so that every message
follows the one it answers. Joins are on conversation and hash, originals are reduced to one row per hash by partial
aggregation before they meet a quote, and no conversation is gathered in one task.

Null texts count as empty; texts of any length are read whole; rows with a null conversation or turn keep their text and link to nothing; rows that repeat
a turn are answered as one message; an attribution line (``On ... wrote:``) before a quote is dropped with it; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.plans.storage import saved, small_side

QUOTED = r"^\s*>"
MARKS = r"^((?:\s*>)+)"
#: Where a paragraph ends, and where a sentence ends within one.
PARAGRAPHS, SENTENCES = r"\n\s*\n", r"(?<=[.!?…。！？])\s+"
ATTRIBUTION = r"^\s*On\b.*\bwrote:\s*$"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n")


def _kept(lines: Column) -> Column:
    """The lines that the author wrote."""
    return F.filter(lines, lambda line, i: ~(line.rlike(QUOTED) | (line.rlike(ATTRIBUTION) & F.coalesce(F.get(lines, i + 1).rlike(QUOTED), F.lit(False)))))


def own_text(text: Column) -> Column:
    """A message without its quotes and their attribution lines."""
    lines = _lines(text)
    return F.when(F.exists(lines, lambda line: line.rlike(QUOTED)), F.btrim(F.array_join(_kept(lines), "\n"), F.lit(" \t\r\n"))).otherwise(F.coalesce(text, F.lit("")))


def normalised(passage: Column) -> Column:
    """Words of letters and digits in lower case, with single spaces."""
    return F.trim(F.regexp_replace(F.lower(passage), r"[^\p{L}\p{N}]+", " "))


def _units(text: Column) -> Column:
    """A text whole, by paragraph, by line and by sentence, normalised, distinct and without empty ones."""
    parts = [F.array(text), F.split(text, "\n"), F.split(text, PARAGRAPHS), F.split(text, f"{PARAGRAPHS}|{SENTENCES}")]
    return F.array_distinct(F.filter(F.transform(F.concat(*parts), normalised), lambda x: x != ""))


def quotes(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, level, passage)``: the quoted passages of each message."""
    quoting = messages.where(F.col("text").rlike(r"(?m)" + QUOTED)).dropDuplicates(["conv_id", "turn", "text"])
    lines = quoting.select("conv_id", "turn", F.xxhash64("text").alias("of"), F.posexplode(_lines(F.col("text"))).alias("pos", "line")).where(F.col("line").rlike(QUOTED))
    marked = lines.select("*", F.length(F.regexp_replace(F.regexp_extract("line", MARKS, 1), r"\s", "")).alias("level"), F.regexp_replace("line", MARKS + r"\s?", "").alias("body"))
    key = ["conv_id", "turn", "of", "level"]
    by_level = marked.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("rows"))
    # a passage ends where the next line of the level is not the next line of the message
    first = lambda r, i: (i == 0) | (F.get(F.col("rows"), i - 1)["pos"] + 1 != r["pos"])
    starts = F.transform(F.filter(F.col("rows"), first), lambda r: r["pos"])
    runs = by_level.select(*key, "rows", F.explode(F.arrays_zip(starts.alias("start"), F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.lit(2**31 - 1))).alias("stop"))).alias("run"))
    inside = F.filter(F.col("rows"), lambda r: (r["pos"] >= F.col("run")["start"]) & (r["pos"] < F.col("run")["stop"]))
    return runs.select("conv_id", "turn", "level", F.array_join(F.transform(inside, lambda r: r["body"]), "\n").alias("passage"))


def _hashed(df: DataFrame, keep: list[str], units: Column) -> DataFrame:
    one = df.select(*keep, F.explode(units).alias("unit"))
    return one.select(*keep, F.xxhash64("unit").alias("h1"), F.crc32("unit").alias("h2"), F.size(F.split("unit", " ")).alias("words"))


def reply_links(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, reply_to, level, linked_words)`` for each message whose quotes lead to an earlier one."""
    messages = messages.where("conv_id is not null and turn is not null")
    found = saved(quotes(messages))
    quoted = _hashed(found, ["conv_id", "turn", "level"], _units(F.col("passage"))).distinct()
    # only conversations that quote at all need the hashes of what was said
    said = messages.join(small_side(found.select("conv_id").distinct()), "conv_id", "left_semi")
    original = _hashed(said.select("conv_id", "turn", own_text(F.col("text")).alias("own")), ["conv_id", "turn"], _units(F.col("own")))
    original = original.groupBy("conv_id", "h1", "h2").agg(F.min("turn").alias("reply_to"))
    linked = quoted.join(original, ["conv_id", "h1", "h2"]).where("reply_to < turn").groupBy("conv_id", "turn", "level", "reply_to").agg(F.sum("words").alias("linked_words"))
    best = F.max(F.struct((-F.col("level")).alias("l"), "linked_words", "reply_to")).alias("best")
    return linked.groupBy("conv_id", "turn").agg(best).select("conv_id", "turn", "best.reply_to", (-F.col("best.l")).alias("level"), "best.linked_words")


def threads(links: DataFrame) -> DataFrame:
    """``(conv_id, turn, thread_root, depth)`` of each replying message, by pointer doubling."""
    at = saved(links.select("conv_id", "turn", F.col("reply_to").alias("thread_root"), F.lit(1).alias("depth")))
    while True:
        up = at.select("conv_id", F.col("turn").alias("thread_root"), F.col("thread_root").alias("above"), F.col("depth").alias("more"))
        step = saved(at.join(up, ["conv_id", "thread_root"], "left"))
        at = step.select("conv_id", "turn", F.coalesce("above", "thread_root").alias("thread_root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        if step.where("above is not null").isEmpty():
            return at


def reply_ordered(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turn, role, reply_to, thread_root, depth, quoted_lines, text)``: each message, linked, without quotes."""
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    links = saved(reply_links(rows))
    linked = saved(links.select("conv_id", "turn", "reply_to").join(threads(links), ["conv_id", "turn"]))
    if linked.isEmpty():
        joined = rows.select("*", F.lit(None).cast(rows.schema["turn"].dataType).alias("reply_to"), F.col("turn").alias("thread_root"), F.lit(0).alias("depth"))
    else:
        joined = rows.join(linked, ["conv_id", "turn"], "left")
    quoted = F.size(F.filter(_lines(F.col("text")), lambda line: line.rlike(QUOTED)))
    return joined.select("conv_id", "turn", "role", "reply_to", F.coalesce("thread_root", "turn").alias("thread_root"), F.coalesce("depth", F.lit(0)).alias("depth"), quoted.alias("quoted_lines"), own_text(F.col("text")).alias("text"))
