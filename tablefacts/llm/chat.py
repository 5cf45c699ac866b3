"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn is written as ``### role: text</turn>`` and a line break. Inside roles and texts
the control characters are escaped, so that no text can open or close a turn, and
``unescape`` gives back every text. A turn costs as many tokens as it has words.

Prefix sums of the tokens place the turns of a conversation: a window takes the turns whose
prefix sum starts in one half budget, a turn of more than half a budget has a window of its
own, so that the own turns of a window stay within the budget unless a single turn is
larger. Every later
window begins with the system turn (the first turn if its role is system) and the last
turns of the window before it, as far as they fit in the history tokens. Only assistant
texts that come for the first time are under the loss mask; what is repeated is masked.

Turns are ordered by turn, then role, then text; null turns come first, null texts and
roles are empty. Rows without conv_id are one conversation. Repeated rows are turns of
their own. Prefix sums go by segments of a conversation, so that a long one is not summed
in one task. Any other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize

#: Tokens of a window's own turns, and of the history that it repeats.
BUDGET, HISTORY = 512, 96
#: Turn numbers of one segment.
SEGMENT = 256
TURN_OPEN, ROLE_END, TURN_END = "### ", ": ", "</turn>\n"
#: Escapes; the backslash goes first on the way in and last on the way back.
ESCAPES = [("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c")]


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _turns(conversations: DataFrame) -> DataFrame:
    """Every turn with its formatted text, place and prefix sum of tokens before it."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        escape(F.coalesce(F.col("text"), F.lit(""))).alias("body"),
        F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-(2**40))).cast("long").alias("segment"),
    )
    head = F.concat(F.lit(TURN_OPEN), escape(F.col("role")), F.lit(ROLE_END))
    rows = rows.select("*", F.length(head).alias("head_chars"), F.concat(head, "body", F.lit(TURN_END)).alias("chunk"))
    rows = rows.withColumn("tokens", F.regexp_count("chunk", F.lit(WORD_PATTERN)).cast("long"))
    inside = Window.partitionBy("conv_id", "segment").orderBy("turn", "role", "body")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", (F.row_number().over(inside) - 1).alias("place"), (F.sum("tokens").over(upto) - F.col("tokens")).alias("before"))
    sums = rows.groupBy("conv_id", "segment").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(
        "conv_id", "segment",
        F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("base_t"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base_n"),
    )
    base = base.withColumnRenamed("conv_id", "c").withColumnRenamed("segment", "s")
    rows = rows.join(base, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s")))
    return rows.select(
        "conv_id", "role", "chunk", "tokens", "head_chars",
        F.length("body").alias("body_chars"), (F.col("place") + F.col("base_n")).alias("place"), (F.col("before") + F.col("base_t")).alias("before"),
    )


def chat_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, text, context_turns (how many of its turns are
    repeated), tokens, loss (start and length of each stretch under the loss mask)."""
    half = max(1, budget // 2)
    large = F.col("tokens") > half
    span = (F.floor(F.col("before") / half) * 2 + large.cast("long")).alias("span")
    turns = materialize(_turns(conversations).select("*", span))
    spans = turns.groupBy("conv_id", "span").agg(F.max(F.col("before") + F.col("tokens")).alias("end"))
    order = Window.partitionBy("conv_id").orderBy("span")
    spans = spans.select("*", F.lead("span").over(order).alias("next_span"), F.lag("span").over(order).isNull().alias("opening"))
    spans = spans.withColumnRenamed("conv_id", "c").withColumnRenamed("span", "s")
    joined = turns.join(spans, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("span") == F.col("s")))
    is_system = (F.col("place") == 0) & (F.col("role") == "system")
    again = F.col("next_span").isNotNull() & (F.col("end") - F.col("before") <= history) & ~is_system
    parts = ["place", "chunk", "tokens", "head_chars", "body_chars", "role"]
    own = joined.select("conv_id", F.col("span").alias("window"), F.lit(2).alias("kind"), *parts)
    repeated = joined.where(again).select("conv_id", F.col("next_span").alias("window"), F.lit(1).alias("kind"), *parts)
    later = spans.where("not opening").select("c", F.col("s").alias("window"))
    system = turns.where(is_system).join(later, F.col("conv_id").eqNullSafe(F.col("c")))
    system = system.select("conv_id", "window", F.lit(0).alias("kind"), *parts)
    rows = own.unionByName(repeated).unionByName(system)
    # A window holds a budget of turns, so its turns may meet in one row.
    packed = rows.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(F.struct("kind", *parts))).alias("t"))
    first = "cast(struct(0L as at, cast(array() as array<struct<start:bigint,length:bigint>>) as loss) as struct<at:bigint,loss:array<struct<start:bigint,length:bigint>>>)"
    marked = F.expr(
        f"""aggregate(t, {first}, (acc, x) -> struct(
            acc.at + length(x.chunk) as at,
            if(x.kind = 2 and x.role = 'assistant',
               concat(acc.loss, array(struct(acc.at + x.head_chars as start, cast(x.body_chars as bigint) as length))), acc.loss) as loss))"""
    )
    return packed.select(
        "conv_id",
        "window",
        F.array_join(F.transform("t", lambda x: x["chunk"]), "").alias("text"),
        F.size(F.filter("t", lambda x: x["kind"] < 2)).alias("context_turns"),
        F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("tokens"),
        marked["loss"].alias("loss"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """The windows parsed again: the roles and texts of the turns that are not repeated,
    and the text under the loss mask."""
    chunks = F.split("text", TURN_END.strip("\n") + "\n")
    # The text ends with the end of a turn, so the last piece is empty.
    turns = F.slice(chunks, F.col("context_turns") + 1, F.size(chunks) - 1 - F.col("context_turns"))
    role = lambda c: F.substring(F.substring_index(c, ROLE_END.strip(), 1), len(TURN_OPEN) + 1, 2**31 - 1)
    body = lambda c: F.substring(c, F.locate(ROLE_END.strip(), c) + len(ROLE_END), 2**31 - 1)
    read = F.transform(turns, lambda c: F.struct(unescape(role(c)).alias("role"), unescape(body(c)).alias("text")))
    under = F.transform("loss", lambda x: unescape(F.substring(F.col("text"), (x["start"] + 1).cast("int"), x["length"].cast("int"))))
    return windows.select("conv_id", "window", read.alias("turns"), F.array_join(under, "").alias("loss_text"), F.length("text").alias("chars"))


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Per conversation, from the formatted windows: turns, loss text and size, digested."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read_windows(windows).select("conv_id", F.struct("window", said.alias("said"), "loss_text").alias("w"), F.size("turns").alias("n"), "chars")
    whole = rows.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.array_sort(F.collect_list("w")).alias("w"), F.sum("chars").cast("long").alias("formatted_chars")
    )
    loss = F.array_join(F.transform("w", lambda w: w["loss_text"]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.transform("w", lambda w: w["said"]), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
