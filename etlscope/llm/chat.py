"""Chat formatting in budgeted windows; DataFrame functions only.

Prefix sums of turn tokens cut a conversation into turn-aligned spans: the line of all its tokens is marked every
``capacity`` tokens, turns between two marks make a span, and a turn across a mark joins the span behind it if both fit
the capacity, else it is a span of its own.  Each span becomes a window: the system turn (the first turn, if its role is
system) is retained, up to ``HISTORY_TURNS`` turns before the span are repeated as far as they fit ``HISTORY_TOKENS``,
then come the span's own turns.  Capacity is the budget less the system turn and the history allowance; a single turn
above it has a span of its own and is never split.  The loss mask covers the texts of assistant turns where they are
first shown; repeated ones are masked.

Turns stay rows: spans, windows and repetitions come from window functions over each conversation, which spill, and only
the turns of one window are ever collected.  So work and memory grow with the turns, however long a conversation is.
Reading back for the digests joins each conversation's text in one row, as its hash needs.

Template, for each turn::

    <|turn|>ROLE<|text|>TEXT<|end|>

Control strings inside roles and texts (these three and the usual ones of other templates) are escaped by a backslash
behind their first character; one that already has backslashes there gets one more.  Removing one backslash from each
such place restores the text exactly.

Tokens are estimated as runs of letters and digits plus single other signs, plus ``TURN_TOKENS`` a turn.

Edge cases: null role, text or turn number: empty, empty, first; equal turn numbers are ordered by role and text;
repeated rows are turns of their own; a null conv_id is one conversation; turns without any text keep their place; an
empty table gives an empty result.  A conversation, being one sequence, is sorted by one task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import materialize

BUDGET, HISTORY_TURNS, HISTORY_TOKENS, TURN_TOKENS = 1024, 4, 192, 3
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that must not appear inside texts: the markers above and those of widely used public templates.
CONTROLS = (
    TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>",
    "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<|begin_of_text|>", "<bos>", "<eos>", "<pad>", "<unk>", "<start_of_turn>", "<end_of_turn>",
)
_REST = "|".join(sorted({re.escape(c[1:]) for c in CONTROLS}))
_TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_REST})", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_REST})", "$1$2$3")


def spans(turns: DataFrame, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """Each of ``turns(conv_id, turn, role, text)`` with its place in the conversation, its tokens, and its span.

    Added: rn, system, tokens, upto (tokens up to its end, without the system turn), first (whether a span begins with it), window.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", (F.regexp_count("text", F.lit(_TOKEN)) + TURN_TOKENS).cast("long"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("rn", F.row_number().over(order))
    rows = rows.withColumn("system", (F.col("rn") == 1) & (F.col("role") == "system"))
    counted = F.when(F.col("system"), 0).otherwise(F.col("tokens"))
    rows = rows.withColumn("upto", F.sum(counted).over(so_far)).withColumn("below", F.col("upto") - counted)
    rows = rows.withColumn("capacity", F.greatest(F.lit(budget - history_tokens) - F.first(F.when(F.col("system"), F.col("tokens")).otherwise(0)).over(so_far), F.lit(1)))
    begin, end = F.expr("below div capacity"), F.expr("greatest(upto - 1, 0) div capacity")
    rows = rows.withColumn("mark", end).withColumn("across", begin != end)
    last = F.max(F.when(~F.col("across"), F.col("upto"))).over(Window.partitionBy("conv_id", "mark"))
    alone = F.col("across") & ~F.coalesce(last - F.col("below") <= F.col("capacity"), F.lit(False))
    rows = rows.withColumn("span", 2 * F.col("mark") - alone.cast("long"))
    rows = rows.withColumn("first", ~F.col("span").eqNullSafe(F.lag("span").over(order)))
    return rows.withColumn("window", F.sum(F.col("first").cast("int")).over(so_far)).drop("mark", "across", "span", "capacity")


def windows(turns: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """Windows of ``turns(conv_id, turn, role, text)``.

    (conv_id, window, formatted, n_tokens, n_repeated, n_new, loss): n_repeated turns lead and were shown before;
    loss holds (start, length) code point ranges of ``formatted`` under the loss mask.
    """
    rows = spans(turns, budget, history_tokens)
    order = Window.partitionBy("conv_id").orderBy("rn")
    place = lambda window, new: F.struct(window.cast("int").alias("window"), F.lit(new).alias("new"))
    shown = [place(F.col("window"), 1)]
    for k in range(1, history_turns + 1):  # the k-th turn from here begins a span, and this one is near enough to be repeated there
        ahead = lambda name, k=k: F.lead(name, k).over(order)
        near = ahead("first") & ~F.col("system") & (ahead("below") - F.col("upto") + F.col("tokens") <= history_tokens)
        shown.append(F.when(near, place(ahead("window"), 0)))
    n_windows = F.max("window").over(Window.partitionBy("conv_id"))
    again = F.when(F.col("system") & (n_windows > 1), F.transform(F.sequence(F.lit(2), n_windows.cast("int")), lambda w: place(w, 0)))
    role, text = escaped(F.col("role")), escaped(F.col("text"))
    head = F.concat(F.lit(TURN), role, F.lit(TEXT))
    rows = rows.select(
        "conv_id", "rn", "tokens", (F.col("role") == "assistant").alias("target"), F.concat(head, text, F.lit(END)).alias("piece"), F.char_length(head).alias("at"), F.char_length(text).alias("length"),
        F.concat(F.array_compact(F.array(*shown)), F.coalesce(again, F.array().cast("array<struct<window:int,new:int>>"))).alias("shown"),
    )
    copies = rows.select("conv_id", "rn", "tokens", "target", "piece", "at", "length", F.inline("shown"))
    parts = F.array_sort(F.collect_list(F.struct("new", "rn", "tokens", "target", "piece", "at", "length"))).alias("parts")
    whole = copies.groupBy("conv_id", "window").agg(parts)
    begin = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
    step = lambda s, t: F.struct(
        (s["pos"] + F.char_length(t["piece"])).alias("pos"),
        F.when(t["target"] & (t["new"] == 1), F.concat(s["loss"], F.array(F.struct((s["pos"] + t["at"]).alias("start"), t["length"].alias("length"))))).otherwise(s["loss"]).alias("loss"),
    )
    total = lambda f: F.aggregate("parts", F.lit(0).cast("long"), lambda n, t: n + f(t))
    return whole.select(
        "conv_id", "window", F.array_join(F.transform("parts", lambda t: t["piece"]), "").alias("formatted"), total(lambda t: t["tokens"]).alias("n_tokens"),
        (F.size("parts") - total(lambda t: t["new"])).cast("int").alias("n_repeated"), total(lambda t: t["new"]).cast("int").alias("n_new"), F.aggregate("parts", begin, step)["loss"].alias("loss"),
    )


def read_turns(formatted: Column, n_repeated: Column) -> Column:
    """The first-shown turns of a window, as an array of (role, text)."""
    pieces = F.split(formatted, re.escape(END))
    own = F.slice(pieces, n_repeated + 1, F.greatest(F.size(pieces) - 1 - n_repeated, F.lit(0)))
    marker = re.escape(TEXT)
    return F.transform(own, lambda p: F.struct(unescaped(F.substring(F.split(p, marker)[0], len(TURN) + 1, 1 << 30)).alias("role"), unescaped(F.split(p, marker)[1]).alias("text")))


def loss_texts(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(loss, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["length"])))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per window, from its text alone: conv_id, window, turns first shown there, losses (texts under the mask), chars."""
    return formatted.select("conv_id", "window", read_turns(F.col("formatted"), F.col("n_repeated")).alias("turns"), loss_texts(F.col("formatted"), F.col("loss")).alias("losses"), F.char_length("formatted").alias("chars"))


def digests(read: DataFrame) -> DataFrame:
    """Per conversation of ``read_back``: counts and hashes of its turns and of the texts under the mask."""
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    own = read.select("conv_id", F.struct("window", said.alias("said"), F.array_join("losses", "").alias("lost")).alias("w"), F.size("turns").alias("n"), "chars")
    whole = own.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("ws"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    joined = lambda name: F.array_join(F.transform("ws", lambda w: w[name]), "")
    return whole.select("conv_id", "n_turns", sha(joined("said")).alias("turns_sha256"), F.char_length(joined("lost")).cast("long").alias("loss_chars"), sha(joined("lost")).alias("loss_sha256"), "formatted_chars", F.size("ws").alias("n_windows"))


def query(conversations: DataFrame) -> DataFrame:
    """All conversations and conversation -1, whose two turns hold control strings; read back from written windows."""
    spark = conversations.sparkSession
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    return digests(read_back(materialize(windows(rows), "chat-windows")))
