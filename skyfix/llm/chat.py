"""Chat formatting into budgeted windows, in DataFrame operations only.

A conversation of CHUNK turns or fewer is gathered once, and its windows stay where it was gathered. A longer one is cut into
stretches of CHUNK turns by their rank, and a stretch is sent the last turns before it, as far back as the history budget can
reach, so no row grows with the conversation. Only numbers and roles are sorted for the ranks. Turn numbers give the order and
nothing else: dense and sparse ones make the same windows.

Over a stretch, prefix sums of turn tokens choose the windows: each takes turns until the next one does not fit the budget. A
window begins with the system turn and repeats the last turns before it, up to a history budget and as far as its first new
turn leaves room. So a window passes the budget only where the system turn and one new turn do so by themselves. The loss mask
has the assistant turns of a window that are new in it; repeated ones are masked.

Texts cannot forge turns: one backslash is added between `<` and `|` wherever they meet, with any number of backslashes
between them; taking it out again gives the text back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut, maybe_broadcast, tidy

#: Fixed marks of the template.
START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of a window, tokens of earlier turns that it repeats at most, and turns in a stretch.
BUDGET, HISTORY, CHUNK = 1024, 256, 512
#: Tokens of a turn's marks, the least that a turn has; and rows of turn numbers in a range that one task sorts, about.
MARKS, RANGE_ROWS = 4, 1_000_000


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def turn_tokens(text: Column) -> Column:
    """Tokens that a turn is taken to have: a quarter of its characters, and four for its marks."""
    return F.ceil(F.length(text) / 4).cast("long") + MARKS


def _ranked(rows: DataFrame) -> DataFrame:
    """rows (conv, turn, role, text) with `place`, from 0, in their conversation's order: turn, role and text, nulls first.

    Turn numbers and roles are counted and the counts summed up in ranges of them, so a conversation that has all rows is spread
    over all tasks. Rows that share both are ordered by their texts in one task, which spills.
    """
    spark = rows.sparkSession
    counts = cut(rows.groupBy("conv", "turn", "role").agg(F.count("*").alias("n")), "numbers")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // RANGE_ROWS))
    ranged = cut(counts.repartitionByRange(ranges, "conv", "turn", "role").withColumn("range", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    edges = ranged.groupBy("conv", "range").agg(F.sum("n").alias("held"))
    edges = cut(edges.select(F.struct("conv", "range").alias("at"), F.coalesce(F.sum("held").over(w), F.lit(0)).alias("before")), "edges")
    w = Window.partitionBy("conv", "range").orderBy("turn", "role").rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.select("*", F.struct("conv", "range").alias("at"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("inside"))
    # Nulls inside of a struct are equal, so rows meet by it whatever is null.
    base = cut(inside.join(edges, "at").select(F.struct("conv", "turn", "role").alias("key"), (F.col("before") + F.col("inside")).alias("base")), "base", keep=True)
    met = rows.withColumn("key", F.struct("conv", "turn", "role")).join(base, "key")
    place = F.col("base") + F.row_number().over(Window.partitionBy("key").orderBy("text")) - 1
    return met.withColumn("place", place).drop("key", "base")


def _whole(rows: DataFrame) -> DataFrame:
    """(conv, stretch, own_head, head, before, body): each conversation as one stretch. Turns are structs (role, text, tokens)."""
    packed = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))
    turns = F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), turn_tokens(t["text"]).alias("tokens")))
    packed = packed.select("conv", turns.alias("all")).withColumn("own_head", F.col("all")[0]["role"] == "system")
    rest = F.slice("all", F.lit(2), F.greatest(F.size("all") - 1, F.lit(0)))
    return packed.select(
        "conv", F.lit(0).cast("long").alias("stretch"), "own_head", F.when(F.col("own_head"), F.col("all")[0]).alias("head"),
        F.slice("all", 1, 0).alias("before"), F.when(F.col("own_head"), rest).otherwise(F.col("all")).alias("body"),
    )


def _stretches(rows: DataFrame, history: int, chunk: int) -> DataFrame:
    """As _whole, of long conversations: stretches of `chunk` turns by rank. `before`: the turns before a stretch that its first
    window may repeat, those of more tokens than the history without their text."""
    ranked = _ranked(rows).withColumn("tokens", turn_tokens(F.col("text"))).withColumn("is_head", (F.col("place") == 0) & (F.col("role") == "system"))
    own = F.floor(F.col("place") / chunk).cast("long")
    last = F.when(F.col("is_head"), own).otherwise(F.floor((F.col("place") + history // MARKS) / chunk).cast("long"))
    each = ranked.withColumn("own", own).withColumn("stretch", F.explode(F.sequence("own", last)))
    repeated = F.col("stretch") > F.col("own")
    text = F.when(~repeated | (F.col("tokens") <= history), F.col("text")).otherwise("")
    turn = F.struct("place", "role", text.alias("text"), "tokens")
    plain = lambda found: F.transform(F.array_sort(found), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["tokens"].alias("tokens")))
    packed = each.groupBy("conv", "stretch").agg(
        F.coalesce(F.max("is_head"), F.lit(False)).alias("own_head"), plain(F.collect_list(F.when(repeated, turn))).alias("before"),
        plain(F.collect_list(F.when(~repeated & ~F.col("is_head"), turn))).alias("body"),
    ).where("own_head or size(body) > 0")
    heads = ranked.where("is_head").select(F.struct("conv").alias("head_of"), F.struct("role", "text", "tokens").alias("head"))
    heads = cut(heads, "heads", keep=True)
    n_heads, chars = heads.agg(F.count("*"), F.coalesce(F.sum(F.length("head.text")), F.lit(0))).first()
    few = maybe_broadcast(heads, n_heads, 48 + 4 * chars // max(n_heads, 1))
    return packed.join(few, F.struct("conv") == F.col("head_of"), "left").select("conv", "stretch", "own_head", "head", "before", "body")


def _windows(turns: Column, head_tokens: Column, budget: int, history: int) -> Column:
    """Array of (i, again) of the windows over turns (tokens, is_new), those before a stretch first: a window's new turns begin
    with new turn i, and it repeats the `again` turns before that.

    One pass over the turns keeps the prefix sum, the tokens used in the window, and the prefix sums of the last turns, as far
    back as the history budget reaches (a turn has MARKS tokens or more).
    """
    state = "struct<i: int, upto: bigint, used: bigint, recent: array<bigint>, starts: array<struct<i: int, again: int>>>"
    none = F.from_json(F.lit('{"i": 0, "upto": 0, "used": 0, "recent": [], "starts": []}'), state)

    def take(s: Column, turn: Column) -> Column:
        t, is_new = turn["tokens"], turn["is_new"]
        goes_on = ~is_new | ((s["i"] > 0) & (s["used"] + t <= budget))
        low = s["upto"] - F.least(F.lit(history).cast("long"), F.lit(budget) - head_tokens - t)
        again = F.filter(s["recent"], lambda b: b >= low)
        opened = F.concat(s["starts"], F.array(F.struct(s["i"].alias("i"), F.size(again).alias("again"))))
        recent = F.concat(F.filter(s["recent"], lambda b: b >= s["upto"] + t - history), F.array(s["upto"]))
        return F.struct(
            (s["i"] + is_new.cast("int")).alias("i"),
            (s["upto"] + t).alias("upto"),
            F.when(goes_on, s["used"] + t).otherwise(head_tokens + s["upto"] - F.coalesce(F.array_min(again), s["upto"]) + t).alias("used"),
            recent.alias("recent"),
            F.when(goes_on, s["starts"]).otherwise(opened).alias("starts"),
        )

    return F.aggregate(turns, none, take, lambda s: s["starts"])


def format_chats(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = BUDGET,
    history: int = HISTORY,
    chunk: int = CHUNK,
) -> DataFrame:
    """(conv_col, window, n_repeated, formatted, loss_spans): one row for each window; window numbers grow within a conversation.

    Turns go by turn, then role and text; nulls first. n_repeated: the leading turns that an earlier window has too.
    loss_spans: (start, length) in characters of `formatted` of the new assistant texts, in order. The system turn is the
    first turn if its role is `system`. Null texts and roles are empty. Null conversation ids are one conversation; repeated
    rows are turns of their own. A window has at most `budget` tokens (see turn_tokens) but where one new turn, with the
    system turn, has more. In conversations of more than `chunk` turns a window ends after each `chunk` turns, and the next one
    repeats turns before it like any other. Other columns are ignored, whatever their names; an empty table gives none.
    """
    return reduce(DataFrame.unionByName, formatted_parts(turns, conv_col, turn_col, role_col, text_col, budget, history, chunk))


def formatted_parts(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = BUDGET,
    history: int = HISTORY,
    chunk: int = CHUNK,
) -> list[DataFrame]:
    """The windows of format_chats in tables of different conversations: those of `chunk` turns or fewer and, if there are any,
    the longer ones. The first table is partitioned by conversation, so that read_chats moves nothing of it."""
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    with tidy(turns.sparkSession):
        long_ones = cut(rows.groupBy("conv").count().where(F.col("count") > chunk).select(F.col("conv").alias("long_conv")), "long", keep=True)
        n_long = long_ones.count()
        if not n_long:
            return [_formatted(_whole(rows), conv_col, budget, history)]
        few, same = maybe_broadcast(long_ones, n_long, 64), F.col("conv").eqNullSafe(F.col("long_conv"))
        stretches = _stretches(rows.join(few, same, "left_semi"), history, chunk)
        return [_formatted(part, conv_col, budget, history) for part in (_whole(rows.join(few, same, "left_anti")), stretches)]


def _formatted(packed: DataFrame, conv_col: str, budget: int, history: int) -> DataFrame:
    """The windows over stretches (conv, stretch, own_head, head, before, body)."""
    packed = packed.withColumn("head_tokens", F.coalesce(F.col("head")["tokens"], F.lit(0).cast("long")))
    numbers = lambda name, is_new: F.transform(name, lambda t: F.struct(t["tokens"].alias("tokens"), F.lit(is_new).alias("is_new")))
    chosen = _windows(F.concat(numbers("before", False), numbers("body", True)), F.col("head_tokens"), budget, history)
    packed = packed.withColumn("starts", chosen)
    lone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("again")))
    packed = packed.withColumn("starts", F.when(F.size("body") == 0, lone).otherwise(F.col("starts")))

    # posexplode_outer, not posexplode: its filter for empty arrays would choose all windows twice.
    each = packed.select(
        "conv", "stretch", "head", "own_head", "starts", F.size("before").alias("n_before"), F.size("body").alias("n_new"),
        F.concat("before", "body").alias("both"), F.posexplode_outer("starts").alias("w", "start"),
    )
    each = each.withColumn("again", F.col("start.again")).withColumn(
        "upto", F.coalesce(F.get(F.col("starts"), F.col("w") + 1)["i"], F.col("n_new")),
    )
    listed = F.slice("both", F.col("n_before") + F.col("start.i") - F.col("again") + 1, F.col("upto") - F.col("start.i") + F.col("again"))
    listed = F.when(F.col("head").isNotNull(), F.concat(F.array("head"), listed)).otherwise(listed)
    repeats_head = F.col("head").isNotNull() & ~(F.col("own_head") & (F.col("w") == 0))
    each = each.select(
        "conv", (F.col("stretch") * (1 << 20) + F.col("w")).alias("window"), (F.col("again") + repeats_head.cast("int")).alias("n_repeated"),
        listed.alias("turns"),
    )

    parts = F.transform(
        "turns",
        lambda t: F.struct(
            t["role"].alias("role"), F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n")).alias("opening"),
            escape(t["text"]).alias("body"),
        ),
    )
    each = each.select("conv", "window", "n_repeated", parts.alias("parts"))
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["opening"], p["body"], F.lit(END + "\n"))), "")
    sizes = F.transform(
        "parts",
        lambda p, i: F.struct(i.alias("i"), p["role"].alias("role"), F.length(p["opening"]).alias("o"), F.length(p["body"]).alias("b")),
    )
    none = F.struct(
        F.expr("cast(array() as array<struct<start: bigint, length: bigint>>)").alias("spans"), F.lit(0).cast("long").alias("at"),
    )

    def span(state: Column, p: Column) -> Column:
        own = F.array(F.struct((state["at"] + p["o"]).alias("start"), p["b"].cast("long").alias("length")))
        targets = (p["role"] == "assistant") & (p["i"] >= F.col("n_repeated"))
        return F.struct(
            F.when(targets, F.concat(state["spans"], own)).otherwise(state["spans"]).alias("spans"),
            (state["at"] + p["o"] + p["b"] + len(END) + 1).alias("at"),
        )

    return each.select(
        F.col("conv").alias(conv_col), "window", "n_repeated", formatted.alias("formatted"),
        F.aggregate(sizes, none, span, lambda s: s["spans"]).alias("loss_spans"),
    )


def _turns_in(formatted: Column) -> Column:
    """The turns (role, text) of a formatted window."""
    body = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda t, i: i > 0)

    def turn(t: Column) -> Column:
        role = F.substring_index(t, "\n", 1)
        return F.struct(
            F.url_decode(role).alias("role"),
            unescape(t.substr(F.length(role) + 2, F.length(t) - F.length(role) - 2 - len(END))).alias("text"),
        )

    return F.transform(body, turn)


def read_chats(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv_col, turns, loss_text, formatted_chars) of each conversation, from its windows: its turns (role, text), each
    once, all text under the loss mask, unescaped, in order, and the characters of all windows. Windows are gathered once, and
    a conversation is one row."""
    whole = windows.groupBy(conv_col).agg(F.sort_array(F.collect_list(F.struct("window", "n_repeated", "formatted", "loss_spans"))).alias("parts"))
    turns = F.flatten(F.transform("parts", lambda p: F.filter(_turns_in(p["formatted"]), lambda t, i: i >= p["n_repeated"])))
    cut_out = lambda p: F.array_join(F.transform(p["loss_spans"], lambda s: unescape(p["formatted"].substr((s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    loss = F.array_join(F.transform("parts", cut_out), "")
    chars = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.length(p["formatted"]))
    return whole.select(conv_col, turns.alias("turns"), loss.alias("loss_text"), chars.alias("formatted_chars"))
