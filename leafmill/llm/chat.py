"""Chat formatting in budgeted windows.

Prefix sums of turn tokens cut a conversation into turn-aligned spans. Every span is preceded by the
conversation's system turn and by a limited history repeated from before it; both are masked, so each
assistant turn is a target once. A span has at most `stride` tokens (the budget less system turn and
history); a turn that alone has more is a span by itself, never cut.

Prefix sums are computed in chunks of turns with chunk offsets, and windows are grouped by
(conversation, span), so no task needs a whole conversation.

Template: <|im_start|>role newline text <|im_end|> newline. In roles and texts, a backslash becomes
two, and <| gets a backslash between, so no text can hold a control string; newlines of a role become
backslash-slash. All of it can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, text_or_empty

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of the template around a turn.
FRAME_TOKENS = 4


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\/"))


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\/", "$1\n"))


def turn_tokens(text: Column) -> Column:
    """Words, long words by the started eight characters, and the frame."""
    return F.greatest(F.regexp_count(text, F.lit(WORD)), F.ceil(F.length(text) / 8)).cast("long") + F.lit(FRAME_TOKENS)


def chat_windows(
    turns: DataFrame,
    max_tokens: int = 2_048,
    history_tokens: int = 256,
    chunk_turns: int = 256,
    target_role: str = "assistant",
) -> DataFrame:
    """turns: conv_id, turn, role, text. One row per window: conv_id, window (ordered), formatted,
    n_repeated (leading turns that are repeats), loss (array of 0-based start and length in
    characters of formatted).

    Null text and role are empty; null turns come first; ties are ordered by role and text; repeated
    rows are turns of their own. A null conv_id is a conversation. Only a system turn that comes
    first is kept in every window. Conversations without rows don't exist; an empty table gives an
    empty result. Extra columns are ignored.
    """
    rows = turns.select(
        F.col("conv_id").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        text_or_empty("role").alias("role"),
        text_or_empty("text").alias("text"),
    ).withColumn("chunk", F.coalesce(F.floor(F.col("turn") / chunk_turns), F.lit(-(2**62))).cast("long"))
    rows = rows.withColumn("tokens", turn_tokens(F.col("text"))).withColumn("conv", F.to_json(F.struct("conv_id")))

    # What each chunk holds, and the conversation's first turn.
    order = F.struct(F.coalesce("turn", F.lit(-(2**62))), "role", "text")
    chunks = rows.groupBy("conv", "chunk").agg(
        F.sum("tokens").alias("chunk_tokens"), F.count("*").alias("chunk_rows"), F.min_by(F.struct("role", "text", "tokens"), order).alias("head")
    )
    by_conv = Window.partitionBy("conv").orderBy("chunk")
    earlier = by_conv.rowsBetween(Window.unboundedPreceding, -1)
    head = F.first("head").over(by_conv.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    chunks = chunks.select(
        F.col("conv").alias("c"),
        F.col("chunk").alias("k"),
        F.coalesce(F.sum("chunk_tokens").over(earlier), F.lit(0)).alias("before"),
        F.coalesce(F.sum("chunk_rows").over(earlier), F.lit(0)).alias("turns_before"),
        F.when(head["role"] == "system", head).alias("system"),
    )
    within = Window.partitionBy("conv", "chunk").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = (
        rows.withColumn("run", F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(within))
        .join(chunks, (F.col("conv") == F.col("c")) & (F.col("chunk") == F.col("k")))
    )
    system_tokens = F.coalesce(F.col("system")["tokens"], F.lit(0))
    placed = placed.select(
        "conv", "conv_id", "role", "text", "tokens", "system",
        (F.col("turns_before") + F.col("nth") - 1).alias("at"),
        (F.col("before") + F.col("run") - F.col("tokens")).alias("start"),
        F.greatest(F.lit(max_tokens // 8), F.lit(max_tokens - history_tokens) - system_tokens).alias("stride"),
    )

    # Even windows hold the turns that lie inside one stride; a turn that crosses into the next is an odd one.
    cell = F.floor(F.col("start") / F.col("stride"))
    last_cell = F.floor((F.col("start") + F.col("tokens") - 1) / F.col("stride"))
    placed = placed.withColumn("cell", cell).withColumn("crosses", last_cell > cell)
    placed = placed.withColumn("window", F.col("cell") * 2 + F.col("crosses").cast("long"))
    in_cell = Window.partitionBy("conv", "cell")
    placed = placed.withColumn("cross_at", F.min(F.when(F.col("crosses"), F.col("start"))).over(in_cell))

    # A turn repeats in the window after its own if it ends the limited history before it.
    stop = F.col("start") + F.col("tokens")
    after_cross = F.floor(stop / F.col("stride"))
    next_cell = (F.col("cell") + 1) * F.col("stride")
    to = (
        F.when(F.col("crosses") & (F.col("tokens") <= history_tokens), after_cross * 2)
        .when(~F.col("crosses") & (F.col("cross_at") - F.col("start") <= history_tokens), F.col("window") + 1)
        .when(~F.col("crosses") & F.col("cross_at").isNull() & (next_cell - F.col("start") <= history_tokens), F.col("window") + 2)
    )
    is_system = (F.col("at") == 0) & F.col("system").isNotNull()
    uses = F.filter(
        F.array(
            F.struct(F.col("window").alias("window"), F.lit(False).alias("again")),
            F.struct(F.when(~is_system, to).alias("window"), F.lit(True).alias("again")),
        ),
        lambda u: u["window"].isNotNull(),
    )
    part = placed.select("conv", "conv_id", "at", "role", "text", "system", F.inline(uses))
    piece = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END + "\n"))
    part = part.select(
        "conv", "conv_id", "window", "system", F.struct("at", "again", "role", piece.alias("piece"), F.length(escape(F.col("text"))).alias("n")).alias("x")
    )
    grouped = part.groupBy("conv", "window").agg(
        F.first("conv_id").alias("conv_id"), F.first("system").alias("system"), F.sort_array(F.collect_list("x")).alias("xs")
    )
    grouped = grouped.filter(F.exists("xs", lambda x: ~x["again"]))

    # The system turn leads where the window doesn't hold it as its own first turn.
    lead_role, lead_text = F.col("system")["role"], F.col("system")["text"]
    lead = F.when(
        F.col("system").isNotNull() & (F.get("xs", F.lit(0))["at"] > 0),
        F.array(
            F.struct(
                F.lit(-1).cast("long").alias("at"), F.lit(True).alias("again"), lead_role.alias("role"),
                F.concat(F.lit(START), escape_role(lead_role), F.lit("\n"), escape(lead_text), F.lit(END + "\n")).alias("piece"),
                F.length(escape(lead_text)).alias("n"),
            )
        ),
    ).otherwise(F.expr("array()").cast("array<struct<at:bigint,again:boolean,role:string,piece:string,n:int>>"))
    whole = grouped.select("conv_id", "window", F.concat(lead, F.col("xs").cast("array<struct<at:bigint,again:boolean,role:string,piece:string,n:int>>")).alias("xs"))

    spans = F.aggregate(
        "xs",
        F.struct(F.lit(0).alias("at"), F.expr("array()").cast("array<struct<start:int,length:int>>").alias("loss")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["piece"])).alias("at"),
            F.when(
                ~x["again"] & (x["role"] == target_role),
                F.concat(a["loss"], F.array(F.struct((a["at"] + F.length(x["piece"]) - x["n"] - len(END) - 1).alias("start"), x["n"].alias("length")))),
            ).otherwise(a["loss"]).alias("loss"),
        ),
        lambda a: a["loss"],
    )
    return whole.select(
        "conv_id",
        "window",
        F.array_join(F.transform("xs", lambda x: x["piece"]), "").alias("formatted"),
        F.size(F.filter("xs", lambda x: x["again"])).alias("n_repeated"),
        spans.alias("loss"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Read formatted windows back: conv_id, window, turns (array of role and text, repeats left out),
    loss_text (unescaped), formatted_chars."""
    pieces = F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda x, i: i > 0)
    turn = lambda x: F.struct(
        unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
        _text_of(x).alias("text"),
    )
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return windows.select(
        "conv_id",
        "window",
        F.transform(F.filter(pieces, lambda x, i: i >= F.col("n_repeated")), turn).alias("turns"),
        loss.alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _text_of(piece: Column) -> Column:
    head = F.length(F.substring_index(piece, "\n", 1)) + 1
    return unescape(F.substring(piece, head + 1, F.length(piece) - head - len(END) - 1))
