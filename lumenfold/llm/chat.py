"""Chat formatting in budgeted windows.

Prefix sums of turn tokens choose turn-aligned spans of a conversation.  Each window
starts with the conversation's system turn and repeats the tail of the window before
it; the repeated turns are context only, so every assistant turn is under the loss
mask of exactly one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's control strings, and others that texts may hold.
START, END = "<|im_start|>", "<|im_end|>"
CONTROL = r"([<\[])(?=\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|</?SYS>>)"


def escaped(text: Column) -> Column:
    """Double each backslash and put one inside each control string: none is left whole."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    """A backslash pair is one backslash; a single one is dropped."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def chat_windows(
    conversations: DataFrame,
    budget: int = 1024,
    history_turns: int = 2,
    history_tokens: int = 256,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    target: str = "assistant",
    tokens: str | None = None,
) -> DataFrame:
    """One row per window: conv_id, window, n_context, formatted, loss, n_tokens, over_budget.

    n_context: the leading turns that are repeated (system turn and history).  loss:
    [start, end) code-point spans of the target texts.  n_tokens counts a turn as its
    words plus 4, or by the column `tokens` (a tokenizer's count; null is 0), so that the
    budget holds in that tokenizer.  A window goes over the budget only if one turn with the system turn
    and the history does; it is kept whole and flagged.  Rows are taken by turn, then
    role and text; null turns come first, null texts and roles are empty; a null conv_id
    is a conversation of its own.  Repeated rows are turns of their own; rows that tie in turn, role
    and text are equal, so their order does not matter.  A conversation
    without turns has no rows, so an empty table gives none.  Extra columns are ignored.
    """
    rows = conversations.select(
        F.col(conv).alias("_conv"),
        F.col(turn).alias("_turn"),
        F.coalesce(F.col(role), F.lit("")).alias("_role"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
        (F.lit(None) if tokens is None else F.coalesce(F.col(tokens), F.lit(0))).cast("int").alias("_tokens"),
    )
    if tokens is None:
        rows = rows.withColumn("_tokens", F.regexp_count("_text", F.lit(r"\S+")) + 4)
    by_turn = Window.partitionBy("_conv").orderBy("_turn", "_role", "_text")
    whole = Window.partitionBy("_conv")
    rows = rows.withColumn("_pos", F.row_number().over(by_turn))
    rows = rows.withColumn("_sys", (F.col("_pos") == 1) & (F.col("_role") == "system"))
    running = Window.partitionBy("_conv").orderBy("_pos")
    rows = (
        rows.withColumn("_before", F.sum("_tokens").over(running) - F.col("_tokens"))
        .withColumn("_sys_tokens", F.max(F.when(F.col("_sys"), F.col("_tokens")).otherwise(0)).over(whole))
        .withColumn("_most", F.max(F.when(~F.col("_sys"), F.col("_tokens")).otherwise(1)).over(whole))
    )
    # turns that begin within one stride make a window, so it holds at most stride - 1 + most tokens of its own
    stride = F.greatest(F.lit(budget - history_tokens) - F.col("_sys_tokens") - F.col("_most"), F.lit(1))
    rows = rows.withColumn("_span", F.floor((F.col("_before") - F.col("_sys_tokens")) / stride))
    rows = rows.withColumn("_span", F.when(F.col("_sys"), F.lit(0)).otherwise(F.col("_span")))
    rows = rows.withColumn("_window", F.dense_rank().over(Window.partitionBy("_conv").orderBy("_span")) - 1)
    rows = rows.withColumn("_last", F.max("_window").over(whole))
    tail = Window.partitionBy("_conv", "_window").orderBy(F.col("_pos").desc())
    rows = rows.withColumn("_rank", F.row_number().over(tail)).withColumn("_tail", F.sum("_tokens").over(tail))

    system = F.col("_sys")
    repeat = (
        ~system
        & (F.col("_rank") <= history_turns)
        & (F.col("_tail") <= history_tokens)
        & (F.col("_window") < F.col("_last"))
    )
    own = F.struct(F.col("_window").alias("w"), F.lit(False).alias("context"))
    copies = F.when(
        system,
        F.transform(F.sequence(F.lit(0), F.col("_last")), lambda w: F.struct(w.alias("w"), (w > 0).alias("context"))),
    ).when(repeat, F.array(own, F.struct((F.col("_window") + 1).alias("w"), F.lit(True).alias("context"))))
    rows = rows.withColumn("_copy", F.explode(F.coalesce(copies, F.array(own))))

    head = F.concat(F.lit(START), F.expr("url_encode(_role)"), F.lit("\n"))
    body = escaped(F.col("_text"))
    piece = F.concat(head, body, F.lit(END + "\n"))
    rows = rows.select(
        "_conv",
        F.col("_copy.w").alias("_w"),
        F.struct(
            F.col("_pos").alias("pos"),
            F.col("_copy.context").alias("context"),
            piece.alias("piece"),
            F.length(head).alias("head"),
            F.length(piece).alias("size"),
            (~F.col("_copy.context") & (F.col("_role") == target)).alias("target"),
            F.col("_tokens").alias("tokens"),
        ).alias("_t"),
    )
    # one window's turns, bounded by the budget
    each = rows.groupBy("_conv", "_w").agg(F.array_sort(F.collect_list("_t")).alias("_ts"))
    tail_size = len(END) + 1
    spans = F.expr(
        f"""filter(aggregate(_ts, named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,end:int>>)),
        (a, t) -> named_struct('at', a.at + t.size, 'spans', if(t.target,
            concat(a.spans, array(named_struct('start', a.at + t.head, 'end', a.at + t.size - {tail_size}))), a.spans)),
        a -> a.spans), s -> true)"""
    )
    tokens = F.aggregate(F.col("_ts"), F.lit(0), lambda a, t: a + t["tokens"])
    return each.select(
        F.col("_conv").alias(conv),
        F.col("_w").cast("long").alias("window"),
        F.size(F.filter("_ts", lambda t: t["context"])).alias("n_context"),
        F.array_join(F.transform("_ts", lambda t: t["piece"]), "").alias("formatted"),
        spans.alias("loss"),
        tokens.cast("long").alias("n_tokens"),
        (tokens > budget).alias("over_budget"),
    )


def read_back(windows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation, from the formatted windows alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Null texts and roles come back empty; a null conversation id is one conversation; windows are
    taken by number, and there are no two of one; an empty table gives no rows; extra columns are ignored.
    """
    turns = F.split(F.col("formatted"), r"<\|im_end\|>\n")
    turns = F.slice(turns, F.col("n_context") + 1, F.size(turns) - 1 - F.col("n_context"))
    found = windows.select(
        F.col(conv).alias("_conv"),
        "window",
        F.length("formatted").alias("_chars"),
        F.size(turns).alias("_n"),
        F.array_join(
            F.expr(
                f"""transform(slice(split(formatted, '<\\\\|im_end\\\\|>\\\\n'), n_context + 1,
                size(split(formatted, '<\\\\|im_end\\\\|>\\\\n')) - 1 - n_context),
                t -> concat(url_decode(substring_index(substr(t, {len(START) + 1}), '\\n', 1)), '\\n',
                regexp_replace(substr(t, position('\\n' in t) + 1), '\\\\\\\\(\\\\\\\\?)', '$1'), '\\n'))"""
            ),
            "",
        ).alias("_said"),
        F.array_join(
            F.expr(
                "transform(loss, s -> regexp_replace(substr(formatted, s.start + 1, s.end - s.start), '\\\\\\\\(\\\\\\\\?)', '$1'))"
            ),
            "",
        ).alias("_loss"),
    )
    whole = found.groupBy("_conv").agg(
        F.sum("_n").cast("long").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("window", "_said", "_loss"))).alias("_ws"),
        F.sum("_chars").cast("long").alias("formatted_chars"),
    )
    loss = F.array_join(F.transform("_ws", lambda w: w["_loss"]), "")
    return whole.select(
        F.col("_conv").alias(conv),
        "n_turns",
        F.sha2(F.array_join(F.transform("_ws", lambda w: w["_said"]), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
