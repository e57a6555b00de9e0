"""Chat formatting with typed content parts, in built-in functions only.

A message is a row (conversation, turn, role, parts); `parts` is an array of
struct<type, text, uri, tokens>. The visitor below turns each part into text:
a text part into itself with control strings escaped, any other known part into
a placeholder and one attachment reference. A turn is

    <|turn|>ROLE<|text|>CONTENT<|end|>

Escaping doubles each backslash and puts one between `<` and `|`, so a control
string never occurs inside a role or a text, and unescape() restores both.

Cases: no rows give no rows. A null role or text is empty, null parts are none,
an unknown part type is kept as `<|document|>`-like placeholder `<|unknown|>`.
Rows that tie in turn are ordered by role and content; equal rows all stay.
Null turns come first. A null conversation id is a group of its own. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
KINDS = ("image", "audio", "document")
PARTS = "array<struct<type:string,text:string,uri:string,tokens:bigint>>"


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """A message of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(0).cast("bigint").alias("tokens"))).cast(PARTS)


def _visit(part: Column) -> Column:
    """The flat form of a part, by its type."""
    seen = F.when((part["type"] == "text") | part["type"].isNull(), escape(part["text"]))
    for kind in KINDS:
        seen = seen.when(part["type"] == kind, F.lit(f"<|{kind}|>"))
    return seen.otherwise(F.lit("<|unknown|>"))


def format_conversations(messages: DataFrame, default_tokens: dict[str, int] | None = None) -> DataFrame:
    """messages(conv_id, turn, role, parts) to one row per conversation.

    Returns conv_id, n_turns, formatted, loss_mask (array of struct<start, length>, code
    points counted from 1, one for each assistant turn in order), attachments (array of
    struct<position, turn_index, type, uri, tokens> in order of their placeholders) and
    expanded_tokens (sum of the attachments' tokens). A part without tokens takes
    default_tokens[type].
    """
    default = {"image": 256, "audio": 128, "document": 512} | (default_tokens or {})
    parts = F.coalesce(F.col("parts").cast(PARTS), F.array().cast(PARTS))
    parts = F.filter(parts, lambda p: p.isNotNull())
    content = F.array_join(F.transform(parts, _visit), "")
    other = F.filter(parts, lambda p: F.coalesce(p["type"], F.lit("text")) != "text")

    def tokens(p: Column) -> Column:
        preset = F.coalesce(*[F.when(p["type"] == k, F.lit(v)) for k, v in default.items()], F.lit(0))
        return F.coalesce(p["tokens"], preset.cast("bigint"))

    head = F.concat(F.lit(TURN), F.col("role"), F.lit(TEXT))
    rows = messages.select("conv_id", "turn", escape(F.col("role")).alias("role"), content.alias("content"), other.alias("other"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content", "other")
    placed = (
        rows.withColumn("piece", F.concat(head, "content", F.lit(END)))
        .withColumn("seq", F.row_number().over(order).cast("bigint"))
        .withColumn("before", F.sum(F.length("piece").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    )
    start = F.coalesce("before", F.lit(0).cast("bigint")) + F.length(head) + 1
    span = F.when(F.col("role") == "assistant", F.struct(start.alias("start"), F.length("content").cast("bigint").alias("length")))
    refs = F.transform("other", lambda p: F.struct((F.col("seq") - 1).alias("turn_index"), p["type"].alias("type"), p["uri"].alias("uri"), tokens(p).alias("tokens")))
    turns = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seq", "piece", span.alias("span"), refs.alias("refs")))).alias("turns"))
    ordered = F.flatten(F.col("turns.refs"))
    attachments = F.transform(ordered, lambda r, i: F.struct(i.cast("bigint").alias("position"), r["turn_index"].alias("turn_index"), r["type"].alias("type"), r["uri"].alias("uri"), r["tokens"].alias("tokens")))
    return turns.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss_mask"),
        attachments.alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, x: n + x["tokens"]))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of struct<role, text>, unescaped; placeholders stay."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: x != "")
    body = lambda x: F.substring_index(x, END, 1)
    return F.transform(pieces, lambda x: F.struct(unescape(F.substring_index(body(x), TEXT, 1)).alias("role"), unescape(F.substring_index(body(x), TEXT, -1)).alias("text")))


def with_loss_text(conversations: DataFrame, name: str = "loss") -> DataFrame:
    """The rows of format_conversations() with all text under their loss masks, unescaped, end to end, as a last column.

    Each turn of the text and each span of the mask is a row with its place; a span is cut from the turn
    that begins last before it, so a conversation is gone through once, however many turns it has.
    """
    keyed = conversations.select("conv_id", "formatted", "loss_mask")
    turns = keyed.select("conv_id", F.posexplode(F.split("formatted", r"<\|turn\|>")).alias("pos", "piece")).where("pos > 0")
    before = F.sum(F.length("piece").cast("bigint") + len(TURN)).over(Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    turns = turns.select("conv_id", (F.coalesce(before, F.lit(0)) + len(TURN) + 1).alias("at"), F.lit(None).cast("bigint").alias("length"), "piece")
    spans = keyed.select("conv_id", F.inline("loss_mask")).select("conv_id", F.col("start").alias("at"), "length", F.lit(None).cast("string").alias("piece"))
    so_far = Window.partitionBy("conv_id").orderBy("at", F.col("length").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    met = turns.unionByName(spans).select("conv_id", "at", "length", F.last(F.when(F.col("piece").isNotNull(), F.struct("at", "piece")), ignorenulls=True).over(so_far).alias("turn")).where("length is not null")
    cut = met.select("conv_id", "at", unescape(F.substring("turn.piece", (F.col("at") - F.col("turn.at") + 1).cast("int"), F.col("length").cast("int"))).alias("said"))
    said = cut.groupBy(F.col("conv_id").alias("__of")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "said"))), lambda x: x["said"]), "").alias("__said"))
    joined = conversations.join(said, F.col("conv_id").eqNullSafe(F.col("__of")), "left")
    return joined.withColumn(name, F.coalesce("__said", F.lit(""))).drop("__of", "__said")
