"""Chat formatting with typed content parts.

A message has either a text or an array of parts `struct<type, text, ref, tokens>` with type text, image, audio or
document. A visitor flattens the parts in order: text is escaped, any other part becomes a numbered placeholder such as
`<|image:0|>`, its reference is recorded, and its token count is added to the expanded count.

Escaping is reversible: every `<`, `!`..., `|` run in a text gets one more `!`, so a text never holds `<|`, and each
control string in the output is the template's own. All steps are Spark expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
PART = "struct<type:string,text:string,ref:string,tokens:bigint>"


def escape(x: Column) -> Column:
    return F.regexp_replace(x, r"<(!*)\|", "<!$1|")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"<!(!*)\|", "<$1|")


def _is_text(p: Column) -> Column:
    return F.coalesce(p["type"], F.lit("text")) == "text"


def _visit(parts: Column, base: Column) -> Column:
    """The flattened body of one message; `base` attachments came before it in the conversation. Neighbouring texts are
    joined before they are escaped, so no control string arises where they meet."""

    def step(s, p):
        text = F.concat(s["open"], F.coalesce(p["text"], F.lit("")))
        placeholder = F.concat(F.lit("<|"), escape(p["type"]), F.lit(":"), (base + s["n"]).cast("string"), F.lit("|>"))
        done = F.concat(s["done"], escape(s["open"]), placeholder)
        more = F.struct(s["done"].alias("done"), text.alias("open"), s["n"].alias("n"))
        return F.when(_is_text(p), more).otherwise(F.struct(done.alias("done"), F.lit("").alias("open"), (s["n"] + 1).alias("n")))

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))
    return F.aggregate(parts, start, step, lambda s: F.concat(s["done"], escape(s["open"])))


def _has_parts(messages: DataFrame) -> bool:
    kind = messages.schema["parts"].dataType if "parts" in messages.columns else None
    fields = getattr(getattr(kind, "elementType", None), "fields", [])
    return [f.name for f in fields] == ["type", "text", "ref", "tokens"]


def chat_format(messages: DataFrame) -> DataFrame:
    """One row for each conv_id: `formatted`, n_turns, loss_spans (start and length in code points of each assistant
    body, text and placeholders), attachments (index, type, ref, tokens) in order and attachment_tokens, their sum.

    Messages go by turn (nulls first); ties by role, then text. Null role, text and parts count as empty; repeated
    rows stay repeated turns; a null conv_id is a conversation of its own. An optional column `parts` (array of
    struct<type,text,ref,tokens>) takes the place of text where it is not null; a null part is an empty text, and a column
    of that name and any other type is ignored. Other columns are ignored; an empty
    table gives an empty result. A conversation is one row, so one task holds one conversation at a time.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    null = F.lit(None).cast("string")
    own = F.array(
        F.struct(F.lit("text").alias("type"), text.alias("text"), null.alias("ref"), F.lit(0).cast("long").alias("tokens"))
    ).cast(f"array<{PART}>")
    parts = F.coalesce(F.col("parts").cast(f"array<{PART}>"), own) if _has_parts(messages) else own
    df = messages.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), parts.alias("parts"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text", F.to_json("parts"))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    files = F.filter("parts", lambda p: ~_is_text(p))
    df = df.withColumn("files", files).withColumn("n", F.row_number().over(order))
    df = df.withColumn("base", F.sum(F.size("files")).over(so_far) - F.size("files"))
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
    df = df.withColumn("head", head).withColumn("body", _visit(F.col("parts"), F.col("base")))
    size = F.length("head") + F.length("body") + len(END) + 1
    df = df.withColumn("start", F.sum(size).over(so_far) - size + F.length("head"))
    message = F.struct("n", "role", "head", "body", "start", "files", "base")
    df = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("m"))
    attachments = F.flatten(
        F.transform(
            "m",
            lambda x: F.transform(
                x["files"],
                lambda p, i: F.struct((x["base"] + i).alias("index"), p["type"].alias("type"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(0)).alias("tokens")),
            ),
        )
    )
    spans = F.transform(
        F.filter("m", lambda x: x["role"] == "assistant"),
        lambda x: F.struct(x["start"].cast("long").alias("start"), F.length(x["body"]).cast("long").alias("length")),
    )
    return df.select(
        "conv_id",
        F.array_join(F.transform("m", lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))), "").alias("formatted"),
        F.size("m").cast("long").alias("n_turns"),
        spans.alias("loss_spans"),
        attachments.alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> parsed from a formatted conversation and unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda x, i: i > 0)
    def parse(x):
        head = F.substring_index(x, "\n", 1)
        body = F.substring_index(F.substring(x, F.length(head) + 2, F.length(x)), END, 1)
        return F.struct(unescape(F.replace(head, F.lit(NEWLINE), F.lit("\n"))).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, parse)
