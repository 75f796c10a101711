"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and only its own text is
trainable. A conversation that ends otherwise gets one more example, all of it, with nothing to train on, so that
no turn is lost. Turns are marked as ``<|im_start|>role``, newline, text, ``<|im_end|>``, newline; in texts and roles
``&`` is written ``&amp;`` and ``<|`` is written ``&lt;|``, and in roles a newline ``&#10;``, which is undone on reading.

A conversation is gathered once and expanded in its own row, and nothing longer than a turn is shuffled: the
examples of one conversation hold its prefixes, so each needs all turns before it anyway. A row holds one
conversation; that is the bound of this method.

Defined results: turns are ordered by turn (null first), role and text, ties and repeated rows kept; a null text or role
counts as empty; a null ``conv_id`` is one conversation; further columns are ignored; an empty table has no examples.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
ESCAPES = (("&", "&amp;"), ("<|", "&lt;|"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "&#10;"))
TRAINED = "assistant"


def escape(text: Column, pairs: tuple = ESCAPES) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def unescape(text: Column, pairs: tuple = ESCAPES) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[1]), F.lit(p[0])), reversed(pairs), text)


def opening(role: Column) -> Column:
    return F.concat(F.lit(BEGIN), escape(role, ROLE_ESCAPES), F.lit("\n"))


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, whole, formatted, loss_start, loss_end) with the loss as a range of code points of ``formatted``.

    ``example`` is the place of the target turn from 1 on; ``whole`` marks the one that holds all turns. Without a
    target both ends of the loss are 0.
    """
    said = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(said)).alias("_said"))
    talks = talks.select(
        "conv_id",
        F.size("_said").alias("_n"),
        F.transform("_said", lambda t: t["role"] == TRAINED).alias("_trained"),
        F.transform("_said", lambda t: opening(t["role"])).alias("_heads"),
        F.transform("_said", lambda t: escape(t["text"])).alias("_texts"),
    )
    places = F.filter(F.sequence(F.lit(1), F.col("_n")), lambda k: F.element_at("_trained", k) | (k == F.col("_n")))
    shown = F.zip_with("_heads", "_texts", lambda h, t: F.concat(h, t, F.lit(END)))
    each = talks.withColumn("_shown", shown).select("*", F.explode(places).alias("example"))
    trained = F.element_at("_trained", F.col("example"))
    context = F.array_join(F.slice("_shown", F.lit(1), F.col("example") - 1), "")
    head, text = F.element_at("_heads", F.col("example")), F.element_at("_texts", F.col("example"))
    each = each.select("conv_id", "example", "_n", trained.alias("_trained"), context.alias("_context"), head.alias("_head"), text.alias("_text"))
    start = F.length("_context") + F.length("_head")
    return each.select(
        "conv_id",
        "example",
        (F.col("example") == F.col("_n")).alias("whole"),
        F.concat("_context", "_head", "_text", F.lit(END)).alias("formatted"),
        F.when(F.col("_trained"), start).otherwise(0).alias("loss_start"),
        F.when(F.col("_trained"), start + F.length("_text")).otherwise(0).alias("loss_end"),
    )


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    """What the loss mask covers, as it was said."""
    return unescape(F.substring(formatted, start + 1, end - start))


def turns_of(formatted: Column) -> Column:
    """Turns read back from an example: array of (role, text)."""
    parts = F.split(formatted, "<\\|im_end\\|>\n")
    bodies = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.substring(p, F.lit(len(BEGIN) + 1), F.length(p)))

    def turn(body: Column) -> Column:
        role = F.substring_index(body, "\n", 1)
        return F.struct(
            unescape(role, ROLE_ESCAPES).alias("role"),
            unescape(F.substring(body, F.length(role) + 2, F.length(body))).alias("text"),
        )

    return F.transform(bodies, turn)


def read_back(formatted: DataFrame) -> DataFrame:
    """By conversation, from its examples alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    # Turns are read from the one example that holds all of them.
    whole = F.when(F.col("whole"), turns_of(F.col("formatted")))
    each = formatted.select(
        "conv_id",
        "example",
        F.length("formatted").cast("long").alias("_chars"),
        loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("_loss"),
        whole.alias("_turns"),
    )
    each = each.withColumn("_said", F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""))
    by_talk = each.groupBy("conv_id").agg(
        F.sum("_chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("example", "_loss"))).alias("_losses"),
        F.max(F.size("_turns")).cast("long").alias("n_turns"),
        F.first("_said", ignorenulls=True).alias("_said"),
    )
    loss = F.array_join(F.transform("_losses", lambda x: x["_loss"]), "")
    return by_talk.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("_said").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
