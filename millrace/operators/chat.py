"""Chat turns: role names, positional pairs, filters, conversation statistics and training formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.functions.ladder import first_of
from millrace.plans.ranges import placed

#: Role spellings; phrases that lead to removal, assistants' stock phrases, whole answers of low quality.
USER_ROLES, ASSISTANT_ROLES = ("user", "human"), ("assistant", "ai", "model", "bot")
BLACKLIST = [r"\bnot nothing\b", r"\bhold(?:ing)? space\b", r"\bunpack that\b", r"\bcircle back\b", r"\btouch base\b", r"\bsynergize\b", r"\bleverage\b", r"\bthink outside the box\b", r"\blow-hanging fruit\b", r"\bmove the needle\b", r"\bparadigm shift\b"]
SLOP = [r"\bI appreciate you\b", r"\bI hear you\b", r"\bthat resonates\b", r"\bI'm here for you\b", r"\bvalidate your feelings\b", r"\bin this space\b"]
LOW_QUALITY = r"(?i)^(?:ok|okay|yes|no|sure|thanks|thank you)\.?$|^\.{3,}$"


def normal_role(c="role"):
    """user, assistant or system whatever the spelling; null for null and unknown roles."""
    r = F.lower(tx.strip(c))
    return F.when(r.isin(*USER_ROLES), "user").when(r.isin(*ASSISTANT_ROLES), "assistant").when(r == "system", "system")


def turns(conversation: DataFrame) -> DataFrame:
    """One row a message: normal role, stripped text, file and format; messages delivered again count once."""
    rows = conversation.select("msg_id", "conv_id", "turn", normal_role().alias("role"), tx.strip("content").alias("text"), F.lower(tx.strip("source_format")).alias("format"), "source_file", "created_ts")
    return rows.dropDuplicates(["msg_id"])


def ordered(rows: DataFrame, conv: str = "conv_id", order: tuple = ("turn", "msg_id")) -> DataFrame:
    """With i, the 0-based place of the message in its conversation, and the next message's role and text."""
    return placed(rows, [conv], list(order), "i", {"next_role": "role", "next_text": "text"})


def positional_pairs(rows: DataFrame, conv: str = "conv_id", order: tuple = ("turn", "msg_id")) -> DataFrame:
    """Messages 0 and 1, 2 and 3 and so on, where the first is a user's and the second an assistant's.

    A leading system turn shifts all pairs; a message without a partner gives none.
    """
    hit = (F.col("i") % 2 == 0) & (F.col("role") == "user") & (F.col("next_role") == "assistant")
    return ordered(rows, conv, order).where(hit).select(conv, "i", F.col("text").alias("instruction"), F.col("next_text").alias("response"))


def adjacent_pairs(rows: DataFrame, conv: str = "conv_id", order: tuple = ("turn", "msg_id")) -> DataFrame:
    """Every user message with the assistant message right after it."""
    return ordered(rows, conv, order).where((F.col("role") == "user") & (F.col("next_role") == "assistant")).select(conv, "i", F.col("text").alias("instruction"), F.col("next_text").alias("response"))


def matched_pattern(c, patterns: list[str]):
    """The first pattern, in the list's order, that matches anywhere without regard to case."""
    return first_of([(tx.col(c).rlike(f"(?i){p}"), p) for p in patterns], None).cast("string")


def filter_reason(c, patterns: list[str] | None = None, slop: bool = True, custom: list[str] = (), min_length: int = 10, toxic=None, threshold: float = 0.8):
    """Why a message is dropped, or keep: blacklist, toxicity, low_quality, too_short, in this order.

    toxic: a column with the greatest score of the toxicity categories; strictly above the threshold counts.
    Empty and null texts are of low quality.
    """
    every = [*(BLACKLIST if patterns is None else patterns), *custom, *(SLOP if slop else [])]
    text = F.coalesce(tx.strip(c), F.lit(""))
    hit = F.lit(False)
    for p in every:
        hit = hit | text.rlike(f"(?i){p}")
    low = (F.length(text) < 3) | text.rlike(LOW_QUALITY)
    steps = [(hit, "blacklist")] + ([(F.coalesce(toxic, F.lit(0.0)) > threshold, "toxicity")] if toxic is not None else []) + [(low, "low_quality"), (F.length(text) < min_length, "too_short")]
    return first_of(steps, "keep")


def surviving(rows: DataFrame, keep, conv: str = "conv_id", least: int = 2) -> DataFrame:
    """Conversations with at least `least` kept messages, and their counts before and after."""
    counts = rows.groupBy(conv).agg(F.count("*").alias("n_before"), F.count_if(keep).alias("n_after"))
    return counts.withColumn("survives", F.col("n_after") >= least)


def conversation_stats(rows: DataFrame) -> DataFrame:
    """One row: conversations, messages, messages of each role, tokens as a quarter of the characters a message, mean messages."""
    return rows.agg(
        F.countDistinct("conv_id").alias("n_conversations"), F.count("*").alias("n_messages"),
        F.count_if(F.col("role") == "user").alias("n_user"), F.count_if(F.col("role") == "assistant").alias("n_assistant"), F.count_if(F.col("role") == "system").alias("n_system"),
        F.sum(F.expr("length(text) div 4")).alias("n_tokens"), F.round(F.count("*") / F.countDistinct("conv_id"), 6).alias("avg_messages"),
    )


def preview(rows: DataFrame, conv: str = "conv_id", order: tuple = ("turn", "msg_id"), most: int = 10, width: int = 200) -> DataFrame:
    """The first messages of each conversation, texts cut at `width` characters."""
    text = F.when(F.length("text") > width, F.concat(F.substring("text", 1, width), F.lit("..."))).otherwise(F.col("text"))
    i = F.row_number().over(Window.partitionBy(conv).orderBy(*order)) - 1  # limited before the shuffle, a hot conversation costs no more than others
    return rows.withColumn("i", i).where(F.col("i") < most).select(conv, "i", "role", text.alias("text"))


def alpaca(instruction="instruction", response="response"):
    """The three-part template."""
    return F.concat(F.lit("### Instruction:\n"), tx.col(instruction), F.lit("\n\n### Response:\n"), tx.col(response))


def chat_messages(instruction="instruction", response="response"):
    """A list of a user's and an assistant's message."""
    return F.array(F.struct(F.lit("user").alias("role"), tx.col(instruction).alias("content")), F.struct(F.lit("assistant").alias("role"), tx.col(response).alias("content")))


def plain(instruction="instruction", response="response"):
    return F.concat(tx.col(instruction), F.lit("\n\n"), tx.col(response))


def caption_conversation(path="path", caption="caption", question: str = "Describe this image."):
    """A user's message of an image and a question, and the caption as the assistant's."""
    part = lambda kind, image, text: F.struct(F.lit(kind).alias("type"), image.cast("string").alias("image"), text.cast("string").alias("text"))
    return F.array(F.struct(F.lit("user").alias("role"), F.array(part("image", tx.col(path), F.lit(None)), part("text", F.lit(None), F.lit(question))).alias("content")), F.struct(F.lit("assistant").alias("role"), F.array(part("text", F.lit(None), tx.col(caption))).alias("content")))


def extracted_response(c, marker: str = "### Response:\n"):
    """What follows the first marker, up to a second one, without outer blanks; empty where there is none."""
    return tx.strip(F.split_part(tx.col(c), F.lit(marker), F.lit(2)))


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in a stated order."""
    return df.orderBy(*order).limit(n)
