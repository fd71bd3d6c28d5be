"""Texts made ready for a model of bounded input; a token is what stands between white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split(text: Column) -> Column:
    """Tokens of a text; none for a blank or null one."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+"))


def _joined(found: Column, start: Column | int, count: Column | int) -> Column:
    return F.array_join(F.slice(found, start, count), " ")


def pair(message: Column, hypothesis: Column, most: int, special: int = 3) -> Column:
    """Message and hypothesis for a model of ``most`` tokens, ``special`` of them its own.

    Only the message is cut, at its end. Returns text, hypothesis, message_tokens and
    message_tokens_dropped.
    """
    found = split(message)
    room = F.greatest(F.lit(0), F.lit(most - special) - F.size(split(hypothesis)))
    kept = F.least(room, F.size(found))
    return F.struct(
        _joined(found, 1, kept).alias("text"), hypothesis.alias("hypothesis"),
        F.size(found).alias("message_tokens"), (F.size(found) - kept).alias("message_tokens_dropped"),
    )


def middle_omitted(message: Column, most: int) -> Column:
    """A message of at most ``most`` tokens: a longer one keeps its beginning and end, and says what it lacks.

    Returns text, message (whether it was cut), message_tokens and message_tokens_dropped.
    """
    found = split(message)
    total, left = F.size(found), most // 2
    dropped = F.greatest(F.lit(0), total - most)
    mark = F.concat(F.lit("\n[... "), dropped.cast("string"), F.lit(" middle message tokens omitted ...]\n"))
    cut = F.concat(_joined(found, 1, left), mark, _joined(found, F.greatest(F.lit(1), total - (most - left) + 1), most - left))
    return F.struct(
        F.when(dropped > 0, cut).otherwise(message).alias("text"), (dropped > 0).alias("message"),
        total.alias("message_tokens"), dropped.alias("message_tokens_dropped"),
    )


def question_first(question: Column, option: Column, most: int, special: int = 3) -> Column:
    """``question: ... option: ...`` with a token of room for the message; only the question is shortened.

    Returns text and shortened; an option that does not fit alone is an error when it runs.
    """
    found, choice = split(question), split(option)
    room = F.lit(most - special - 1 - 2) - F.size(choice)
    kept = F.least(F.greatest(room, F.lit(0)), F.size(found))
    text = F.concat_ws(" ", F.lit("question:"), F.when(kept > 0, _joined(found, 1, kept)), F.lit("option:"), option)
    error = F.raise_error(F.lit("an option is too long for the model"))
    return F.struct(F.when(room >= 0, text).otherwise(error).alias("text"), (kept < F.size(found)).alias("shortened"))


def rotated(options: list[str], by: int) -> list[str]:
    """The options in turn, beginning with number ``by``."""
    by = by % len(options) if options else 0
    return [*options[by:], *options[:by]]
