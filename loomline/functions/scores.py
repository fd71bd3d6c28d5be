"""Score maps: rank, margin, review rule, validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The acts, in the order that decides ties, and the thresholds of the review rule.
ACTS = [
    "instruction_request",
    "question",
    "proposal_plan",
    "commitment_assignment",
    "offer_help",
    "status_report",
    "check_report",
    "assertion",
    "endorsement",
    "qualification",
    "challenge_correction",
    "acknowledgment",
]
LEAST_TOP = 0.55
LEAST_MARGIN = 0.15
LISTED = 0.5


def ranked(scores: Column, acts: list[str] = ACTS) -> Column:
    """Array of (score, turn, act), best first; ties in the order of ``acts``."""
    rows = F.array(*[F.struct((-scores[a]).alias("_n"), F.lit(i).alias("turn"), F.lit(a).alias("act"), scores[a].alias("score")) for i, a in enumerate(acts)])
    return F.array_sort(F.filter(rows, lambda r: r["score"].isNotNull()))


def review(scores: Column, text: Column, truncated: Column, acts: list[str] = ACTS) -> Column:
    """Label, top score, margin, reasons, needs_review, primary_act and the acts of score 0.5 or more."""
    order = ranked(scores, acts)
    top, margin = order[0]["score"], order[0]["score"] - order[1]["score"]
    reasons = F.array_compact(
        F.array(
            F.when(top < LEAST_TOP, "low_top_score"),
            F.when(margin < LEAST_MARGIN, "small_margin"),
            F.when(truncated, "truncated"),
            F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "blank"),
        )
    )
    return F.struct(
        order[0]["act"].alias("label"),
        top.alias("top_score"),
        margin.alias("margin"),
        reasons.alias("reasons"),
        (F.size(reasons) > 0).alias("needs_review"),
        F.when(F.size(reasons) > 0, "uncertain").otherwise(order[0]["act"]).alias("primary_act"),
        F.transform(F.filter(order, lambda r: r["score"] >= LISTED), lambda r: r["act"]).alias("templates"),
    )


def valid(scores: Column, acts: list[str] = ACTS) -> Column:
    """Exactly the acts, each a finite number from 0 to 1."""
    keys = F.array_sort(F.map_keys(scores)) == F.array(*[F.lit(a) for a in sorted(acts)])
    return keys & F.forall(F.map_values(scores), lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v <= 1))


def forced_choice(scores: Column, acts: list[str] = ACTS, within: float = 0.001) -> Column:
    """Valid scores of one choice: they sum to one."""
    total = F.aggregate(F.map_values(scores), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    return valid(scores, acts) & (F.abs(total - 1) <= within)


def truncation(raw: Column) -> Column:
    """Either writing of a truncation report (JSON text) in one form: message, tokens dropped at most, and by hypothesis.

    The details stand under ``perHypothesis`` or ``per_hypothesis``, the flag under ``truncated`` or
    ``message``. Missing flags are false, missing counts 0, a missing maximum is that of the details.
    Text that is no object gives null.
    """
    detail = "struct<message:boolean,hypothesis:boolean,message_tokens_dropped:int,hypothesis_tokens_dropped:int>"
    form = f"perHypothesis map<string,{detail}>, per_hypothesis map<string,{detail}>, truncated boolean, message boolean, message_tokens_dropped_max int"
    whole = F.from_json(raw, form)
    per = F.coalesce(whole["perHypothesis"], whole["per_hypothesis"], F.from_json(F.lit("{}"), f"map<string,{detail}>"))
    flag = lambda x: F.coalesce(x, F.lit(False))
    many = lambda x: F.coalesce(x, F.lit(0))
    per = F.transform_values(
        per,
        lambda _, d: F.struct(
            flag(d["message"]).alias("message"), flag(d["hypothesis"]).alias("hypothesis"),
            many(d["message_tokens_dropped"]).alias("message_tokens_dropped"), many(d["hypothesis_tokens_dropped"]).alias("hypothesis_tokens_dropped"),
        ),
    )
    most = F.coalesce(whole["message_tokens_dropped_max"], F.array_max(F.transform(F.map_values(per), lambda d: d["message_tokens_dropped"])), F.lit(0))
    found = F.struct(
        flag(F.coalesce(whole["truncated"], whole["message"])).alias("message"), most.alias("message_tokens_dropped_max"), per.alias("per_hypothesis")
    )
    return F.when(raw.rlike(r"^\s*\{") & F.try_parse_json(raw).isNotNull(), found)


def softmax(logits: Column) -> Column:
    """Shares of an array of logits."""
    top = F.array_max(logits)
    raised = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))
