"""Result types of the structured extractions that a model may be asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fields that each extraction returns.
CONTRACTS = {
    "classify": "primary_act string, secondary_acts array<string>, evidence_spans array<string>, abstain boolean, uncertainty_reason string",
    "segment": "segments array<string>, act_labels array<string>, evidence_spans array<string>, uncertain_segments array<string>",
    "task": "executable boolean, contract_status string, actor string, action string, target string, preconditions array<string>, constraints array<string>, success_condition string, deadline string, required_evidence array<string>, source_spans array<string>",
    "check": "check_method string, reported_result string, evidence_span string, coverage_limit string",
    "review": "action string, status string, version_or_reference string, evidence_span string, limitations array<string>",
    "coordinate": "assignments array<string>, dependencies array<string>, completion_conditions array<string>, evidence_requirements array<string>",
}


def parsed(result: Column, contract: str) -> Column:
    """A model's JSON answer under a contract; null where it is no object."""
    return F.when(F.try_variant_get(F.try_parse_json(result), "$", "map<string,variant>").isNotNull(), F.from_json(result, CONTRACTS[contract]))


def unsupported(answer: Column, message: Column) -> Column:
    """The evidence spans of a classification that do not stand in the message."""
    return F.filter(answer["evidence_spans"], lambda s: ~F.coalesce(F.contains(message, s), F.lit(False)))
