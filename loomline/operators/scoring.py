"""Batch scoring: unique texts, an injectable model, run manifests."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prepare import rotated
from ..functions.scores import ACTS, review

#: texts, acts -> a row of scores for each text, and whether the text was cut.
Model = Callable[[list[str], list[str]], tuple[np.ndarray, list[bool]]]
MAX_WORDS = 512


def lexical_model(texts: list[str], acts: list[str]) -> tuple[np.ndarray, list[bool]]:
    """The default model: repeatable scores from hashes of a text's words, for want of weights."""
    seeds = [int.from_bytes(hashlib.sha256(a.encode()).digest()[:8], "big") for a in acts]
    scores, cut = np.zeros((len(texts), len(acts))), []
    for i, text in enumerate(texts):
        words = text.split()
        cut.append(len(words) > MAX_WORDS)
        codes = [int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big") for w in sorted(set(words[:MAX_WORDS]))]
        for j, seed in enumerate(seeds):
            scores[i, j] = np.mean([((c ^ seed) % 1009) / 1009 for c in codes]) if codes else 0.0
    return scores, cut


def choice(scores: np.ndarray) -> np.ndarray:
    """Scores of one choice among the acts: a softmax over each row."""
    raised = np.exp(4 * (scores - scores.max(axis=1, keepdims=True)))
    return raised / raised.sum(axis=1, keepdims=True)


def cross_encoder_model(texts: list[str], acts: list[str]) -> tuple[np.ndarray, list[bool]]:
    """The default model as a forced choice: scores sum to one."""
    scores, cut = lexical_model(texts, acts)
    return choice(scores), cut


def causal_choice_model(texts: list[str], acts: list[str], rotations: int = 3) -> tuple[np.ndarray, list[bool]]:
    """The default model asked by letters, the mean over rotated orders of the choices, which takes out what a place is worth."""
    total, cut = np.zeros((len(texts), len(acts))), [False] * len(texts)
    for by in range(rotations):
        order = rotated(acts, by * max(1, len(acts) // rotations))
        scores, cut = lexical_model(texts, order)
        told = choice(scores + np.linspace(0.05, 0, len(order)))  # an earlier letter is a little likelier
        total += told[:, [order.index(a) for a in acts]]
    return total / rotations, cut


#: The engines by name, and whether the scores of a text are one choice.
ENGINES: dict[str, tuple[Model, bool]] = {"entailment": (lexical_model, False), "cross-encoder": (cross_encoder_model, True), "causal": (causal_choice_model, True)}


def score_within(texts: DataFrame, seconds: float, model: Model = lexical_model, acts: list[str] = ACTS, batch: int = 64) -> DataFrame:
    """``score_texts`` under a deadline: a task stops after ``seconds`` and gives null scores for the texts that it has left.

    What is scored is a partial result to keep; the texts of null scores are pending again.
    """
    acts = list(acts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = time.monotonic() + seconds
        for whole in batches:
            for low in range(0, len(whole), batch):
                part = whole.iloc[low : low + batch]
                if time.monotonic() < end:
                    scores, cut = model(part["text"].tolist(), acts)
                    rows = [dict(zip(acts, map(float, s))) for s in scores]
                else:
                    rows, cut = [None] * len(part), [None] * len(part)
                yield pd.DataFrame({"text_hash": part["text_hash"].to_numpy(), "scores": rows, "truncated": pd.array(cut, "boolean")})

    unique = texts.select("text_hash", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["text_hash"])
    return unique.mapInPandas(run, "text_hash string, scores map<string,double>, truncated boolean")


def score_texts(texts: DataFrame, model: Model = lexical_model, acts: list[str] = ACTS) -> DataFrame:
    """(text_hash, scores, truncated) of (text_hash, text), in batches of similar length, once a hash."""
    acts = list(acts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores, cut = model(batch["text"].tolist(), acts)
            rows = [dict(zip(acts, map(float, s))) for s in scores]
            yield pd.DataFrame({"text_hash": batch["text_hash"], "scores": rows, "truncated": cut})

    unique = texts.select("text_hash", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["text_hash"])
    ordered = unique.sortWithinPartitions(F.length("text"), "text_hash")
    return ordered.mapInPandas(run, "text_hash string, scores map<string,double>, truncated boolean")


def predictions(messages: DataFrame, run_id: str, model: Model = lexical_model, acts: list[str] = ACTS) -> DataFrame:
    """Scored and reviewed unique texts of a run."""
    texts = messages.select("text_hash", "text").dropDuplicates(["text_hash"])
    joined = score_texts(texts, model, acts).join(texts, "text_hash")
    rows = joined.withColumn("r", review(F.col("scores"), F.col("text"), F.col("truncated"), acts))
    return rows.select(F.lit(run_id).alias("run_id"), "text_hash", "scores", "truncated", "r.*")


def run_id(config: dict) -> str:
    """Twenty characters of the sha256 of the canonical configuration."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:20]


# Parts of a configuration that change speed and not meaning.
PERFORMANCE_KEYS = ("batch", "device", "engine", "outer_batch", "pair_batch", "threads")


def same_meaning(old: dict, new: dict) -> bool:
    """Whether a run may go on under a new configuration: all but the performance keys are equal."""
    return all(old.get(k) == new.get(k) for k in {*old, *new} if k not in PERFORMANCE_KEYS)


def next_epoch(epochs: list[dict], config: dict) -> list[dict]:
    """The epochs of a run with one more for a resume; raises where the meaning differs."""
    if epochs and not same_meaning(epochs[0]["config"], config):
        raise ValueError("the configuration is of another run")
    return [*epochs, {"epoch": len(epochs), "config": config}]
