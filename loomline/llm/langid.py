"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter keeps
its maximum, and a softmax layer names the language. The network is trained in numpy on a bounded
sample of labelled rows and then applied to every window of every text, in batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fold, prepare, unit_hash

UNKNOWN = "und"
WIDTHS = (2, 3, 4, 5)
FILTERS = 6
EMBEDDING = 6
WINDOW = 256
#: Neighbouring windows share this many bytes, so that no filter position is missed.
OVERLAP = max(WIDTHS) - 1
#: Bound of the training sample, in documents a language and windows a document.
SAMPLE_PER_LANGUAGE = 600
WINDOWS_PER_SAMPLE = 4
EPOCHS = 6
BATCH_WINDOWS = 256


@dataclass
class Network:
    """Weights: byte embeddings, filters over flattened windows of the greatest width, output layer."""

    languages: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unrolled inputs, the winning position of each filter, and its maximum after the rectifier."""
        wide = max(WIDTHS)
        x = np.lib.stride_tricks.sliding_window_view(self.embedding[windows], wide, axis=1)
        x = x.transpose(0, 1, 3, 2).reshape(len(windows), windows.shape[1] - wide + 1, wide * EMBEDDING)
        seen = (x.reshape(-1, x.shape[2]) @ self.filters).reshape(len(windows), x.shape[1], -1)
        at = seen.argmax(axis=1) if self.training else None
        return x, at, np.maximum(seen.max(axis=1) + self.bias, 0)

    training = False

    def log_odds(self, windows: np.ndarray) -> np.ndarray:
        """Log probabilities of the languages for each window of bytes."""
        scores = self.pooled(windows)[2] @ self.out + self.out_bias
        scores -= scores.max(axis=1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))


def filter_mask() -> np.ndarray:
    """Which inputs each filter sees: one of width w looks at the first w bytes of the unrolled window."""
    seen = [np.arange(max(WIDTHS) * EMBEDDING) < w * EMBEDDING for w in WIDTHS for _ in range(FILTERS)]
    return np.array(seen, np.float32).T


def windows_of(text: bytes) -> np.ndarray:
    """All windows of a text, the last filled with spaces."""
    step = WINDOW - OVERLAP
    count = max(1, -(-(len(text) - OVERLAP) // step))
    room = np.full(count * step + OVERLAP, 32, np.uint8)
    room[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(room, WINDOW)[::step]


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], *, epochs: int = EPOCHS, seed: int = 1) -> Network:
    """Fit by Adam on softmax cross-entropy, in batches of 64 windows."""
    rng = np.random.default_rng(seed)
    mask = filter_mask()
    n_filters = mask.shape[1]
    net = Network(
        languages,
        rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
        (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32),
        np.zeros(n_filters, np.float32),
        rng.normal(0, 0.3, (n_filters, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    net.training = True
    names = ["embedding", "filters", "bias", "out", "out_bias"]
    first = {n: np.zeros_like(getattr(net, n)) for n in names}
    second = {n: np.zeros_like(getattr(net, n)) for n in names}
    share = np.bincount(labels, minlength=len(languages)) / len(labels)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for low in range(0, len(order), 64):
            batch = order[low : low + 64]
            seen, truth = windows[batch], labels[batch]
            x, at, top = net.pooled(seen)
            scores = top @ net.out + net.out_bias
            odds = np.exp(scores - scores.max(axis=1, keepdims=True))
            error = odds / odds.sum(axis=1, keepdims=True)
            error[np.arange(len(batch)), truth] -= 1
            error *= (1 / np.maximum(share[truth] * len(languages), 1e-3))[:, None] / len(batch)
            back = (error @ net.out.T) * (top > 0)
            rows = np.arange(len(batch))[:, None]
            chosen = x[rows, at]
            into = back[:, :, None] * (net.filters * mask).T[None]
            grad_embedding = np.zeros_like(net.embedding)
            taken = seen[rows[:, :, None], at[:, :, None] + np.arange(max(WIDTHS))[None, None]]
            np.add.at(grad_embedding, taken.ravel(), into.reshape(-1, EMBEDDING))
            grads = {
                "embedding": grad_embedding,
                "filters": np.einsum("bf,bfi->if", back, chosen) * mask,
                "bias": back.sum(axis=0),
                "out": top.T @ error,
                "out_bias": error.sum(axis=0),
            }
            step += 1
            for n in names:
                first[n] = 0.9 * first[n] + 0.1 * grads[n]
                second[n] = 0.999 * second[n] + 0.001 * grads[n] ** 2
                change = first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
                setattr(net, n, (getattr(net, n) - 0.01 * change).astype(np.float32))
    net.training = False
    return net


def sample(labelled: DataFrame, text: str, lang: str, per_language: int, seed: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, labels and names from ``per_language`` distinct texts of each language, those of least hash; all if fewer.

    Texts of a hash well below what that many need are cut into windows in the scan, copies of one
    text are dropped before the shuffle, and their rank by hash bounds what reaches the driver.
    """
    keyed = labelled.select(F.col(lang).alias("lang"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    keyed = keyed.withColumn("u", unit_hash(F.lit(seed), F.col("h")))
    counts = {r["lang"]: r["count"] for r in keyed.select("lang", "h").distinct().groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    room = per_language + 6 * per_language**0.5 + 20  # that many are as good as sure to hold the least ones
    rate = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(room / counts[k]))])[F.col("lang")]
    step = WINDOW - OVERLAP
    count = F.greatest(F.lit(1), F.ceil((F.octet_length("text") - OVERLAP) / step))
    # Windows are drawn spread over the whole text; each is cut in the scan, so that long texts stay there.
    places = F.transform(
        F.sequence(F.lit(0), F.least(count, F.lit(WINDOWS_PER_SAMPLE)) - 1),
        lambda i: F.substring(F.col("text").cast("binary"), (F.floor(i * count / F.least(count, F.lit(WINDOWS_PER_SAMPLE))) * step + 1).cast("int"), F.lit(WINDOW)),
    )
    drawn = keyed.where(F.col("u") < rate).select("lang", "u", "h", places.alias("w")).dropDuplicates(["lang", "h"])
    ranked = drawn.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("u", "h")))
    rows = ranked.where(F.col("_rank") <= per_language).select("lang", "h", "w").collect()
    rows = sorted(((r["lang"], r["h"], [bytes(w) for w in r["w"]]) for r in rows), key=lambda r: r[:2])
    windows = np.frombuffer(b"".join(w[:WINDOW].ljust(WINDOW) for _, _, ws in rows for w in ws), np.uint8).reshape(-1, WINDOW)
    labels = np.array([languages.index(k) for k, _, ws in rows for _ in ws], np.int64)
    return windows, labels, languages


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, seed: int = 1) -> Network | None:
    """A network learned from rows of non-null text and language; None if there are none.

    The driver gets at most ``per_language * WINDOWS_PER_SAMPLE`` windows of 256 bytes a language.
    """
    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(text, lang)
    windows, labels, languages = sample(labelled, text, lang, per_language, seed)
    return train(windows, labels, languages) if len(windows) else None


def judge(net: Network, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
    """Language and its probability for each text: the mean log probability of its windows decides."""
    sums = np.zeros((len(texts), len(net.languages)))
    held: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    size = 0

    def flush() -> None:
        found = np.concatenate(held)
        owner = np.concatenate(owners)
        for low in range(0, len(found), BATCH_WINDOWS):
            np.add.at(sums, owner[low : low + BATCH_WINDOWS], net.log_odds(found[low : low + BATCH_WINDOWS]))
        held.clear()
        owners.clear()

    counts = np.zeros(len(texts))
    for at, text in enumerate(texts):
        windows = windows_of(text)
        counts[at] = len(windows)
        held.append(windows)
        owners.append(np.full(len(windows), at))
        size += len(windows)
        if size >= 4096:
            flush()
            size = 0
    if held:
        flush()
    means = sums / np.maximum(counts, 1)[:, None]
    odds = np.exp(means - means.max(axis=1, keepdims=True))
    odds /= odds.sum(axis=1, keepdims=True)
    best = odds.argmax(axis=1)
    return [net.languages[b] for b in best], odds[np.arange(len(texts)), best]


def predict(docs: DataFrame, net: Network | None, *, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """The ``keep`` columns of every row with lang_pred and score, from the whole text alone.

    A null text or one without a letter is 'und' with score 0, as is every text if nothing was
    learned. Empty tables give no rows; repeated rows are judged alike.
    """
    spark = docs.sparkSession
    prepare(spark)
    keep = keep or []
    rows = docs.select(*keep, F.when(F.col(text).rlike(r"\p{L}"), F.col(text).cast("binary")).alias("_text"))
    schema = rows.drop("_text").schema.add("lang_pred", "string").add("score", "double")
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, net = batch.column(batch.num_columns - 1).to_pylist(), shared.value
            known = [i for i, t in enumerate(texts) if t is not None and net is not None]
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if known:
                found, scores[known] = judge(net, [texts[i] for i in known])
                for i, n in zip(known, found):
                    names[i] = n
            columns = [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, *, ident: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """(``ident``, held_out, lang_pred, score) of every row, learned from the rows not held out.

    A row is held out if crc32 of its id as text is ``held`` modulo ``folds``; a null id is never
    held out, and learned from like any other.
    """
    out = F.coalesce(fold(ident, folds) == held, F.lit(False))
    net = fit(docs.where(~out), text=text, lang=lang)
    return predict(docs, net, text=text, keep=[F.col(ident), out.alias("held_out")])
