"""Quality classifier: ordinal regression with a shared weight vector over hashed text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
import xxhash

_RATIOS = ("bare", "caps", "marks", "digits", "repeats", "top")
_NOISE = "!?#$%&*|=~^+<>@_-"
_SIGNS = _NOISE + ".,;:'\"()[]{}/\\`"
#: Different grades that labels may have; more are no rating scale.
MOST_GRADES = 32


@dataclass(frozen=True)
class Settings:
    """Sizes of the model and of its fit. ``sample`` bounds the labelled rows that are fitted on, whatever the corpus holds;
    features in fewer than ``min_rows`` of them get no weight, or the fit would learn rows by heart."""

    buckets: int = 1 << 18
    sample: int = 12000
    epochs: int = 8
    min_rows: int = 8
    rate: float = 0.05
    decay: float = 1e-6
    keep_above: float = 0.6


class _Words(dict):
    """word -> bucket with a bit for each odd shape the word has."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: str) -> int:
        core = word if word.isalpha() else word.strip(_SIGNS)
        name = core.lower() if core else word
        shape = (not core) | (len(core) > 1 and core.isupper()) << 1
        if core is not word and core != word:
            shape |= (bool(core) and len(word) - len(word.rstrip(_NOISE)) > 1) << 2
        if not core.isalpha():
            shape |= any(map(str.isdigit, core)) << 3
        found = self[word] = xxhash.xxh64_intdigest(name.encode()) % self.buckets | shape << 40
        return found


class Features:
    """A text as hashed features: its distinct words, and the shares of odd shapes among its words."""

    def __init__(self, buckets: int):
        self.words = _Words(buckets)
        named = [f"\0{name}:{step}" for name in _RATIOS for step in range(20)] + [f"\0size:{i}" for i in range(64)]
        self.own = np.array([xxhash.xxh64_intdigest(n.encode()) % buckets for n in named])

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        counted = Counter((text or "").split())
        if len(self.words) > 1 << 18:
            self.words.clear()
        n = len(counted)
        packed = np.fromiter(map(self.words.__getitem__, counted), np.int64, n)
        counts = np.fromiter(counted.values(), np.int64, n)
        total = int(counts.sum())
        buckets = np.unique(packed & (1 << 40) - 1)
        ratios = [float(counts[packed >> 40 + bit & 1 == 1].sum()) / total if total else 0.0 for bit in range(4)]
        # Distinct words fall short of the total in any long text, so their number is seen on the scale of its logarithm. Twenty words
        # are added to the total: the fewer words a text has, the less it tells that one of them stands out or comes again.
        ratios += [(1 - np.log1p(n) / np.log1p(total)) * total / (total + 20), counts.max() / (total + 20)] if total else [0.0, 0.0]
        # All levels up to a ratio: a weight for each step can follow any rise.
        steps = [20 * i + step for i, r in enumerate(ratios) if r > 0 for step in range(min(int(r * 20), 19) + 1)]
        steps.append(20 * len(_RATIOS) + total.bit_length())
        # A single telling word must be heard in a long text: its share falls with the fourth root only.
        value = np.concatenate([np.full(len(buckets), max(len(buckets), 1) ** -0.25), np.full(len(steps) - 1, 0.5), [0.3]])
        return np.concatenate([buckets, self.own[steps]]), value


@dataclass
class Model:
    """Cumulative-link model: P(grade <= k) = logistic(cuts[k] - weights . features)."""

    weights: np.ndarray
    cuts: np.ndarray
    settings: Settings

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k but the last."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - scores[:, None], -50, 50)))


def _telling(rows: list[tuple[np.ndarray, np.ndarray]], top: np.ndarray, settings: Settings) -> np.ndarray:
    """How much each feature tells: the size of its log-odds between the top grade and the rest, shrunk where chance would do.
    Scaling by it lets a rare telling word weigh more than many common ones that fit the sample by accident."""
    with_top, without = np.zeros(settings.buckets), np.zeros(settings.buckets)
    for (index, _), is_top in zip(rows, top):
        (with_top if is_top else without)[np.unique(index)] += 1
    n_top, n_rest = top.sum() + 2.0, (~top).sum() + 2.0
    odds = np.log((with_top + 1) / n_top) - np.log((without + 1) / n_rest)
    z2 = odds**2 / (1 / (with_top + 1) + 1 / (without + 1))
    return np.where(with_top + without >= settings.min_rows, np.abs(odds) * z2 / (z2 + 9), 0.0)


def fit(texts: Iterable[str | None], grades: list[int], grades_count: int, settings: Settings = Settings()) -> Model:
    """Fit weights and ordered cuts by stochastic steps on the likelihood (Adagrad). Cuts are a first cut plus positive gaps, so they stay ordered.
    Texts are read once, and only their features are held; ``grades`` (0 and up) fills up while they are read."""
    features = Features(settings.buckets)
    rows = [(index.astype(np.int32), value.astype(np.float32)) for index, value in map(features, texts)]
    scale = _telling(rows, np.array(grades) == grades_count - 1, settings)
    rows = [(index[used], (value * scale[index])[used]) for index, value in rows for used in [scale[index] != 0]]
    weights, history = np.zeros(settings.buckets), np.full(settings.buckets, 1e-2)
    shares = np.cumsum(np.bincount(grades, minlength=grades_count) + 1.0) / (len(grades) + grades_count)
    start = np.log(shares[:-1] / (1 - shares[:-1]))
    raw = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    raw_history = np.full(len(raw), 1e-2)
    order = np.random.Generator(np.random.PCG64(3))
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    for _ in range(settings.epochs):
        for i in order.permutation(len(rows)):
            index, value = rows[i]
            cuts = np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])
            score, y = float(weights[index] @ value), grades[i]
            high = logistic(cuts[y] - score) if y < grades_count - 1 else 1.0
            low = logistic(cuts[y - 1] - score) if y else 0.0
            p = max(high - low, 1e-9)
            d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
            # d loss / d score = d_high - d_low with loss = -log p; d loss / d cut: -d_high and +d_low
            step = np.clip((d_high - d_low), -5, 5) * value + settings.decay * weights[index]
            np.add.at(history, index, step * step)
            np.subtract.at(weights, index, settings.rate * 4 * step / np.sqrt(history[index]))
            d_cuts = np.zeros(len(cuts))
            if y < grades_count - 1:
                d_cuts[y] -= d_high
            if y:
                d_cuts[y - 1] += d_low
            d_raw = np.concatenate([[d_cuts.sum()], np.cumsum(d_cuts[1:][::-1])[::-1] * np.exp(raw[1:])])
            raw_history += d_raw * d_raw
            raw -= settings.rate * d_raw / np.sqrt(raw_history)
    cuts = np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])
    return Model(weights * scale, cuts, settings)


def scale_of(labels: DataFrame) -> list[int]:
    """The ordered grades that the labels give: quality, and a point for not being toxic. At most ``MOST_GRADES`` values reach the driver; more of them, or
    a toxic mark other than 0 and 1, stop the job."""
    full = labels.where("doc_id is not null and quality is not null and toxic is not null")
    if not full.where("toxic not in (0, 1)").isEmpty():
        raise ValueError("toxic must be 0 or 1")
    found = full.select((F.col("quality") + 1 - F.col("toxic")).cast("bigint").alias("grade")).distinct().limit(MOST_GRADES + 1).collect()
    if len(found) > MOST_GRADES:
        raise ValueError(f"labels have more than {MOST_GRADES} grades")
    return sorted(r.grade for r in found)


def graded(docs: DataFrame, labels: DataFrame, scale: list[int], id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(id, text, grade) of at most ``settings.sample`` labelled rows, the same in every run, the grade as a place on the scale. The
    sample is chosen among labels by hash before any text moves; rows without a full label are left out."""
    place = F.array_position(F.array(*map(F.lit, scale)), (F.col("quality") + 1 - F.col("toxic")).cast("int")) - 1
    rated = labels.select(F.col("doc_id").alias("id"), place.cast("int").alias("grade")).where("id is not null and grade is not null")
    chosen = rated.orderBy(F.md5(F.col("id").cast("string")), "grade").limit(settings.sample)
    texts = docs.select(F.col(id_col).alias("own"), F.col(text_col).alias("text"))
    return texts.join(chosen, texts["own"] == chosen["id"]).select(F.col("own").alias("id"), "text", "grade").orderBy("id", "grade", F.xxhash64("text")).limit(
        settings.sample)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> Model | None:
    """Fit on the bounded sample; None if no row is labelled. One task reads the sample and fits; only weights and cuts reach the driver."""
    scale = scale_of(labels)
    if not scale:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grades: list[int] = []

        def texts() -> Iterator[str | None]:
            for batch in batches:
                for text, grade in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    grades.append(grade)
                    yield text

        model = fit(texts(), grades, max(len(scale), 2), settings)
        if grades:
            yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype("<f8").tobytes()], pa.binary()), pa.array([model.cuts.tolist()], pa.list_(pa.float64()))], ["weights", "cuts"])

    rows = graded(docs, labels, scale, id_col, text_col, settings).select("text", "grade").coalesce(1)
    found = rows.mapInArrow(run, "weights binary, cuts array<double>").collect()
    return Model(np.frombuffer(found[0].weights, "<f8"), np.array(found[0].cuts), settings) if found else None


def judge(text: Column, model: Model) -> Column:
    """Struct (expected_grade, p_good, kept) of a text; tasks get the weights once, a megabyte or two."""
    shared = model

    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        features = Features(shared.settings.buckets)
        for batch in batches:
            scores = np.array([float(shared.weights[i] @ v) for i, v in map(features, batch)]).reshape(-1)
            tails = shared.tails(scores)
            yield pd.DataFrame({"expected_grade": tails.sum(axis=1), "p_good": tails[:, -1],
                                "kept": tails[:, -1] > shared.settings.keep_above})

    # The annotations are strings here, so the function type is set by hand.
    rate.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(rate, "expected_grade double, p_good double, kept boolean")(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Return (doc_id, expected_grade, p_good, kept) for every row: the expected place on the scale of grades, the probability of the top grade, and
    whether it is above ``settings.keep_above``.

    Training reads a bounded, documented sample of labelled rows; scoring runs over every whole text where it lies, without a shuffle; a task
    holds one batch of texts and the distinct words of one text, so a very long text takes a few times its size.
    A null text counts as empty and is judged as such; equal texts have equal scores, and a probability of exactly ``keep_above`` isn't kept. Without
    any labelled row everything is kept, with null probabilities. Repeated rows each get their score; an id with several labels is fitted with each of
    them. Labels with a null id, quality or toxic mark are left out of the fit.
    """
    model = train(docs, labels, id_col, text_col, settings)
    if model is None:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(None).cast("double").alias("expected_grade"),
                           F.lit(None).cast("double").alias("p_good"), F.lit(True).alias("kept"))
    return docs.select(F.col(id_col).alias("doc_id"), judge(F.col(text_col), model).alias("found")).select("doc_id", "found.*")


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Rows of ``docs`` that the classifier keeps, with all their columns."""
    model = train(docs, labels, id_col, text_col, settings)
    if model is None:
        return docs
    return docs.withColumn("__found", judge(F.col(text_col), model)).where("__found.kept").drop("__found")
