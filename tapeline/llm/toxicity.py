"""Toxicity of whole texts: subword-bag embeddings averaged over windows into a linear softmax.

Toxic words are few in a long text, so a text is judged by its worst window of ``WIDTH`` words, not by the mean over all of it.
One word did best on held-out documents: in wider windows the harmless words around a toxic one add noise. With windows of one
word only the n-grams inside a word are averaged; the average over a text is given up. Labelled documents are read whole, each
different word of them once. The first fit takes all windows of a toxic document as toxic; each later round keeps the worst one of each and those above even odds. A logistic curve over the worst
window's log-odds, fitted on documents the model has not seen, gives the score.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import batches, held_out, materialize, rows_of, text_column, texts
from tapeline.llm.subwords import LEARNED, Model, draw, for_calibration, sample_windows, train, words_of

WIDTH = 1
DOCS_PER_LABEL = 1200  # bound of the sample of labelled documents, per class
ROUNDS = 3
THRESHOLD = 0.3


@dataclass
class ToxicityModel:
    model: Model | None
    slope: float
    shift: float

    def probability(self, worst: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.where(np.isneginf(worst), 0.0, 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -60, 60))))


class WorstWindow:
    """Highest log-odds of a window of one word, for many texts; odds of words are kept up to ``limit`` words."""

    def __init__(self, model: Model, limit: int = 300_000):
        self.model, self.limit, self.bias = model, limit, float(model.bias[1] - model.bias[0])
        self.known: dict[str, float] = {}

    def of(self, many: Iterable[Sequence[str]]) -> np.ndarray:
        """One number per text; minus infinity without words."""
        if len(self.known) > self.limit:
            self.known = {}
        known, different = self.known, [set(w) for w in many]
        new = list(set().union(*different).difference(known))
        for start in range(0, len(new), LEARNED):
            part = new[start : start + LEARNED]
            scores = self.model.word_scores(part)
            known.update(zip(part, (scores[:, 1] - scores[:, 0]).tolist()))
        get = known.__getitem__
        return np.array([max(map(get, w)) + self.bias if w else -np.inf for w in different])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps, with the targets drawn in a little so that separable classes give finite values."""
    n1, n0 = y.sum(), len(y) - y.sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    center, spread = x.mean(), x.std() + 1e-9
    z, beta = np.stack([(x - center) / spread, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        w = weight * p * (1 - p)
        beta = beta + np.linalg.solve(z.T @ (z * w[:, None]) + 1e-3 * np.eye(2), z.T @ (weight * (goal - p)) - 1e-3 * beta)
    slope = max(float(beta[0]), 1e-3) / spread
    return slope, float(beta[1]) - slope * center


def fit(docs: DataFrame, labels: DataFrame, docs_per_label: int = DOCS_PER_LABEL) -> ToxicityModel:
    """Learn from ``labels`` (doc_id, toxic) of documents that are not held out.

    Of repeated labels the highest counts; null labels and texts are not learned from. Without both classes there is no
    model: every score is then 0, or 1 if all labels are toxic.
    """
    marks = labels.filter(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("string").alias("label"))
    drawn, share = draw(marks, docs_per_label)
    # the drawn rows are bounded by docs_per_label, so the planner broadcasts them and the texts need not move
    known = docs.select("doc_id", "text").join(materialize(drawn.select("doc_id", "label")), "doc_id")
    sample = sample_windows(known, share, WIDTH, None)
    windows, doc = sample.windows, sample.doc
    classes = set(sample.label)
    if classes != {"0", "1"}:
        return ToxicityModel(None, 0.0, 30.0 if classes == {"1"} else -30.0)
    label = sample.label.astype(np.int64)
    apart = np.array([for_calibration(d) for d in doc.tolist()])
    if len(np.unique(label[apart])) < 2 or len(np.unique(label[~apart])) < 2:
        apart[:] = True  # too few documents to hold some back
        fitted = np.flatnonzero(apart)
    else:
        fitted = np.flatnonzero(~apart)
    kept = np.ones(len(fitted), bool)
    for _ in range(ROUNDS):
        mine = fitted[kept]
        model = train([windows[i] for i in mine], label[mine], ["0", "1"], pad=WIDTH, docs=doc[mine])
        worst = WorstWindow(model).of([windows[i] for i in fitted])
        top: dict[int, float] = {}
        for d, w in zip(doc[fitted].tolist(), worst.tolist()):
            top[d] = max(top.get(d, -np.inf), w)
        kept = np.array([label[i] == 0 or w >= min(top[doc[i]] - 1e-9, 0.0) for i, w in zip(fitted, worst)])
    judged: dict[int, list] = {}
    for i, w in zip(np.flatnonzero(apart), WorstWindow(model).of([windows[i] for i in np.flatnonzero(apart)])):
        at = judged.setdefault(int(doc[i]), [label[i], w])
        at[1] = max(at[1], w)
    y, x = np.array([v[0] for v in judged.values()]), np.array([v[1] for v in judged.values()])
    finite = np.isfinite(x)
    y, x = y[finite], x[finite]
    weight = np.where(y == 1, 1 / sample.share["1"], 1 / sample.share["0"])
    return ToxicityModel(model, *logistic(x, y, weight / weight.mean()))


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])


def score(docs: DataFrame, fitted: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every row; only the text enters the score.

    Null and empty texts and texts without letters score 0. Repeated rows score alike. Other columns are ignored.
    """

    def run(source):
        worst_window = WorstWindow(fitted.model) if fitted.model else None
        for batch in batches(source, 256):
            words = [words_of(t) for t in texts(batch)]
            if worst_window:
                worst = worst_window.of(words)
            else:
                worst = np.array([0.0 if w else -np.inf for w in words])
            yield rows_of(SCORES, [batch.column("doc_id"), batch.column("held_out"), fitted.probability(worst)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"), held_out().alias("held_out"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
