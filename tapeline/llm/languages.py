"""Language of whole texts: averaged hashed subword embeddings, a linear softmax and a calibrated rejection.

The model learns from windows of words; a text's class scores are the mean over all its words. The softmax temperature and
the confidence below which a text is rejected come from documents that the model has not been fitted on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import batches, held_out, rows_of, text_column, texts
from tapeline.llm.subwords import Model, Scorer, draw, for_calibration, sample_windows, train, words_of

WIDTH = 16
DOCS_PER_LANGUAGE = 2500  # bound of the sample of labelled documents, per language
WINDOWS_PER_DOC = 16
UNKNOWN = "und"
LOST = 0.002  # share of rightly recognised texts that the rejection may cost
MOST_REJECT = 0.5


@dataclass
class LanguageModel:
    model: Model | None
    temperature: float
    reject_below: float

    def judge(self, scores: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
        """Language and probability of texts, from the class scores of their words."""
        names, p = [], np.zeros(len(scores))
        for i, s in enumerate(scores):
            if not len(s) or self.model is None:
                names.append(UNKNOWN)
                continue
            z = (s.mean(axis=0, dtype=np.float64) + self.model.bias) / self.temperature
            e = np.exp(z - z.max())
            best = int(e.argmax())
            names.append(self.model.labels[best])
            p[i] = e[best] / e.sum()
        return names, p


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> LanguageModel:
    """Learn from text and lang of the documents that are not held out; without labelled text nothing is recognised."""
    known = docs.filter(~held_out()).select("doc_id", "text", F.col("lang").cast("string").alias("label"))
    sample = sample_windows(*draw(known, docs_per_language), WIDTH, WINDOWS_PER_DOC)
    windows = sample.windows
    if not windows:
        return LanguageModel(None, 1.0, MOST_REJECT)
    labels = sorted(set(sample.label))
    target = np.searchsorted(np.array(labels), sample.label.astype(str))
    apart = np.array([for_calibration(d) for d in sample.doc.tolist()])
    if len(np.unique(target[~apart])) < len(labels) or not apart.any():
        apart[:] = True  # too few documents to hold some back
        fitted = np.flatnonzero(apart)
    else:
        fitted = np.flatnonzero(~apart)
    model = train([windows[i] for i in fitted], target[fitted], labels, docs=sample.doc[fitted], least_docs=2, least_steps=120)
    # single windows calibrate: they are shorter than most texts, so the confidence errs on the low side
    check = np.flatnonzero(apart)
    sums = np.array([s.mean(axis=0) + model.bias for s in Scorer(model).scores([windows[i] for i in check])], np.float64)

    def loss(t: float) -> float:
        z = sums / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(check)), target[check]]).mean())

    temperature = float(min(np.geomspace(0.05, 20, 61), key=loss))
    z = sums / temperature
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    right = p.argmax(axis=1) == target[check]
    floor = float(np.quantile(p.max(axis=1)[right], LOST)) if right.any() else MOST_REJECT
    return LanguageModel(model, temperature, min(floor, MOST_REJECT))


JUDGED = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def predict(docs: DataFrame, fitted: LanguageModel) -> DataFrame:
    """All columns of ``docs`` with lang_pred, score and rejected; only the text enters the prediction.

    A null text or one without a letter is ``und`` with score 0 and rejected. Columns of these names are replaced.
    """
    kept = docs.drop("lang_pred", "score", "rejected").withColumn("_text", text_column())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_text")

    def run(source):
        scorer = Scorer(fitted.model) if fitted.model else None
        for batch in batches(source, 256):
            words = [words_of(t) for t in texts(batch, "_text")]
            names, p = fitted.judge(scorer.scores(words) if scorer else [np.zeros((0, 1))] * len(words))
            rejected = [n == UNKNOWN or v < fitted.reject_below for n, v in zip(names, p)]
            told = rows_of(JUDGED, [names, p, rejected])
            own = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in own], *told.columns], names=[*own, *JUDGED.names])

    return kept.mapInArrow(run, f"{fields}, lang_pred string, score double, rejected boolean")
