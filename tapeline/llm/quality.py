"""Quality of documents: counts, base rules, and a hashed n-gram log-likelihood ratio. DataFrame functions only.

Words and word pairs are hashed into ``BUCKETS`` buckets. Two multinomials over the buckets are estimated with add-one
smoothing, one from trusted documents and one from the whole corpus. A document's score is the mean of log(trusted / corpus)
over its n-grams, so long and short documents compare, and one threshold decides for every document.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import materialize, text_column

BUCKETS = 1 << 16
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
STEPS = 256  # thresholds are multiples of 1 / STEPS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once per row however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def buckets_of(words: Column) -> Column:
    """Buckets of all words, then of all pairs of neighbours."""
    single = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    pair = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.pmod(F.xxhash64(w, F.get(words, i + 1)), F.lit(BUCKETS)).cast("int")
    )
    return F.concat(single, pair)


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur more than once in the text.

    Windows are compared by a 64-bit hash. Only texts with a repeated window are sorted; the covered words are then counted
    from the gaps between the starts of repeated windows.
    """

    def marked(ordered: Column) -> Column:
        near = lambda x, i, d: (i + d >= 0) & (F.get(ordered, i + d)["h"] == x["h"])
        at = F.transform(ordered, lambda x, i: F.when(F.coalesce(near(x, i, -1), F.lit(False)) | F.coalesce(near(x, i, 1), F.lit(False)), x["i"]))
        return F.sort_array(F.filter(at, lambda p: p.isNotNull()))

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)

    def counted(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(let(ordered, marked), covered))

    heads = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    return let(F.transform(heads, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), counted)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def ratios(docs: DataFrame, trusted: DataFrame) -> list[float] | None:
    """log(trusted / corpus) of every bucket; ``None`` without trusted n-grams.

    ``trusted`` holds doc_ids. Both counts cover all rows; they are added up before the shuffle, so a frequent word costs one row
    per task, and what comes back are ``BUCKETS`` rows for any corpus. Ids and texts are dealt by id, whatever their number;
    texts without id are dealt by their hash.
    """
    marks = trusted.select(F.col("doc_id").cast("long").alias("id")).filter(F.col("id").isNotNull()).distinct()
    marks = marks.select("id", F.lit(0).alias("salt"), F.lit(1).alias("_trusted"))
    salt = F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("text"), F.lit(4096)).cast("int")).otherwise(0)
    dealt = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), salt.alias("salt"), text_column().alias("text"))
    grams = dealt.join(marks.hint("shuffle_hash"), ["id", "salt"], "left")
    grams = grams.select("_trusted", F.explode(let(words_of(F.col("text")), buckets_of)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("corpus"), F.count("_trusted").alias("trusted")).collect()
    corpus, target = [1] * BUCKETS, [1] * BUCKETS
    for r in counts:
        corpus[r["bucket"]] += r["corpus"]
        target[r["bucket"]] += r["trusted"]
    if sum(target) == BUCKETS:
        return None
    shift = math.log(sum(corpus)) - math.log(sum(target))
    return [math.log(t) - math.log(c) + shift for t, c in zip(target, corpus)]


def measure(docs: DataFrame, table: list[float] | None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and score of every row.

    Null texts have no words. The score of a text without words is 0, as is every score without ``table``.
    """
    text = F.col("text")
    if table is None:
        score = lambda words: F.lit(0.0)
    else:
        # the table is a constant of the plan: BUCKETS numbers whatever the corpus
        ratio = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
        total = lambda found: F.aggregate(found, F.lit(0.0), lambda s, b: s + F.get(ratio, b)) / F.size(found)
        score = lambda words: F.when(F.size(words) > 0, let(buckets_of(words), total)).otherwise(F.lit(0.0))
    per_words = let(
        words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"), score(w).alias("score"))
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    rows = rows.select(
        "doc_id",
        per_words.alias("w"),
        (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        duplicate_lines(text).alias("n_dup_lines"),
    )
    failed = (F.col("w.n_words") < LEAST_WORDS) | (100 * F.col("w.n_repeat_words") > MOST_REPEATED * F.col("w.n_words"))
    return rows.select(
        "doc_id", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", failed.alias("base_failed"), F.col("w.score").alias("score")
    )


def threshold(measured: DataFrame, labels: DataFrame) -> float:
    """The lowest score that keeps: where the shares of trusted and of poor labelled documents kept differ most.

    Ties go to the lower threshold, so to keeping; without poor documents everything is kept. Scores are means of bounded
    log-ratios, so the histogram has some thousand steps at most.
    """
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    step = F.floor(F.col("score") * STEPS).cast("int")
    rows = measured.filter(~F.col("base_failed")).join(marks, "doc_id").groupBy(step.alias("step")).agg(
        F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("poor")
    ).orderBy("step").collect()
    good, poor = sum(r["good"] for r in rows), sum(r["poor"] for r in rows)
    best, at, lost, gone = 0.0, -math.inf, 0, 0
    for r in rows:
        lost, gone = lost + r["good"], gone + r["poor"]
        gain = (gone / poor if poor else 0.0) - (lost / good if good else 0.0)
        if gain > best + 1e-12:
            best, at = gain, (r["step"] + 1) / STEPS
    return at


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The counts, base_failed, score and kept of every row of ``docs`` (doc_id, text); ``labels`` (doc_id, quality).

    Documents labelled quality 1 are trusted; of repeated labels the highest counts. ``kept`` is false where a base rule
    fails and otherwise says whether the score reaches the threshold. Repeated rows are judged alike; other columns are ignored.
    """
    table = ratios(docs, labels.filter(F.col("quality") == 1))
    measured = materialize(measure(docs, table))
    return measured.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold(measured, labels))))
