"""State machines over chunked series.

Some recurrences have no associative form. They run as one ordered pass per chunk. A chunk first guesses its entry
state by running over its lookback rows; the guess is then compared with the exit state of the chunk before it, and
only chunks whose guess was wrong run again, until every chunk starts from the state its predecessor ended in. The
result equals one pass over the whole series, while no task ever sees more than one chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tapeline.operators.layout import CHUNK, CORE, POS, Laid, spread
from tapeline.operators.steps import Step
from tapeline.session import materialize

# step(state, row) -> (state, emitted). ``state`` is a list of floats, empty before the first row. Inputs are doubles or arrays.
StepFn = Callable[[list, tuple], tuple[list, object]]

# relink(states) adds ``_due`` to a table of the series keys, chunk, ``_entry`` and ``_exit``
Relink = Callable[[DataFrame], DataFrame]

_TOLERANCE = 1e-13


def _walk(step: StepFn, state: list, rows) -> tuple[list, list]:
    out = []
    for row in rows:
        state, emitted = step(state, row)
        out.append(emitted)
    return state, out


def _rows(pdf: pd.DataFrame, inputs: Sequence[str]):
    return list(zip(*[pdf[c].tolist() for c in inputs]))


def _guess(step: StepFn, pdf: pd.DataFrame, inputs: Sequence[str]) -> list:
    """Entry state of a chunk: empty at the start of the series, else the result of the rows before the chunk."""
    first = pdf[POS].iloc[int(np.argmax(pdf[CORE].to_numpy()))]
    before = pdf[pdf[POS] < first]
    return _walk(step, [], _rows(before, inputs))[0]


def _same(a: str, b: str):
    """Equal lengths and values, up to the rounding noise of a contracting recurrence."""
    # Spark counts NaN as larger than every number, so a distance that is NaN must not be compared
    near = lambda x, y: ~F.isnan(x) & ~F.isnan(y) & (F.abs(x - y) <= _TOLERANCE * F.greatest(F.abs(x), F.abs(y)))
    close = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) | F.coalesce(near(x, y), F.lit(False)))
    return (F.size(a) == F.size(b)) & F.forall(close, lambda ok: ok)


def settle_states(laid: Laid, step: StepFn, inputs: Sequence[str], relink: Relink | None = None) -> DataFrame | None:
    """Entry state of every chunk as a table, or ``None`` when no series has a second chunk.

    ``relink`` gives the entry state that is due to every chunk from the states of all chunks of a series; without it, that is
    the exit state of the chunk before.
    """
    keys = [*laid.keys, CHUNK]
    if laid.df.filter(F.col(CORE) & (F.col(CHUNK) > 0)).select(F.lit(1)).limit(1).count() == 0:
        return None
    plain = {f.name for f in laid.df.schema.fields if isinstance(f.dataType, ArrayType)}
    source = laid.df.select(*keys, POS, CORE, *[F.col(c) if c in plain else F.col(c).cast("double") for c in inputs])
    schema = StructType(
        [f for f in source.schema.fields if f.name in keys]
        + [StructField(n, ArrayType(DoubleType())) for n in ("_entry", "_exit")]
    )

    def first_pass(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(POS)
        entry = _guess(step, pdf, inputs)
        leave, _ = _walk(step, entry, _rows(pdf[pdf[CORE]], inputs))
        head = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**head, "_entry": [list(entry)], "_exit": [list(leave)]})

    def rerun(pdf: pd.DataFrame, fixed: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(fixed):
            return pd.DataFrame({f.name: [] for f in schema.fields})
        entry = list(fixed["_entry"].iloc[0])
        leave, _ = _walk(step, entry, _rows(pdf.sort_values(POS), inputs))
        head = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**head, "_entry": [list(entry)], "_exit": [list(leave)]})

    order = Window.partitionBy(*laid.keys).orderBy(CHUNK)
    states = materialize(source.groupBy(*keys).applyInPandas(first_pass, schema))
    while True:
        linked = relink(states) if relink else states.withColumn("_due", F.lag("_exit").over(order))
        wrong = linked.filter(F.col("_due").isNotNull() & ~_same("_entry", "_due"))
        wrong = materialize(wrong.select(*keys, F.col("_due").alias("_entry")))
        if wrong.isEmpty():
            return states.select(*keys, "_entry")
        again = source.filter(CORE).join(wrong.select(*keys), keys, "left_semi")
        fixed = again.groupBy(*keys).cogroup(wrong.groupBy(*keys)).applyInPandas(rerun, schema)
        states = materialize(states.join(wrong.select(*keys), keys, "left_anti").unionByName(fixed))


def _run_chunks(laid: Laid, step: StepFn, inputs: Sequence[str], shape, schema: StructType, relink: Relink | None = None) -> DataFrame:
    """Final pass over the core rows; ``shape(pdf, emitted)`` turns the walked rows into output rows."""
    keys = [*laid.keys, CHUNK]
    states = settle_states(laid, step, inputs, relink)
    source = laid.df.filter(CORE)

    def walked(pdf: pd.DataFrame, entry: list) -> pd.DataFrame:
        pdf = pdf.sort_values(POS).reset_index(drop=True)
        return shape(pdf, _walk(step, entry, _rows(pdf, inputs))[1])

    if states is None:
        return source.groupBy(*keys).applyInPandas(lambda pdf: walked(pdf, []), schema)

    def entered(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        return walked(pdf, list(state["_entry"].iloc[0]))

    return source.groupBy(*keys).cogroup(states.groupBy(*keys)).applyInPandas(entered, schema)


def fold_columns(laid: Laid, step: StepFn, inputs: Sequence[str], outputs: Sequence[str], tail: int = 0) -> Laid:
    """Add the values ``step`` emits as double columns; afterwards ``tail`` rows of lookback remain usable."""
    names = laid.df.columns
    schema = StructType(laid.df.schema.fields + [StructField(o, DoubleType()) for o in outputs])

    def shape(pdf: pd.DataFrame, emitted: list) -> pd.DataFrame:
        values = np.array(emitted, dtype=float).reshape(len(pdf), len(outputs))
        return pdf[names].assign(**{o: values[:, i] for i, o in enumerate(outputs)})

    done = _run_chunks(laid, step, inputs, shape, schema)
    done = done.withColumns({o: F.when(~F.isnan(o), F.col(o)) for o in outputs})
    return spread(done, laid.rows, tail, 0, laid.keys)


def fold_events(laid: Laid, step: StepFn, inputs: Sequence[str], columns: StructType, relink: Relink | None = None) -> DataFrame:
    """Rows ``step`` emits, usually few: it emits a list of tuples in the order of ``columns``.

    The output carries the series keys, position and time of the emitting row and the tuple fields.
    """
    lead = [f for f in laid.df.schema.fields if f.name in (*laid.keys, POS, "ts")]
    schema = StructType(lead + columns.fields)

    def shape(pdf: pd.DataFrame, emitted: list) -> pd.DataFrame:
        at = [i for i, rows in enumerate(emitted) for _ in rows]
        tuples = [row for rows in emitted for row in rows]
        out = pdf.iloc[at][[f.name for f in lead]].reset_index(drop=True)
        for j, field in enumerate(columns.fields):
            out[field.name] = [t[j] for t in tuples]
        return out

    narrow = dict.fromkeys([*laid.keys, CHUNK, POS, CORE, "ts", *inputs])
    return _run_chunks(laid.on(laid.df.select(*narrow)), step, inputs, shape, schema, relink)


def fold_step(step: StepFn, inputs: Sequence[str], outputs: Sequence[str], warmup: int, tail: int = 0) -> Step:
    """A fold as a step; ``warmup`` only sets how good the first guess of the entry state is."""
    return Step(lambda laid: fold_columns(laid, step, inputs, outputs, tail), warmup)
