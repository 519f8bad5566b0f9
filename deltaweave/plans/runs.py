"""Batch, sampled and driven runs, as tables of frames ``(i, time, ...)``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaweave.functions import sorts
from deltaweave.operators.trace import Trace
from deltaweave.plans.schedule import Change, Engine, Store, apply_changes
from deltaweave.runtime import stage

#: After so many steps the state is written, which cuts its lineage.
EVERY = 8


def _steps(runtime: float, timestep: float) -> int:
    return max(0, round(runtime / timestep))


def _framed(frames: list[tuple[float, DataFrame]]) -> DataFrame:
    told = [f.select(F.lit(i).cast("long").alias("i"), F.lit(float(t)).alias("time"), *f.columns) for i, (t, f) in enumerate(frames)]
    return reduce(DataFrame.unionByName, told)


def run_process(start: DataFrame, update: Callable[[DataFrame, float], DataFrame], runtime: float = 1.0, timestep: float = 0.1, name: str = "process", element: sorts.Sort = sorts.ANY) -> Trace:
    """Each update is the next state."""
    frames, now = [(0.0, start)], start
    for n in range(_steps(runtime, timestep)):
        now = update(now, timestep)
        now = stage(now, "frame") if (n + 1) % EVERY == 0 else now
        frames.append(((n + 1) * timestep, now))
    return Trace(_framed(frames), name, element)


def simulate(start: Store, update: Callable[[DataFrame, float], Change], runtime: float = 1.0, timestep: float = 0.1, name: str = "process", element: sorts.Sort = sorts.ANY) -> Trace:
    """Each update is a change of the state, which acts by the rule of its store."""
    frames, now = [(0.0, start.rows)], start
    for n in range(_steps(runtime, timestep)):
        now = apply_changes(now, [update(now.rows, timestep)])
        if (n + 1) % EVERY == 0:
            now = Store(stage(now.rows, "frame"), now.keys, now.value, now.additive)
        frames.append(((n + 1) * timestep, now.rows))
    return Trace(_framed(frames), name, element)


def invoke(engine: Engine, outputs: list[str], duration: float) -> dict[str, DataFrame]:
    """The output stores after a run."""
    engine.run(duration)
    return engine.view(tuple(outputs))


def invoke_trace(engine: Engine, output: str, duration: float, sample: float, element: sorts.Sort = sorts.ANY) -> Trace:
    """An output store at the start and after each sample."""
    frames = [(0.0, engine.view((output,))[output])]
    for n in range(_steps(duration, sample) if sample > 0 else 0):
        engine.run(sample)
        frames.append(((n + 1) * sample, engine.view((output,))[output]))
    return Trace(_framed(frames), output, element)


def invoke_driven(engine: Engine, source: str, given: Trace, output: str, wanted: sorts.Sort = sorts.ANY) -> Trace:
    """An output store while a trace drives a source store: its rows are set at each of the trace's times, then time passes to the next.

    A trace whose elements do not refine ``wanted`` is refused before anything runs.
    """
    if not sorts.refines(given.element, wanted):
        raise TypeError(f"{given.element.kind} does not refine {wanted.kind}")
    frames, before = [], None
    for i, time in [(r["i"], r["time"]) for r in given.times().collect()]:
        engine.replace_rows(source, given.rows.where(F.col("i") == i).drop("i", "time"))
        engine.settle({source})
        if before is not None and time > before:
            engine.run(time - before)
        frames.append((time, engine.view((output,))[output]))
        before = time
    if not frames:
        rows = engine.view((output,))[output].limit(0)
        return Trace(_framed([(0.0, rows)]), output)
    return Trace(_framed(frames), output)
