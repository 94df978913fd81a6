"""Chained jobs: the output of one is the input of the next."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame

from shuffleworks.session import durable


@dataclass(frozen=True)
class Job:
    """A named step. ``fn`` takes the output of ``chained_after``, or ``source`` if it has none."""

    name: str
    fn: Callable[[DataFrame], DataFrame]
    chained_after: str | None = None
    source: DataFrame | None = None


def run_chain(jobs: list[Job], keep_shared: bool = True) -> Mapping[str, DataFrame]:
    """Compose the jobs along ``chained_after``; name -> (lazy) output.

    Steps with one reader stay in one Spark plan, with no files between them. An
    output that several jobs read is checkpointed once, unless ``keep_shared`` is
    False.
    """
    by_name = {job.name: job for job in jobs}
    if len(by_name) != len(jobs):
        raise ValueError("two jobs have the same name")
    unknown = [job.name for job in jobs if job.chained_after and job.chained_after not in by_name]
    if unknown:
        raise ValueError(f"unknown predecessor for: {', '.join(unknown)}")
    sourceless = [job.name for job in jobs if job.chained_after is None and job.source is None]
    if sourceless:
        raise ValueError(f"neither source nor predecessor for: {', '.join(sourceless)}")
    edges = {job.name: [job.chained_after] if job.chained_after else [] for job in jobs}
    try:
        order = list(TopologicalSorter(edges).static_order())
    except CycleError as exc:
        raise ValueError(f"jobs form a cycle: {' -> '.join(exc.args[1])}") from exc
    readers = Counter(job.chained_after for job in jobs if job.chained_after)
    outputs: dict[str, DataFrame] = {}
    for name in order:
        job = by_name[name]
        result = job.fn(outputs[job.chained_after] if job.chained_after else job.source)
        outputs[name] = durable(result) if keep_shared and readers[name] > 1 else result
    return outputs
