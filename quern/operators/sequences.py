"""Sequence patterns per entity, and deterministic replay."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Step:
    """``column`` must equal ``equals`` (and ``value`` reach ``least``), ``count`` times, each at most ``max_gap_us`` after the last."""

    equals: str
    count: int = 1
    max_gap_us: int | None = None
    least: float | None = None


class Matcher:
    """One run per entity: events that don't fit are skipped; a match or an expiry starts anew."""

    def __init__(self, steps: list[Step], total_us: int):
        self.steps, self.total = steps, total_us
        self.at = self.seen = 0
        self.first = self.last = 0

    def feed(self, t: int, kind: str, value: float) -> tuple[int, int] | None:
        if self.at > 0 and t - self.first > self.total:
            self.at = self.seen = 0  # the event that expires a run is not looked at again
            return None
        s = self.steps[self.at]
        if kind != s.equals or (s.least is not None and not value >= s.least):
            return None
        if (self.at or self.seen) and s.max_gap_us is not None and t - self.last > s.max_gap_us:
            return None
        if self.at == 0 and self.seen == 0:
            self.first = t
        self.seen, self.last = self.seen + 1, t
        if self.seen < s.count:
            return None
        self.at, self.seen = self.at + 1, 0
        if self.at < len(self.steps):
            return None
        self.at = 0
        return self.first, t


def matches(df: DataFrame, entity: str, time: str, kind: str, value: str, tie: str, steps: list[Step], total_seconds: int) -> DataFrame:
    """(entity, first_us, last_us) of each match.

    Events are partitioned by entity and sorted within the partition, then streamed batch by
    batch through one matcher per entity: a hot entity is never held in memory.
    """
    us = F.unix_micros(F.col(time).cast("timestamp"))
    src = df.where(F.col(time).isNotNull() & F.col(entity).isNotNull()).select(F.col(entity).alias("entity"), us.alias("t"), F.col(kind).alias("kind"), F.col(value).cast("double").alias("value"), F.col(tie).alias("tie"))
    ordered = src.repartition("entity").sortWithinPartitions("entity", "t", "tie")
    schema = f"{entity} {dict(df.dtypes)[entity]}, first_us bigint, last_us bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, m = None, None
        for b in batches:
            out = []
            for e, t, k, v in zip(b["entity"], b["t"], b["kind"], b["value"]):
                if e != now:
                    now, m = e, Matcher(steps, total_seconds * 1_000_000)
                hit = m.feed(t, k, v)
                if hit:
                    out.append((e, *hit))
            yield pd.DataFrame(out, columns=[entity, "first_us", "last_us"])

    return ordered.mapInPandas(run, schema)


def folded(df: DataFrame, key: list[str], order: list[str], inputs: list[str], start: Callable[[], Callable[..., tuple | None]], outputs: str) -> DataFrame:
    """``key``, ``order`` and the outputs of a recurrence over each key's rows in order.

    ``start()`` gives a function for a key, which gets the inputs of one row after the other and returns the
    outputs, or None for no row. Rows are partitioned by key and sorted within, then streamed in Arrow batches: a task
    holds a batch and one key's function, however many rows a key has. A recurrence can't be cut, so a hot key takes one
    task's time. Rows without key are skipped; ties in ``order`` must be told apart by it.
    """
    names = [*key, *order]
    kinds = dict(df.dtypes)
    own = [f"_i{k}" for k in range(len(inputs))]
    src = df.where(" and ".join(f"`{k}` is not null" for k in key)).select(*names, *[F.col(c).alias(o) for c, o in zip(inputs, own)])
    ordered = src.repartition(*key).sortWithinPartitions(*names)
    made = [c.strip().split()[0] for c in outputs.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, step = None, None
        for b in batches:
            keep, out = [], []
            keys = list(zip(*[b[k] for k in key]))
            for i, (k, x) in enumerate(zip(keys, zip(*[b[o] for o in own]))):
                if k != now:
                    now, step = k, start()
                r = step(*x)
                if r is not None:
                    keep.append(i)
                    out.append(r)
            yield pd.concat([b[names].iloc[keep].reset_index(drop=True), pd.DataFrame(out, columns=made)], axis=1)

    return ordered.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), outputs]))


def hash_chain(df: DataFrame, key: str, order: list[str], content: str) -> DataFrame:
    """key, ``order`` and ``link``: sha256 of the previous link and the row's content, per key in order; the first link starts from ''."""

    def start() -> Callable[[object], tuple[str]]:
        link = ""

        def step(c: object) -> tuple[str]:
            nonlocal link
            link = hashlib.sha256((link + (c if isinstance(c, str) else "")).encode()).hexdigest()
            return (link,)

        return step

    return folded(df.withColumn(content, F.col(content).cast("string")), [key], order, [content], start, "link string")


def replay_differs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows that only one of two runs gave, with ``_run``; empty if the computation is deterministic."""
    return first.exceptAll(second).withColumn("_run", F.lit(1)).unionByName(second.exceptAll(first).withColumn("_run", F.lit(2)))
