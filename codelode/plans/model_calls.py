"""Calls of a model from inside tasks: a client for each task, batches, waits, a fallback, a shared rate, errors as rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import AppError, RateLimited, classified

#: A client takes prompts and gives for each a reply, or the error that it ended in; it may also raise for all of them.
Client = Callable[[list[str]], list]


class Model(NamedTuple):
    """How a model is called. ``connect`` and ``fallback`` make a client where they are called, in a task."""

    connect: Callable[[], Client]
    fallback: Callable[[], Client] | None = None
    batch: int = 8
    attempts: int = 3
    first_wait: float = 1.0
    most_wait: float = 8.0
    #: Calls a second over all tasks; each of the ``tasks`` takes its share.
    per_second: float | None = None
    tasks: int = 8


CALLED = "reply string, attempts int, fell_back boolean, error_code string, retryable boolean"


class _Caller:
    """A task's clients, connected when first needed, and its pace."""

    def __init__(self, model: Model):
        self.model, self.clients, self.next = model, {}, 0.0

    def ask(self, which: str, prompts: list[str]) -> list:
        """A reply or one of our errors for each prompt."""
        if self.model.per_second:
            time.sleep(max(0.0, self.next - time.monotonic()))
            self.next = time.monotonic() + self.model.tasks / self.model.per_second
        try:
            if which not in self.clients:
                self.clients[which] = getattr(self.model, which)()
            replies = self.clients[which](prompts)
            if len(replies) != len(prompts):
                raise ValueError(f"{len(replies)} replies to {len(prompts)} prompts")
        except Exception as e:
            return [classified(e)] * len(prompts)
        return [classified(r) if isinstance(r, Exception) else r for r in replies]

    def answered(self, prompts: list[str]) -> list[tuple]:
        """(reply, attempts, fell_back, error): errors that may pass are tried again after doubling waits, a limited rate goes to the fallback at once."""
        out: list = [None] * len(prompts)
        left = list(range(len(prompts)))
        for k in range(1, self.model.attempts + 1):
            again, limited = [], []
            for j, r in zip(left, self.ask("connect", [prompts[j] for j in left])):
                out[j] = (None, k, False, r) if isinstance(r, AppError) else (r, k, False, None)
                if isinstance(r, RateLimited) and self.model.fallback:
                    limited.append(j)
                elif isinstance(r, AppError) and r.retryable:
                    again.append(j)
            for j, r in zip(limited, self.ask("fallback", [prompts[j] for j in limited]) if limited else []):
                out[j] = (None, k + 1, True, r) if isinstance(r, AppError) else (r, k + 1, True, None)
            left = again
            if not left:
                break
            if k < self.model.attempts:
                time.sleep(min(self.model.most_wait, self.model.first_wait * 2 ** (k - 1)))
        return out


def called(prompts: DataFrame, model: Model) -> DataFrame:
    """(id, reply, attempts, fell_back, error_code, retryable) of every prompt (id, prompt).

    A prompt that ends in an error has no reply but its code, and whether another run may help; the job goes on. Empty
    and null prompts are sent as empty ones. Attempts count every call that a prompt was part of, the fallback's too.
    """
    kind = prompts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caller = _Caller(model)
        for batch in batches:
            for at in range(0, batch.num_rows, model.batch):
                part = batch.slice(at, model.batch)
                reply, attempts, fell_back, error = zip(*caller.answered([p or "" for p in part.column(1).to_pylist()]))
                codes, again = [e and e.code for e in error], [e and e.retryable for e in error]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(reply, pa.string()), pa.array(attempts, pa.int32()), pa.array(fell_back), pa.array(codes, pa.string()), pa.array(again, pa.bool_())], names=["id", *(c.split()[0] for c in CALLED.split(", "))])

    return prompts.select("id", "prompt").repartition(model.tasks).mapInArrow(run, f"id {kind}, {CALLED}")


def call_totals(calls: DataFrame) -> DataFrame:
    """One row over all calls: completed, errors, those tried again, those that the fallback answered."""
    return calls.agg(
        F.count_if(F.col("error_code").isNull()).alias("completed"),
        F.count("error_code").alias("errors"),
        F.count_if(F.col("attempts") > 1).alias("retried"),
        F.count_if(F.col("fell_back") & F.col("error_code").isNull()).alias("fallback_used"),
    )
