"""Batches of ids asked for through a function that the user gives, with retries and a failed list.

The transport is the user's: ``transport(ids)`` gives a status as in HTTP and the bodies found, by id.  It runs in the
tasks, one batch at a time, so a partition is one connection.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparloom.functions.lineage import numbered
from sparloom.session import ship

Transport = Callable[[Sequence[int]], tuple[int, dict[int, str]]]
SCHEMA = "batch long, cid long, state string, attempts int, status int, body string"
OK, ABSENT, BUSY = 200, 404, 503


class Backoff:
    """Seconds to wait after an attempt: longer each time where the other side is busy, short otherwise."""

    def __init__(self, busy: float = 5.0, other: float = 2.0, sleep: Callable[[float], None] = time.sleep):
        self.busy, self.other, self.sleep = busy, other, sleep

    def after(self, status: int, attempt: int) -> None:
        self.sleep(self.busy * attempt if status == BUSY else self.other)


def ask(ids: Sequence[int], transport: Transport, attempts: int, backoff: Backoff) -> tuple[str, int, int, dict[int, str]]:
    """(state, attempts made, last status, bodies): ``done``, ``absent`` at once where the status says so, or
    ``failed`` after the last attempt.  An error of the transport counts as status 0."""
    status, bodies = 0, {}
    for attempt in range(1, attempts + 1):
        try:
            status, bodies = transport(ids)
        except Exception:  # noqa: BLE001  whatever the user's function raises is one failed attempt
            status, bodies = 0, {}
        if status == OK:
            return "done", attempt, status, bodies
        if status == ABSENT:
            return "absent", attempt, status, {}
        if attempt < attempts:
            backoff.after(status, attempt)
    return "failed", attempts, status, {}


def fetch(ids: DataFrame, transport: Transport, size: int = 100, attempts: int = 3, backoff: Backoff = Backoff(), singly: bool = False, partitions: int | None = None) -> DataFrame:
    """SCHEMA's columns, one row an id of ``ids`` (column ``cid``, repeated and null ones left out).

    Batches are ``size`` ids in order.  ``done``: the id's body, an empty one where the answer has none for it.
    ``absent``: not found; with ``singly`` (one id a batch) that is an empty body, as for ids without data, in larger
    batches any id of the batch may be the missing one, so all are ``failed``.  ``failed``: no attempt succeeded.
    ``partitions`` bounds how many batches are asked for at once.
    """
    ship(ids.sparkSession)
    size = 1 if singly else size
    wanted = numbered(ids.filter("cid is not null").select(F.col("cid").cast("long").alias("cid")).distinct(), [F.col("cid")], "n")
    batches = wanted.select(F.floor(F.col("n") / size).cast("long").alias("batch"), "cid")
    placed = batches.repartition(partitions, "batch") if partitions else batches.repartition("batch")

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(batch: int, cids: list[int]) -> pa.RecordBatch:
            state, made, status, bodies = ask(cids, transport, attempts, backoff)
            if state == "absent":
                state = "done" if singly else "failed"
            body = [bodies.get(c, "") if state == "done" else None for c in cids]
            n = len(cids)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([batch] * n, cids, [state] * n, [made] * n, [status] * n, body), kinds, strict=True)], names=["batch", "cid", "state", "attempts", "status", "body"])

        at, held = -1, []
        for part in parts:
            for batch, cid in zip(*[c.to_pylist() for c in part.columns], strict=True):
                if held and batch != at:
                    yield answer(at, held)
                    held = []
                at = batch
                held.append(cid)
        if held:
            yield answer(at, held)

    return placed.sortWithinPartitions("batch", "cid").mapInArrow(run, SCHEMA)
