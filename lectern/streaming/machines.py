"""Keyed state machines on streams: jobs that fail by themselves when stuck, and voice sessions that expire.

A key's rows are worked off in the order of event time: they wait in state until the watermark
has passed them, so neither the order of arrival nor the cut of batches changes a result, as
long as a row is no later than the watermark allows. Rows later than that are dropped by Spark. What a key
has waiting is bounded by its rows within the allowed lateness.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterable, Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .status import STATE_STORE, STATES

MICROS = 1_000_000


class EventOrder(StatefulProcessor):
    """Rows of a key by event time. A machine says what a row does, when a state ends by itself, and what then happens.

    ``ROW``, ``STATE`` and ``OUT`` are schemas; a row begins with ``at`` (microseconds) and ``seq``, which
    breaks ties; an output row begins with the key. ``idle`` is in microseconds.
    """

    ROW = STATE = OUT = ""

    def __init__(self, idle: int) -> None:
        self.idle = idle

    def start(self) -> tuple:
        """The state of a key without one."""
        raise NotImplementedError

    def deadline(self, state: tuple) -> int | None:
        """When the state ends by itself, if it does."""
        raise NotImplementedError

    def expired(self, state: tuple, at: int) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def advance(self, state: tuple, rows: Iterable[tuple], mark: int) -> tuple[tuple, list[tuple]]:
        """The state after ``rows``, in order, and after all that ends by itself up to ``mark``; and what to tell."""
        out: list[tuple] = []

        def end(before: int) -> None:
            nonlocal state
            while (at := self.deadline(state)) is not None and at < before:
                state, told = self.expired(state, at)
                out.extend(told)

        for row in rows:
            end(row[0])
            state, told = self.step(state, row)
            out.extend(told)
        end(mark + 1)
        return state, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # a batch's rows are one value: each value of a state is a message of its own to Spark
        self.waiting = handle.getListState("waiting", "packed binary")
        self.held = handle.getValueState("held", self.STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fields = [x.split() for x in self.ROW.split(", ")]
        kinds = {"bigint": int, "boolean": bool, "string": str}  # pandas makes whole numbers with nulls floats
        first = None
        for batch in rows:
            columns = ([None if x is None or x is pd.NA or x != x else kinds[kind](x) for x in batch[name].tolist()] for name, kind in fields)
            own = [*zip(*columns)]
            self.waiting.appendValue((pickle.dumps(own),))
            first = min(r[0] for r in own) if first is None else min(first, *(r[0] for r in own))
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((r for (packed,) in self.waiting.get() for r in pickle.loads(packed)), key=lambda r: r[:2])
        due = [r for r in waiting if r[0] <= mark]
        before = self.held.get()
        state, out = self.advance(before or self.start(), due, mark)
        if due:
            left = waiting[len(due) :]
            if left:
                self.waiting.put([(pickle.dumps(left),)])
                self.handle.registerTimer(-(-left[0][0] // 1000))
            else:
                self.waiting.clear()
        if state == self.start():
            if before:
                self.held.clear()
        else:
            self.held.update(tuple(state))
        if (at := self.deadline(state)) is not None:
            self.handle.registerTimer(-(-at // 1000))
        if out:  # a frame is dear for each of its columns, so a key's rows go as one text, which Spark takes apart
            names = [x.split()[0] for x in self.OUT.split(", ")[1:]]
            yield pd.DataFrame({"key": [key[0]], "told": [json.dumps([dict(zip(names, r)) for r in out])]})

    def close(self) -> None:
        pass


class Job(NamedTuple):
    run: int
    state: str
    since: int | None
    started: int | None
    steps: int
    refused: int


class JobMachine(EventOrder):
    """Runs of a job: a row for each that ends, by reaching ready or failed, by being queued anew, or by standing still.

    A step is allowed forward, to failed before the end, or to queued; others are refused, counted, and
    do not keep a stuck run alive. A run that stands still for ``idle`` fails at that moment.
    """

    ROW = "at bigint, seq bigint, state string"
    STATE = "run bigint, state string, since bigint, started bigint, steps bigint, refused bigint"
    OUT = "job string, run bigint, status string, reason string, started bigint, ended bigint, steps bigint, refused bigint"

    def start(self) -> Job:
        return Job(0, "none", None, None, 0, 0)

    def deadline(self, state: tuple) -> int | None:
        job = Job(*state)
        return None if job.started is None else job.since + self.idle

    def _ended(self, job: Job, status: str, reason: str, at: int) -> tuple[Job, list[tuple]]:
        return Job(job.run, status, None, None, 0, 0), [(job.run, status, reason, job.started, at, job.steps, job.refused)]

    def expired(self, state: tuple, at: int) -> tuple[Job, list[tuple]]:
        return self._ended(Job(*state), "failed", "stuck", at)

    def step(self, state: tuple, row: tuple) -> tuple[Job, list[tuple]]:
        job, (at, _, after) = Job(*state), row
        told: list[tuple] = []
        if after not in STATES[1:]:
            return job._replace(refused=job.refused + (job.started is not None)), told
        if after == "queued":
            if job.started is not None:
                job, told = self._ended(job, job.state, "queued anew", at)
        elif job.state == "failed" or (after == "failed" and job.state == "ready") or (after != "failed" and STATES.index(after) <= STATES.index(job.state)):
            return job._replace(refused=job.refused + (job.started is not None)), told
        if job.started is None:
            job = Job(job.run + 1, after, at, at, 0, 0)
        job = job._replace(state=after, since=at, steps=job.steps + 1)
        if after in ("ready", "failed"):
            job, more = self._ended(job, after, "step", at)
            told += more
        return job, told


class Session(NamedTuple):
    connected: bool
    notebook: int | None
    owner: int | None
    started: int | None
    last: int | None
    turns: int


class VoiceMachine(EventOrder):
    """Voice connections: a reply for each event that has one, and a row for each session that ends.

    A connection without sign-in is rejected, and nothing is heard of it until it connects anew. A session
    belongs to the notebook and user that started it; it ends by cancel, disconnect, another start, or
    after ``idle`` without an event. Stopping counts as a turn of the session, if there is one.
    """

    ROW = "at bigint, seq bigint, event string, notebook_id bigint, user_id bigint, authenticated boolean, owner boolean"
    STATE = "connected boolean, notebook bigint, owner bigint, started bigint, last bigint, turns bigint"
    OUT = "sid string, seq bigint, kind string, text string, notebook_id bigint, user_id bigint, started bigint, ended bigint, turns bigint"

    def start(self) -> Session:
        return Session(False, None, None, None, None, 0)

    def deadline(self, state: tuple) -> int | None:
        s = Session(*state)
        return None if s.notebook is None else s.last + self.idle

    def _ended(self, s: Session, seq: int | None, reason: str, at: int) -> tuple[Session, list[tuple]]:
        told = [] if s.notebook is None else [(seq, "end", reason, s.notebook, s.owner, s.started, at, s.turns)]
        return Session(s.connected, None, None, None, None, 0), told

    def expired(self, state: tuple, at: int) -> tuple[Session, list[tuple]]:
        return self._ended(Session(*state), None, "expired", at)

    def step(self, state: tuple, row: tuple) -> tuple[Session, list[tuple]]:
        s, (at, seq, event, notebook, user, authenticated, owner) = Session(*state), row
        reply = lambda text: [(seq, "reply", text, None, None, None, None, None)]
        if event == "connect":
            return s._replace(connected=bool(authenticated), last=at if s.notebook is not None else None), [] if authenticated else reply("rejected")
        if not s.connected:
            return s, []
        s = s._replace(last=at if s.notebook is not None else None)
        if event == "start":
            if notebook is None:
                return s, reply("error: notebook_id required")
            if not owner:
                return s, reply("error: not owner")
            _, told = self._ended(s, seq, "started anew", at)
            return Session(True, notebook, user, at, at, 0), told + reply("ready")
        if event == "audio":
            return s, reply("error: audio must be sent via HTTP POST /voice/turn")
        if event == "stop":
            return s._replace(turns=s.turns + (s.notebook is not None)), reply("sending")
        if event == "cancel":
            s, told = self._ended(s, seq, "cancelled", at)
            return s, told + reply("cancelled")
        if event == "disconnect":
            s, told = self._ended(s, seq, "disconnected", at)
            return self.start(), told
        return s, []


def _machine(events: DataFrame, key: str, time: str, late: str, machine: EventOrder) -> DataFrame:
    named = events.withWatermark(time, late).withColumn("at", F.unix_micros(time))
    told = named.groupBy(key).transformWithStateInPandas(machine, "key string, told string", "append", "EventTime")
    first, rest = machine.OUT.split(", ", 1)
    return told.select(F.col("key").alias(first.split()[0]), F.inline(F.from_json("told", f"array<struct<{rest}>>")))


def job_runs(events: DataFrame, idle: int, late: str, time: str = "ts") -> DataFrame:
    """``events`` (``job`` text, ``seq``, ``state`` and the time): ended runs, see ``JobMachine``; ``idle`` in seconds."""
    return _machine(events, "job", time, late, JobMachine(idle * MICROS))


def voice_history(events: DataFrame, idle: int, late: str, time: str = "ts") -> DataFrame:
    """``events`` (``sid`` text, ``seq``, ``event``, ``notebook_id``, ``user_id``, ``authenticated``, ``owner``, the time): replies and ended sessions, see ``VoiceMachine``."""
    return _machine(events, "sid", time, late, VoiceMachine(idle * MICROS))


class state_store:
    """Within it, new streams keep their state in the store that keyed machines need; the old setting returns."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(STATE_STORE[0])
        self.spark.conf.set(*STATE_STORE)

    def __exit__(self, *_: object) -> None:
        self.spark.conf.set(STATE_STORE[0], self.before)
