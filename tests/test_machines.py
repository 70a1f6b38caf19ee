"""Machines on streams against plain runs of the whole history, over batches, restarts and late rows."""

import datetime
import json
import pickle
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.streaming import ingest, machines

START = datetime.datetime(2024, 1, 1)
JOBS = "job string, seq long, ts timestamp, state string"
VOICE = "sid string, seq long, ts timestamp, event string, notebook_id long, user_id long, authenticated boolean, owner boolean"


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def micros(minutes):
    return 1704067200_000000 + round(minutes * 60_000000)


def fed(spark, tmp_path, batches, schema, machine, late):
    """Each batch through a stream of its own start, all with one checkpoint."""
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        with machines.state_store(spark):
            stream = machine(spark.readStream.schema(schema).parquet(source), 30 * 60, late)
            ingest.run_available(stream.writeStream.format("parquet").option("path", out), checkpoint)
    return sorted((tuple(r) for r in spark.read.parquet(out).collect()), key=str)


def test_job_that_is_stuck_refused_and_queued_anew(spark, tmp_path):
    rows = [
        ("a", 1, 0, "queued"), ("a", 2, 5, "scripting"), ("a", 3, 6, "queued"), ("a", 4, 7, "synthesizing"), ("a", 5, 8, "scripting"), ("a", 6, 9, "ready"), ("a", 7, 10, "failed"),
        ("b", 8, 0, "scripting"), ("b", 9, 20, "scripting"), ("b", 10, 45, "ready"), ("b", 11, 50, "queued"), ("b", 12, 55, "odd"), ("c", 13, 300, "queued"),
    ]
    made = [(j, s, at(m), x) for j, s, m, x in rows]
    want = [
        ("a", 1, "scripting", "queued anew", micros(0), micros(6), 2, 0), ("a", 2, "ready", "step", micros(6), micros(9), 3, 1),
        ("b", 1, "failed", "stuck", micros(0), micros(30), 1, 1), ("b", 2, "failed", "stuck", micros(50), micros(80), 1, 1),
    ]
    assert fed(spark, tmp_path, [made], JOBS, machines.job_runs, "10 minutes") == want


def test_jobs_do_not_depend_on_batches_order_or_restarts(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted(((rng.randrange(400), f"j{rng.randrange(4)}", rng.choice(["queued", "scripting", "synthesizing", "ready", "failed", None])) for _ in range(90)), key=lambda r: r[:2])
    rows = [(j, k, at(m), s) for k, (m, j, s) in enumerate(rows)] + [("end", 1000, at(600), "queued")]
    late = [r[:] for r in rows]
    rng.shuffle(late)
    late.sort(key=lambda r: (r[2] - START).seconds // 1200 + rng.random() * 0.9)  # no row is 40 minutes late
    batches = [late[:30], late[30:60], late[60:]]
    got = fed(spark, tmp_path, batches, JOBS, machines.job_runs, "40 minutes")
    machine, want = machines.JobMachine(30 * 60_000000), []
    for job in {r[0] for r in rows}:
        own = sorted((micros((r[2] - START).total_seconds() / 60), r[1], r[3]) for r in rows if r[0] == job)
        want += [(job, *x) for x in machine.advance(machine.start(), [r for r in own if r[0] <= micros(560)], micros(560))[1]]
    assert got == sorted(want, key=str) and {r[3] for r in got} == {"step", "stuck", "queued anew"}


def test_sessions(spark, tmp_path):
    rows = [
        ("s", 0, "start", 7, 1, True, True), ("s", 1, "connect", None, 1, True, True), ("s", 2, "start", 7, 1, True, True), ("s", 3, "stop", None, 1, True, True), ("s", 4, "audio", None, 1, True, True),
        ("s", 5, "start", 8, 1, True, True), ("s", 6, "start", None, 1, True, True), ("s", 7, "start", 9, 1, True, False), ("s", 8, "cancel", None, 1, True, True), ("s", 9, "cancel", None, 1, True, True),
        ("s", 10, "disconnect", None, 1, True, True), ("s", 11, "stop", None, 1, True, True), ("t", 0, "connect", None, 2, False, True), ("t", 1, "start", 3, 2, True, True),
        ("t", 2, "connect", None, 2, True, True), ("t", 3, "start", 3, 2, True, True), ("t", 60, "stop", None, 2, True, True), ("u", 500, "connect", None, 4, True, True),
    ]
    made = [(s, k, at(k), *r) for s, k, *r in rows]
    reply = lambda s, k, text: (s, k, "reply", text, None, None, None, None, None)
    want = [
        reply("s", 2, "ready"), reply("s", 3, "sending"), reply("s", 4, "error: audio must be sent via HTTP POST /voice/turn"),
        ("s", 5, "end", "started anew", 7, 1, micros(2), micros(5), 1), reply("s", 5, "ready"), reply("s", 6, "error: notebook_id required"), reply("s", 7, "error: not owner"),
        ("s", 8, "end", "cancelled", 8, 1, micros(5), micros(8), 0), reply("s", 8, "cancelled"), reply("s", 9, "cancelled"),
        reply("t", 0, "rejected"), reply("t", 3, "ready"), ("t", None, "end", "expired", 3, 2, micros(3), micros(33), 0), reply("t", 60, "sending"),
    ]
    assert fed(spark, tmp_path, [made[:5], made[5:13], made[13:]], VOICE, machines.voice_history, "120 minutes") == sorted(want, key=str)


def test_too_late_rows_change_nothing(spark, tmp_path):
    first = [("a", 1, at(0), "queued"), ("a", 2, at(5), "ready"), ("z", 3, at(200), "queued")]
    got = fed(spark, tmp_path, [first, [("a", 4, at(3), "failed"), ("z", 5, at(201), "queued")]], JOBS, machines.job_runs, "10 minutes")
    assert got == [("a", 1, "ready", "step", micros(0), micros(5), 2, 0)]


class Held:
    """A state that counts what is written to it."""

    def __init__(self):
        self.rows, self.written = [], 0

    def appendValue(self, row):
        self.rows.append(row)
        self.written += 1

    def get(self):
        return iter(self.rows)


def test_rows_of_a_batch_wait_as_one_value_with_their_nulls():
    machine, timers = machines.VoiceMachine(60_000000), []
    machine.handle = type("Handle", (), {"registerTimer": staticmethod(timers.append)})
    machine.waiting = Held()
    rows = [(5_000001, 1, "start", None, 7, True, None), (4_000000, 2, None, 3, 7, False, True)]
    names = [x.split()[0] for x in machine.ROW.split(", ")]
    list(machine.handleInputRows(("a",), iter([pd.DataFrame(rows, columns=names)]), None))
    assert machine.waiting.written == 1 and timers == [4000]
    assert [r for (packed,) in machine.waiting.get() for r in pickle.loads(packed)] == rows


class Empty(Held):
    """A state that holds nothing, or the rows given."""

    def put(self, rows):
        self.rows = rows

    update = put

    def clear(self):
        self.rows, self.written = [], self.written + 1

    def get(self):
        return iter(self.rows) if self.rows else None


def test_a_key_tells_its_rows_as_one_value_and_clears_no_empty_state():
    machine = machines.VoiceMachine(60_000000)
    machine.handle = type("Handle", (), {"registerTimer": staticmethod(lambda at: None)})
    machine.waiting, machine.held = Empty(), Empty()
    machine.waiting.rows = [(pickle.dumps([(1_000000, 1, "connect", None, 7, False, None), (2_000000, 2, "connect", None, 7, False, None)]),)]
    (told,) = machine.handleExpiredTimer(("a",), type("Times", (), {"getCurrentWatermarkInMs": staticmethod(lambda: 9000)}), None)
    assert told.shape == (1, 2) and machine.held.written == 0 and not machine.waiting.rows
    assert [(r["seq"], r["text"], r["started"]) for r in json.loads(told["told"][0])] == [(1, "rejected", None), (2, "rejected", None)]
