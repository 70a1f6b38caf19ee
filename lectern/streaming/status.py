"""Job status, token streams and voice sessions as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Job states in order; the last two end a job.
STATES = ["none", "queued", "scripting", "synthesizing", "ready", "failed"]


def latest(events: DataFrame, key: str, status: str, time: str, tie: str) -> DataFrame:
    """The last status of each key by time, then ``tie``; batch or streaming (update mode)."""
    last = F.max_by(F.struct(F.col(status).alias("status"), F.col(time).alias("at")), F.struct(time, tie))
    return events.groupBy(key).agg(last.alias("_last"), F.count("*").alias("n_events")).select(key, "_last.status", "_last.at", "n_events")


def allowed(before: Column, after: Column) -> Column:
    """Whether a job may go from one state to another: forward, to failed before its end, or queued anew."""
    place = lambda s: F.array_position(F.array(*map(F.lit, STATES)), s)
    return (after == "queued") | ((after == "failed") & ~before.isin("ready", "failed")) | ((after != "failed") & (place(after) > place(before)) & ~before.isin("failed"))


def windowed(events: DataFrame, time: str, width: str, slide: str | None = None, late: str | None = None, *by: str) -> DataFrame:
    """Counts and sums of ``value`` in tumbling or sliding windows; ``late`` sets the watermark of a stream."""
    events = events.withWatermark(time, late) if late else events
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = events.groupBy(window, *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, key: str, time: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of a key: runs of events less than ``gap`` apart."""
    events = events.withWatermark(time, late) if late else events
    out = events.groupBy(key, F.session_window(time, gap).alias("s")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def tokens(lines: DataFrame, column: str = "value") -> DataFrame:
    """Tokens of newline-delimited JSON; lines that do not parse are skipped."""
    parsed = F.from_json(column, "message struct<content:string>, done boolean", {"mode": "PERMISSIVE"})
    out = lines.select(*[c for c in lines.columns if c != column], parsed.alias("_p"))
    return out.where(F.col("_p.message.content").isNotNull()).select(*[c for c in lines.columns if c != column], F.col("_p.message.content").alias("token"), F.coalesce("_p.done", F.lit(False)).alias("done"))


SESSION = "sid string, seq bigint, reply string"


class VoiceSession(StatefulProcessor):
    """State of one connection: its notebook from start to cancel or disconnect.

    Input rows: ``sid, seq, event, notebook_id, authenticated, owner``. Replies: ``ready``,
    ``sending``, ``cancelled``, an error, or ``rejected`` for a connection without sign-in.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.notebook = handle.getValueState("notebook", "notebook_id bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq")
        out = []
        for e in events.itertuples():
            reply = self.reply(e)
            if reply:
                out.append((key[0], e.seq, reply))
        if out:
            yield pd.DataFrame(out, columns=["sid", "seq", "reply"])

    def reply(self, e: object) -> str | None:
        if e.event == "connect":
            return None if e.authenticated else "rejected"
        if e.event == "start":
            if pd.isna(e.notebook_id):
                return "error: notebook_id required"
            if not e.owner:
                return "error: not owner"
            self.notebook.update((int(e.notebook_id),))
            return "ready"
        if e.event == "audio":
            return "error: audio must be sent via HTTP POST /voice/turn"
        if e.event in ("cancel", "disconnect"):
            self.notebook.clear()
        return {"stop": "sending", "cancel": "cancelled"}.get(e.event)

    def close(self) -> None:
        pass


#: The state store that sessions need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def voice_replies(events: DataFrame) -> DataFrame:
    """Replies to a stream of voice events, with the session of each connection as keyed state (append mode)."""
    return events.groupBy("sid").transformWithStateInPandas(VoiceSession(), SESSION, "append", "None")
