"""Operators with state of their own for each key: event streams that come in chunks, and values that expire."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The most bytes of one frame, and of chunks that came before those in front of them; a stream beyond either is closed.
FRAME, EARLY = 2 << 20, 16 << 20
ROOT = "0" * 64
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_tables(spark: SparkSession):
    """While a query with these operators is started: the state store that they need. A running query keeps its own."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class Frames:
    """A parser of server-sent events over chunks of bytes: what it holds between chunks is the line and the frame that are open, the number and the chain so far.

    Chunks may be cut anywhere, within letters too: lines are only decoded when they are whole. Events are numbered from 1 and chained, each by the SHA-256
    of the chain before it and its own. A frame of more than `most` bytes, or bytes that aren't UTF-8, end the stream with a row that says so.
    """

    def __init__(self, most: int = FRAME, held: tuple = (b"", (), 0, 0, ROOT)):
        self.most = most
        self.tail, lines, self.used, self.number, self.chain = held
        self.lines = list(lines)
        self.error = ""

    def held(self) -> tuple:
        return self.tail, self.lines, self.used, self.number, self.chain

    def feed(self, chunk: bytes, last: bool = False) -> list[tuple]:
        """Rows (sequence, event, data, id, retry, event_hash, chain, error) of the frames that end in this chunk, or with the last one."""
        out: list[tuple] = []
        *whole, self.tail = (self.tail + chunk).split(b"\n")
        for line in whole:
            self._line(line.removesuffix(b"\r"), 1, out)
        if not self.error and len(self.tail) + self.used > self.most:
            self._close("frame too large", out)
        if last and not self.error:
            if self.tail:
                self._line(self.tail.removesuffix(b"\r"), 0, out)
            self._frame(out)
            self.tail = b""
        return out

    def _close(self, why: str, out: list[tuple]) -> None:
        self.error, self.tail, self.lines = why, b"", []
        out.append((self.number + 1, None, None, None, None, None, self.chain, why))

    def _line(self, line: bytes, end: int, out: list[tuple]) -> None:
        if self.error:
            return
        if not line and end:
            self._frame(out)
            return
        self.used += len(line) + end
        if self.used > self.most:
            self._close("frame too large", out)
        elif not line.startswith(b":"):
            try:
                self.lines.append(line.decode("utf-8"))
            except UnicodeDecodeError:
                self._close("invalid UTF-8", out)

    def _frame(self, out: list[tuple]) -> None:
        told: dict[str, list[str]] = {"event": [], "id": [], "retry": [], "data": []}
        for line in self.lines:
            name, _, value = line.partition(":")
            if name in told:
                told[name].append(value.removeprefix(" "))
        self.lines, self.used = [], 0
        event = ([*told["event"]] or ["message"])[-1]
        mark = ([x for x in told["id"] if "\0" not in x] or [""])[-1]
        retry = ([int(x) for x in told["retry"] if x.isdecimal() and x.isascii()] or [None])[-1]
        if not told["data"] and event == "message" and not mark and retry is None:
            return
        self.number += 1
        data = "\n".join(told["data"])
        body = {"sequence": self.number, "event": event, "data": data, "id": mark, "retry": retry}
        own = hashlib.sha256(json.dumps(body, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode("utf-8", "surrogatepass"))
        self.chain = hashlib.sha256(bytes.fromhex(self.chain) + own.digest()).hexdigest()
        out.append((self.number, event, data, mark, retry, own.hexdigest(), self.chain, None))


_EVENT = ["sequence", "event", "data", "id", "retry", "event_hash", "chain", "error"]


class _EventStream(StatefulProcessor):
    def __init__(self, key: str, most: int):
        self.key, self.most = key, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "tail binary, lines array<string>, used bigint, number bigint, chain string, next bigint, early bigint, over boolean")
        self.early = handle.getMapState("early", "chunk bigint", "body binary, last boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.open.get()) if self.open.exists() else (b"", [], 0, 0, ROOT, 0, 0, False)
        frames, (turn, waiting, over), out = Frames(self.most, (bytes(held[0]), *held[1:5])), held[5:], []
        for frame in rows:
            for n, body, last in sorted(zip(frame["sl_chunk"].tolist(), frame["sl_body"].tolist(), frame["sl_last"].tolist(), strict=True), key=lambda r: r[0]):
                if over or n < turn:
                    continue  # behind the end, or a chunk that came before
                body = bytes(body) if body is not None else b""
                if n > turn:
                    if not self.early.containsKey((n,)):
                        self.early.updateValue((n,), (body, bool(last)))
                        waiting += len(body)
                        if waiting > EARLY:
                            frames._close("a chunk is missing", out)
                            over = True
                    continue
                while True:
                    out += frames.feed(body, bool(last))
                    turn += 1
                    over = bool(last) or bool(frames.error)
                    if over or not self.early.containsKey((turn,)):
                        break
                    body, last = self.early.getValue((turn,))
                    self.early.removeKey((turn,))
                    body = bytes(body)
                    waiting -= len(body)
        if over:
            self.early.clear()
        self.open.update((*frames.held(), turn, waiting, over))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=[self.key, *_EVENT]).astype({"retry": "Int64"})

    def close(self) -> None:
        pass


def event_streams(chunks: DataFrame, key: str, number: str, body: str, last: str, most: int = FRAME) -> DataFrame:
    """(key, sequence, event, data, id, retry, event_hash, chain, error) of server-sent events whose bytes come in chunks numbered from 0 by key, the last one marked.

    State by key: what Frames holds, and chunks that came before those in front of them. However the bytes are cut into chunks, and chunks into batches, the
    rows are the same. A closed stream keeps a row of state, so that what comes behind its end, or a chunk twice, gives nothing. Chunks of a key are
    taken in turn by one task, in the memory of a frame. Start the query within state_tables().
    """
    kind = dict(chunks.dtypes)[key]
    out = f"{key} {kind}, sequence bigint, event string, data string, id string, retry bigint, event_hash string, chain string, error string"
    rows = chunks.select(key, F.col(number).cast("bigint").alias("sl_chunk"), F.col(body).cast("binary").alias("sl_body"), F.coalesce(F.col(last), F.lit(False)).alias("sl_last"))
    return rows.groupBy(key).transformWithStateInPandas(_EventStream(key, most), out, "Append", "None")


#: The time of rows that have none, and the end of values without one.
NEVER = (1 << 63) - 1
#: Groups that keys of expiring() are dealt to. A checkpoint keeps the number that it was made with.
BUCKETS = 512


def _due(until: np.ndarray) -> np.ndarray:
    """Timers know milliseconds."""
    return -(-until // 1000)


class _Expiring(StatefulProcessor):
    """A bucket's keys as columns: key, value, until, taken. All of them take their rows of a batch at once, as a call for each key costs far more than its rows."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("values", "held binary, timer bigint")

    def _held(self) -> tuple[pd.DataFrame | None, int | None]:
        if not self.state.exists():
            return None, None
        held, timer = self.state.get()
        return pa.ipc.open_stream(bytes(held)).read_pandas(), timer

    def _keep(self, held: pd.DataFrame, timer: int | None) -> None:
        """Holds these values, with a timer at the first end of them in place of the one that is there."""
        due = int(_due(held["until"].to_numpy()).min())
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        table, sink = pa.Table.from_pandas(held, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self.state.update((sink.getvalue().to_pybytes(), due))

    def _rows(self, key, at: np.ndarray, number, action, outcome, value) -> pd.DataFrame:
        at = pd.Series(np.where(at == NEVER, np.iinfo("int64").min, at).view("datetime64[us]")).dt.tz_localize("UTC")
        return pd.DataFrame({self.key: key, "at": at, "number": number, "action": action, "outcome": outcome, "value": value})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, timer = self._held()
        new = pd.concat(list(rows), ignore_index=True)
        n = 0 if held is None else len(held)
        front = lambda x, name: np.concatenate([x, new[name].to_numpy()])
        keys = new[self.key] if not n else pd.concat([held[self.key], new[self.key]], ignore_index=True)
        # What is held stands before a key's rows, as one that put it.
        at, none, number = front(np.full(n, np.iinfo("int64").min), "sl_at"), front(np.zeros(n, bool), "sl_none"), front(np.zeros(n, "int64"), "sl_number")
        codes = pd.factorize(keys, use_na_sentinel=False)[0]
        order = np.lexsort((number, none, at, codes))
        codes, at, none, number, own = codes[order], at[order], none[order], number[order], order >= n
        action, value = front(np.full(n, "put", object), "sl_action")[order], front(held["value"].to_numpy() if n else np.empty(0, object), "sl_value")[order]
        ends, put = np.minimum(new["sl_at"], NEVER - np.maximum(new["sl_ttl"], 0)) + new["sl_ttl"], action == "put"
        until = np.concatenate([held["until"].to_numpy() if n else np.empty(0, "int64"), ends.to_numpy()])[order]
        was = np.concatenate([held["taken"].to_numpy(bool) if n else np.empty(0, bool), np.zeros(len(new), bool)])[order]
        first = np.r_[True, codes[1:] != codes[:-1]]
        place = np.arange(len(codes))
        last = np.maximum.accumulate(np.where(put, place, -1))  # the place of the put that holds
        known = last >= np.maximum.accumulate(np.where(first, place, 0))
        expired = (at != NEVER) & (at >= until[last])
        takes = np.cumsum(took := (action == "take") & known & ~expired)
        taken = was[last] | (takes - took > takes[last])
        outcome = np.select([put, ~known, expired, taken], ["stored", "unknown", "expired", "taken"], "found").astype(object)
        seen = np.where(put | (outcome == "found"), value[last], None)
        end = np.r_[first[1:], True] & known
        holds, keys = last[end], keys.iloc[order]
        if len(holds):
            self._keep(pd.DataFrame({self.key: keys[end].reset_index(drop=True), "value": value[holds], "until": until[holds], "taken": was[holds] | (takes[end] > takes[holds])}), timer)
        yield self._rows(keys[own].reset_index(drop=True), at[own], pd.arrays.IntegerArray(number[own], none[own]), action[own], outcome[own], seen[own])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, _ = self._held()
        over = _due(held["until"].to_numpy()) < max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1)
        if over.all():
            self.state.clear()
        else:
            self._keep(held[~over].reset_index(drop=True), None)  # the timer that fired goes by itself
        gone = held[over].reset_index(drop=True)
        none = pd.array([None] * len(gone), "Int64")
        yield self._rows(gone[self.key], gone["until"].to_numpy(), none, "timer", "dropped", gone["value"].where(~gone["taken"].astype(bool), None))

    def close(self) -> None:
        pass


def expiring(stream: DataFrame, key: str, time: str, number: str, action: str, value: str, ttl_seconds: str, late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """(key, at, number, action, outcome, value): a store of values that expire, as state: single-use tokens, cached answers, evidence.

    Actions by key, in the order of time and number: `put` stores a value for ttl seconds in place of what is there; `get` finds it while it lasts (`found`,
    else `unknown` or `expired`); `take` finds it once, after which it is `taken`: batches take a key's rows in turn, so that no two
    can have it. When the watermark passes a value's end a timer drops its state and says so, in a row of the action `timer` with the value unless it was taken; later
    actions find it `unknown`. Rows later than the watermark by `late` are left out. Start the query within state_tables().

    State is a table of the keys that hold a value for each of `buckets` groups of keys. A batch reads and writes the tables of the groups that it touches, a task one
    at a time: take more groups for very many keys. The number belongs to the checkpoint. Keys are of a type that isn't nested.
    """
    kind = dict(stream.dtypes)[key]
    if kind.startswith(("struct", "array", "map")):
        raise ValueError("keys of nested types can't be told apart here")
    at = F.col(time).cast("timestamp")
    # Keys that are null have a group of their own: a column with nulls comes as floats, which don't hold every number.
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int")
    n = F.col(number).cast("bigint")
    rows = stream.withColumn("sl_time", at).withWatermark("sl_time", late).select(
        "sl_time", key, bucket.alias("sl_bucket"), F.coalesce(F.unix_micros("sl_time"), F.lit(NEVER)).alias("sl_at"), F.coalesce(n, F.lit(0)).alias("sl_number"), n.isNull().alias("sl_none"), F.col(action).alias("sl_action"),
        F.col(value).cast("string").alias("sl_value"), (F.coalesce(F.col(ttl_seconds), F.lit(0)) * 1_000_000).cast("bigint").alias("sl_ttl"),
    )
    out = f"{key} {kind}, at timestamp, number bigint, action string, outcome string, value string"
    return rows.groupBy("sl_bucket").transformWithStateInPandas(_Expiring(key), out, "Append", "EventTime")


def run(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over all that is there, appending its rows as Parquet; again with the same checkpoint, it goes on where it stopped."""
    with state_tables(stream.sparkSession):
        q = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
