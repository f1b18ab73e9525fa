"""Keyed stateful processors for live streams.

One key is one live stream, whose rate is that of speech; a trigger holds as much of it
as the source admits (``maxFilesPerTrigger``).  Backfills of any size use the batch forms,
which give the same rows.  Rows are taken in clock order inside a trigger; rows that arrive
behind the watermark are dropped by the engine.  State is typed: one value per key, and lists
and maps whose entries go when no rule can ask for them any more.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

import segflow
from segflow.functions.signals import FRAME_S
from segflow.functions.text import OVERLAP_WORDS
from segflow.operators import captions
from segflow.operators.lines import DECODE_LAG_S, PRE_ROLL_CHUNKS, RULE1_S, RULE2_S, RULE3_S, SETTLE_S
from segflow.session import STATE_STORE

UPDATE, FORCE, FLUSH = "update", "force", "flush"
#: event time of clock 0, only used to place clocks on the watermark's axis
ORIGIN = "2024-01-01 00:00:00"


def clock_ms(at_us: float) -> int:
    return int(pd.Timestamp(ORIGIN).value // 1_000_000) + math.ceil(at_us / 1000)


def with_event_time(df: DataFrame, clock_us, lateness: str = "10 seconds") -> DataFrame:
    """Event time from a microsecond clock, with a watermark."""
    base = F.unix_micros(F.lit(ORIGIN).cast("timestamp"))
    return df.withColumn("event_time", F.timestamp_micros(base + clock_us)).withWatermark("event_time", lateness)


def stateful(df: DataFrame, key: str, processor: StatefulProcessor, schema: str, event_time: str = "") -> DataFrame:
    """``event_time`` names the output column that a stateful step after this one takes its watermark from."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    # the runner that prepares a stateful query does not see files added to the session,
    # so the processor travels with its code
    cloudpickle.register_pickle_by_value(segflow)
    try:
        return df.groupBy(key).transformWithStateInPandas(processor, schema, "append", "eventTime", eventTimeColumnName=event_time)
    finally:
        cloudpickle.unregister_pickle_by_value(segflow)


def in_order(batches: Iterator[pd.DataFrame], order: Sequence[str]) -> pd.DataFrame:
    """The rows of a key in a trigger, by ``order``."""
    frames = list(batches)
    frame = frames[0] if len(frames) == 1 else pd.concat(frames)
    if len(frame) < 2:
        return frame
    return frame.iloc[np.lexsort([frame[c].to_numpy() for c in reversed(order)])]


def _listed(column: pd.Series) -> list:
    """Values of a column with None where there is none."""
    values = column.tolist()
    return [None if v is None or v is pd.NaT or v != v else v for v in values] if column.hasnans else values


class _Processor(StatefulProcessor):
    """Typed state of one row per key (``fields`` and their types); rows of a trigger in the order of ``order``."""

    order: list[str] = []
    fields: dict[str, str] = {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("state", ", ".join(f"{n} {t}" for n, t in self.fields.items()))

    def fresh(self) -> dict:
        """State of a key that was not seen before."""
        raise NotImplementedError

    def load(self) -> dict:
        row = self.value.get()
        return self.fresh() if row is None else dict(zip(self.fields, row))

    def save(self, state: dict) -> None:
        self.value.update(tuple(state[n] for n in self.fields))

    def rows(self, batches: Iterator[pd.DataFrame], columns: Sequence[str]) -> Iterator[tuple]:
        frame = in_order(batches, self.order)
        return zip(*(_listed(frame[c]) for c in columns))

    def out(self, key, rows: list[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
        if rows:
            frame = pd.DataFrame(rows, columns=columns[1:])
            frame.insert(0, columns[0], key[0])
            yield frame

    def retime(self, state: dict, at_ms: int | None) -> None:
        """One timer per key, kept in ``state["timer"]``."""
        if at_ms == state["timer"]:
            return
        if state["timer"] is not None:
            self.handle.deleteTimer(state["timer"])
        if at_ms is not None:
            self.handle.registerTimer(at_ms)
        state["timer"] = at_ms

    def close(self) -> None:
        pass


# -- line endpointing ------------------------------------------------------------------


class LineProcessor(_Processor):
    """Closes lines by silence, length, a forced cut or the end of the stream.

    The timer closes a line whose silence has grown long enough without a next update.
    """

    order = ["at_us", "event_id"]
    columns = ["stream_id", "line", "start", "end", "updates"]
    schema = "stream_id bigint, line bigint, start bigint, end bigint, updates bigint"
    fields = {"line": "bigint", "open": "boolean", "begun": "bigint", "latest": "bigint", "spoken": "boolean", "updates": "bigint", "timer": "bigint"}

    def __init__(self, rule1_us: int, rule2_us: int, rule3_us: int):
        self.rule1, self.rule2, self.rule3 = rule1_us, rule2_us, rule3_us

    def fresh(self) -> dict:
        return {"line": 0, "open": False, "begun": 0, "latest": 0, "spoken": False, "updates": 0, "timer": None}

    def _closed(self, s: dict) -> tuple:
        s["open"] = False
        return s["line"], s["begun"], s["latest"], s["updates"]

    def _due(self, s: dict) -> int | None:
        return clock_ms(s["latest"] + (self.rule2 if s["spoken"] else self.rule1)) if s["open"] else None

    def handleInputRows(self, key, rows, timerValues):
        s, out = self.load(), []
        for t, spoken, kind in self.rows(rows, ["at_us", "spoken", "kind"]):
            if kind != UPDATE:
                if s["open"]:
                    out.append(self._closed(s))
                continue
            if s["open"]:
                silence = t - s["latest"]
                if silence >= self.rule1 or (s["spoken"] and silence >= self.rule2) or t - s["begun"] >= self.rule3:
                    out.append(self._closed(s))
            if not s["open"]:
                s.update(line=s["line"] + 1, open=True, begun=t, latest=t, spoken=False, updates=0)
            s["latest"] = max(s["latest"], t)
            s["spoken"] = s["spoken"] or bool(spoken)
            s["updates"] += 1
        self.retime(s, self._due(s))
        self.save(s)
        yield from self.out(key, out, self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        s, out = self.load(), []
        s["timer"] = None
        if s["open"] and expiredTimerInfo.getExpiryTimeInMs() >= self._due(s):
            out.append(self._closed(s))
        self.save(s)
        yield from self.out(key, out, self.columns)


def stream_lines(
    updates: DataFrame, rule1_us: int = int(RULE1_S * 1e6), rule2_us: int = int(RULE2_S * 1e6), rule3_us: int = int(RULE3_S * 1e6), lateness: str = "10 seconds"
) -> DataFrame:
    """``updates``: stream_id, event_id, at_us, spoken, kind (update, force or flush)."""
    timed = with_event_time(updates, F.col("at_us"), lateness)
    return stateful(timed, "stream_id", LineProcessor(rule1_us, rule2_us, rule3_us), LineProcessor.schema)


# -- gating ------------------------------------------------------------------------------


class GateProcessor(_Processor):
    """Holds back quiet chunks, replays the last few when speech starts, and counts resets.

    The held chunks are a list that never has more than ``pre_roll`` entries. Columns of ``carry`` travel with a chunk;
    with them the time at which a chunk was let through is handed on, as a replayed chunk may be older than the watermark.
    """

    order = ["frame"]
    fields = {"quiet": "bigint", "clock": "bigint", "session": "bigint", "was": "boolean"}

    def __init__(self, pre_roll: int, reset_gap: int, carry: Sequence[tuple[str, str]] = ()):
        self.pre_roll, self.reset_gap, self.carry = pre_roll, reset_gap, [n for n, _ in carry]
        more = "".join(f", {n} {t}" for n, t in carry)
        self.held = "frame bigint, ms bigint" + more
        self.schema = "stream_id bigint, frame bigint, audio_clock bigint, session bigint" + more + (", event_time timestamp" if carry else "")
        self.columns = ["stream_id", "frame", "audio_clock", "session", *self.carry, *(["event_time"] if carry else [])]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getListState("held", self.held)

    def fresh(self) -> dict:
        return {"quiet": 0, "clock": 0, "session": 0, "was": False}

    def handleInputRows(self, key, rows, timerValues):
        s, out = self.load(), []
        before = held = [] if s["was"] else list(self.kept.get())
        for frame, ms, active, when, *more in self.rows(rows, ["frame", "ms", "active", "event_time", *self.carry]):
            if active:
                if not s["was"]:
                    if s["quiet"] - sum(h[1] for h in held) >= self.reset_gap:
                        s["session"] += 1
                    s["quiet"] = 0
                for f, m, *rest in [*held, (frame, ms, *more)]:
                    s["clock"] += m
                    out.append((f, s["clock"], s["session"], *rest, *([when] if self.carry else [])))
                held = []
            else:
                held = [*held, (frame, ms, *more)][-self.pre_roll :] if self.pre_roll else []
                s["quiet"] += ms
            s["was"] = bool(active)
        if held is not before:
            plain = [tuple(v.tolist() if isinstance(v, np.ndarray) else v for v in h) for h in held]
            self.kept.put(plain) if plain else self.kept.clear()
        self.save(s)
        yield from self.out(key, out, self.columns)


def stream_gate(
    chunks: DataFrame, pre_roll: int = PRE_ROLL_CHUNKS, reset_gap_ms: int = 1500, lateness: str = "10 seconds", carry: Sequence[str] = ()
) -> DataFrame:
    """``chunks``: stream_id, frame, at_us, ms, active.  Needs rows of a stream in frame order across triggers.

    With ``carry`` the named columns and the event time are handed on, for a stateful step after the gate.
    """
    timed = with_event_time(chunks, F.col("at_us"), lateness)
    kinds = [(c, chunks.schema[c].dataType.simpleString()) for c in carry]
    processor = GateProcessor(pre_roll, reset_gap_ms, kinds)
    return stateful(timed, "stream_id", processor, processor.schema, "event_time" if carry else "")


# -- caption lines ------------------------------------------------------------------------


class CaptionProcessor(_Processor):
    """Lines of the open utterance of each stream; a timer applies changes that fall due in silence.

    The history of word counts is a list, stamped when the count changes and trimmed to what a change can still ask for
    (``decode_lag`` + ``settle`` + ``look_back`` seconds and one older stamp); waiting changes are a map that loses an
    entry when it is applied. So state does not grow with an utterance but for the words of its open line.
    """

    order = ["clock_s", "kind", "seq", "change_s"]
    columns = ["stream_id", "emitted_s", "text", "start_s", "duration_s", "confidence", "cause", "change_s", "late_changes", "late_since"]
    schema = (
        "stream_id bigint, emitted_s double, text string, start_s double, duration_s double, "
        "confidence double, cause string, change_s double, late_changes bigint, late_since bigint"
    )
    fields = {
        "memory": "array<string>", "words": "array<string>", "known": "int", "shown": "int", "start": "double",
        "clock": "double", "confidence": "double", "late": "bigint", "told": "bigint", "timer": "bigint",
    }

    def __init__(self, decode_lag: float, settle: float, look_back: float = 3.0):
        self.decode_lag, self.settle, self.look_back = decode_lag, settle, look_back

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.stamps = handle.getListState("stamps", "clock_s double, known int")
        self.waiting = handle.getMapState("waiting", "change_s double, seen_s double", "times int")

    def fresh(self) -> dict:
        return {"memory": [], "words": [], "known": 0, "shown": 0, "start": 0.0, "clock": None, "confidence": None, "late": 0, "told": 0, "timer": None}

    def _due(self, mark: tuple) -> float:
        return max(mark[1], mark[0] + (self.decode_lag + self.settle))

    def _resolved(self, s: dict, stamps: list, waiting: dict, final: bool) -> list[tuple]:
        """Lines of the changes that are due at the clock of the state, in the order of their times."""
        out = []
        for mark in sorted(m for m in waiting if final or s["clock"] >= self._due(m)):
            for _ in range(waiting.pop(mark)):
                if mark[0] <= s["start"]:
                    s["late"] += 1
                    continue
                at = bisect.bisect_right(stamps, mark[0] + self.decode_lag, key=lambda e: e[0])
                cut = min(stamps[at - 1][1] if at else 0, s["known"])
                if cut > s["shown"]:
                    out.append(self._line(s, cut, "change", mark[0]))
                    s.update(words=s["words"][cut - s["shown"] :], shown=cut, start=mark[0])
        return out

    def _line(self, s: dict, cut: int, cause: str, change: float | None) -> tuple:
        text = " ".join(s["words"][: cut - s["shown"]])
        end = s["clock"] if change is None else change
        since, s["told"] = s["late"] - s["told"], s["late"]
        return s["clock"], text, s["start"], max(end - s["start"], 0.0), s["confidence"], cause, change, s["late"], since

    def _kept(self, stamps: list, clock: float) -> list:
        """History without the stamps that are older than the newest at or before the cutoff."""
        cutoff = clock - (self.decode_lag + self.settle + self.look_back)
        return stamps[max(bisect.bisect_right(stamps, cutoff, key=lambda e: e[0]) - 1, 0) :]

    def handleInputRows(self, key, rows, timerValues):
        s, out = self.load(), []
        stamps, waiting = list(self.stamps.get()), {tuple(k): v[0] for k, v in self.waiting.iterator()}
        before = (list(stamps), dict(waiting))
        for clock, kind, change, partial, final, confidence in self.rows(rows, ["clock_s", "kind", "change_s", "partial", "final", "confidence"]):
            if kind == captions.CHANGE:
                waiting[change, clock] = waiting.get((change, clock), 0) + 1
                continue
            ended = final is not None
            raw = ((final if ended else partial) or "").split()
            fresh = raw[captions.replayed(s["memory"], raw) :]
            if not ended and len(fresh) != s["known"]:
                stamps = self._kept([*stamps, (clock, len(fresh))], clock)
            s.update(clock=clock, confidence=confidence, known=len(fresh), words=fresh[s["shown"] :])
            out += self._resolved(s, stamps, waiting, ended)
            if ended:
                if s["known"] > s["shown"]:
                    out.append(self._line(s, s["known"], "final", None))
                s.update(memory=raw[-OVERLAP_WORDS:], words=[], known=0, shown=0, start=clock)
                stamps = []
        self._store(s, stamps, waiting, before)
        yield from self.out(key, out, self.columns)

    def _store(self, s: dict, stamps: list, waiting: dict, before: tuple) -> None:
        """Write what changed, and wait for the first change that falls due after the latest update."""
        if stamps != before[0]:
            same = len(before[0])
            if stamps[:same] == before[0]:
                self.stamps.appendList(stamps[same:])
            elif stamps:
                self.stamps.put(stamps)
            else:
                self.stamps.clear()
        for mark in before[1].keys() - waiting.keys():
            self.waiting.removeKey(mark)
        for mark, times in waiting.items():
            if before[1].get(mark) != times:
                self.waiting.updateValue(mark, (times,))
        due = [t for t in map(self._due, waiting) if s["clock"] is not None and t > s["clock"]]
        self.retime(s, clock_ms(min(due) * 1e6) if due else None)
        self.save(s)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        s = self.load()
        s["timer"] = None
        stamps, waiting = list(self.stamps.get()), {tuple(k): v[0] for k, v in self.waiting.iterator()}
        before = (list(stamps), dict(waiting))
        # silence: the last words stand as an update at this time
        s["clock"] = max((expiredTimerInfo.getExpiryTimeInMs() - clock_ms(0)) / 1000.0, s["clock"])
        out = self._resolved(s, stamps, waiting, False)
        self._store(s, stamps, waiting, before)
        yield from self.out(key, out, self.columns)


def stream_captions(
    updates: DataFrame, changes: DataFrame, decode_lag: float = DECODE_LAG_S, settle: float = SETTLE_S, lateness: str = "10 seconds"
) -> DataFrame:
    """Lines of live streams from recogniser updates and detected changes (columns as in the batch form)."""
    return stream_caption_rows(caption_input(updates, changes), decode_lag, settle, lateness)


def caption_input(updates: DataFrame, changes: DataFrame) -> DataFrame:
    """Both inputs as rows of one shape."""
    return captions.merged(updates, changes, "stream_id", partial=F.col("partial"), final=F.col("final"))


def stream_caption_rows(rows: DataFrame, decode_lag: float = DECODE_LAG_S, settle: float = SETTLE_S, lateness: str = "10 seconds") -> DataFrame:
    """The same from rows of ``caption_input``. A change may be detected up to three seconds after its words settled.

    ``late_changes`` counts the stream's late changes so far, ``late_since`` those since its line before.
    """
    rows = with_event_time(rows, (F.col("clock_s") * 1e6).cast("long"), lateness)
    return stateful(rows, "stream_id", CaptionProcessor(decode_lag, settle), CaptionProcessor.schema)


def session_observed(lines: DataFrame, name: str = "session") -> DataFrame:
    """``lines`` of a caption stream, with its counters in the progress of the query: lines, splits and late changes."""
    split = (F.col("cause") == "change").cast("long")
    return lines.observe(name, F.count(F.lit(1)).alias("lines"), F.sum(split).alias("splits"), F.sum("late_since").alias("late_changes"))


# -- partial texts ------------------------------------------------------------------------


def unseen(text: str, committed: str) -> str | None:
    """The part of a partial text after the committed one; None when it does not begin with that."""
    return text.removeprefix(committed).lstrip() if text.startswith(committed) else None


class PartialProcessor(_Processor):
    """Redraw limit for partial texts, without the part that is committed already.

    A commit clears what is on screen, so the same words after it are drawn again.
    """

    order = ["at_us", "event_id"]
    schema = "stream_id bigint, at_us bigint, text string"
    fields = {"drawn": "string", "next": "bigint", "committed": "string"}

    def __init__(self, interval_us: int):
        self.interval = interval_us

    def fresh(self) -> dict:
        return {"drawn": "", "next": None, "committed": ""}

    def handleInputRows(self, key, rows, timerValues):
        state, out = self.load(), []
        for at, text, promote in self.rows(rows, ["at_us", "text", "promote"]):
            left = unseen(text or "", state["committed"])
            if left is None:
                left, state["committed"] = text or "", ""
            if left != state["drawn"] and (state["next"] is None or at >= state["next"]):
                state.update(drawn=left, next=at + self.interval)
                out.append((at, left))
            if promote:
                state.update(committed=" ".join(filter(None, [state["committed"], promote])), drawn="")
        self.save(state)
        yield from self.out(key, out, ["stream_id", "at_us", "text"])


def stream_partials(partials: DataFrame, interval_us: int = 250_000, lateness: str = "10 seconds") -> DataFrame:
    """``partials``: stream_id, event_id, at_us, text, promote (text committed with this row, or NULL)."""
    timed = with_event_time(partials, F.col("at_us"), lateness)
    return stateful(timed, "stream_id", PartialProcessor(interval_us), PartialProcessor.schema)


# -- detection ----------------------------------------------------------------------------


def due_windows(totals: np.ndarray, first: int, hop: int, newest: int) -> np.ndarray:
    """End positions ``first + k * hop`` that the totals reach, of each step of the totals only the newest ones."""
    ends = np.arange(first, totals[-1] + 1, hop) if len(totals) else np.zeros(0, np.int64)
    step = np.searchsorted(totals, ends)
    behind = np.searchsorted(step, step, "right") - np.arange(len(step))
    return ends[behind <= newest]


def peak_frames(scores: np.ndarray, k: int, threshold: float, left: int, right: int, radius: int):
    """(window, frame, value) of smoothed scores that are the greatest within ``radius`` frames, inside the margins."""
    view = np.lib.stride_tricks.sliding_window_view
    if k > 1:
        scores = view(np.pad(scores, ((0, 0), (k // 2, k // 2)), mode="edge"), k, axis=1).mean(axis=-1)
    n = scores.shape[1]
    low, high = max(left, radius), min(n - right, n - radius)
    if high <= low:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    inner = scores[:, low:high]
    most = view(scores, 2 * radius + 1, axis=1).max(axis=-1)[:, low - radius : high - radius]
    window, frame = np.nonzero((inner >= threshold) & (inner >= most))
    return window, frame + low, inner[window, frame]


class DetectProcessor(_Processor):
    """Live change detection: scores the windows that fall due and keeps peaks a gap apart.

    Positions count admitted samples and never restart; a new session begins with empty audio. State is the audio of
    one window as bytes, and four numbers.
    """

    schema = "stream_id bigint, time_s double, prob double, detected_at_s double"
    fields = {"audio": "binary", "total": "bigint", "next": "bigint", "last": "double", "session": "bigint"}

    def __init__(self, scorer: Callable[[], Callable], rate: int, window: int, hop: int, threshold: float, k: int, left: int, right: int, radius: int, gap_s: float, frame_s: float, catch_up: int, order: Sequence[str] = ("at_us", "seq")):
        self.order = list(order)
        self.scorer, self.rate, self.window, self.hop = scorer, rate, window, hop
        self.peaks = dict(k=k, threshold=threshold, left=left, right=right, radius=radius)
        self.gap_s, self.frame_s, self.catch_up = gap_s, frame_s, catch_up

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.score = self.scorer()

    def fresh(self) -> dict:
        return {"audio": b"", "total": 0, "next": self.window, "last": None, "session": 0}

    def handleInputRows(self, key, rows, timerValues):
        state, frame, out = self.load(), in_order(rows, self.order), []
        sessions = frame["session"].to_numpy()
        edges = [0, *(np.flatnonzero(sessions[1:] != sessions[:-1]) + 1).tolist(), len(frame)]
        for low, high in zip(edges, edges[1:]):
            number = int(sessions[low])
            if number != state["session"]:
                state.update(audio=b"", next=state["total"] + self.window, session=number)
            held = np.frombuffer(bytes(state["audio"]))
            parts = [np.asarray(v, dtype=np.float64) for v in frame["samples"].iloc[low:high]]
            audio = np.concatenate([held, *parts])
            begin = state["total"] - len(held)
            totals = state["total"] + np.cumsum([len(p) for p in parts])
            ends = due_windows(totals, state["next"], self.hop, self.catch_up)
            if totals[-1] >= state["next"]:
                state["next"] += self.hop * (1 + (int(totals[-1]) - state["next"]) // self.hop)
            if len(ends):
                windows = np.lib.stride_tricks.sliding_window_view(audio, self.window)[ends - self.window - begin]
                at, place, value = peak_frames(np.asarray(self.score(windows), dtype=np.float64), **self.peaks)
                times = (ends[at] - self.window) / self.rate + place * self.frame_s
                for t, p, e in zip(times.tolist(), value.tolist(), ends[at].tolist()):
                    if state["last"] is None or abs(t - state["last"]) >= self.gap_s:
                        state["last"] = t
                        out.append((t, p, e / self.rate))
            state.update(total=int(totals[-1]), audio=audio[-self.window :].tobytes())
        self.save(state)
        yield from self.out(key, out, ["stream_id", "time_s", "prob", "detected_at_s"])


def _detector(
    scorer: Callable[[], Callable],
    rate: int = 16000,
    window_s: float = 3.0,
    hop_s: float = 0.25,
    threshold: float = 0.5,
    k: int = 5,
    left_s: float = 0.5,
    right_s: float = 1.0,
    radius_s: float = 0.1,
    gap_s: float = 1.0,
    frame_s: float = FRAME_S,
    catch_up: int = 8,
    order: Sequence[str] = ("at_us", "seq"),
) -> DetectProcessor:
    if int(hop_s * rate) < 1:
        raise ValueError("a hop must be a sample or more")
    if left_s + right_s >= window_s:
        raise ValueError("the margins leave nothing of the window")
    frames = lambda seconds: int(seconds / frame_s)
    return DetectProcessor(
        scorer, rate, int(window_s * rate), int(hop_s * rate), threshold, k, frames(left_s), frames(right_s), max(1, frames(radius_s)), gap_s, frame_s, catch_up, order
    )


def stream_changes(chunks: DataFrame, scorer: Callable[[], Callable], *settings, lateness: str = "10 seconds", **named) -> DataFrame:
    """``chunks``: stream_id, seq, at_us, session, samples (gated audio); settings as in ``_detector``."""
    processor = _detector(scorer, *settings, **named)
    timed = with_event_time(chunks, F.col("at_us"), lateness)
    return stateful(timed, "stream_id", processor, DetectProcessor.schema)


def stream_live_changes(
    chunks: DataFrame, scorer: Callable[[], Callable], *settings, pre_roll: int = PRE_ROLL_CHUNKS, reset_gap_ms: int = 1500, lateness: str = "10 seconds", **named
) -> DataFrame:
    """Raw chunks in, detected changes out: the gate and the detector are two stateful steps of one query.

    ``chunks``: stream_id, frame, at_us, ms, active, samples. The gate hands on event time, so the detector's watermark
    follows the gate's; it takes the admitted chunks by the gate's audio clock.
    """
    gated = stream_gate(chunks, pre_roll, reset_gap_ms, lateness, carry=["samples"])
    processor = _detector(scorer, *settings, order=["audio_clock"], **named)
    return stateful(gated, "stream_id", processor, DetectProcessor.schema)
