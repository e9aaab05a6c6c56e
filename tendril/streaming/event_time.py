"""Keyed state in event-time order: rows wait until the watermark has passed them, however micro-batches shuffle them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import pressure

#: Part of every state variable's name: a checkpoint of another version is not read as this one.
VERSION = "v2"


#: pandas turns whole numbers and booleans beside NULLs into floats and objects.
_KINDS = {"long": int, "int": int, "double": float, "boolean": bool, "string": str}


def _plain(v, kind: str):
    return None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else _KINDS[kind](v)


class InOrder(StatefulProcessor):
    """Rows (us, ...) of a key in the order of us (and what follows it), each given to ``take`` when none before it can come.

    A row's timer, or that of ``wake``, fires at the watermark; ``quiet`` then sees what silence alone decides. Rows
    behind the watermark don't come here: Spark drops them.
    """

    shape: str
    names: tuple[str, ...]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState(f"waiting_{VERSION}", self.shape)
        self.begin(handle)

    def begin(self, handle: StatefulProcessorHandle) -> None:
        """Declares the state."""

    def take(self, row: tuple) -> Iterator[tuple]:
        raise NotImplementedError

    def quiet(self, us: int) -> Iterator[tuple]:
        """What follows from no row up to us being left."""
        return iter(())

    def wake(self) -> list[int]:
        """Times (us) at which ``quiet`` has to look."""
        return []

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        columns, kinds = zip(*(x.split() for x in self.shape.split(", ")), strict=True)
        for part in rows:
            new = [tuple(map(_plain, r, kinds)) for r in part[list(columns)].itertuples(index=False, name=None)]
            if new:
                self.waiting.appendList(new)
                for ms in {-(-r[0] // 1000) for r in new}:
                    self.handle.registerTimer(ms)
        yield pd.DataFrame(columns=[*self.keys, *self.names])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in rows if r[0] <= now), key=lambda r: [(v is not None, v) for v in r])
        rest = [r for r in rows if r[0] > now]
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        out = [x for r in due for x in self.take(r)]
        out += self.quiet(now)
        for us in self.wake():
            if us > now:
                self.handle.registerTimer(-(-us // 1000))
        yield pd.DataFrame([(*key, *x) for x in out], columns=[*self.keys, *self.names])

    def close(self) -> None:
        pass

    def __init__(self, *keys: str):
        self.keys = keys


class Latch(InOrder):
    """Fires at ``fire`` or more and stays silent until a value below ``rearm``."""

    shape, names = "us long, value double", ("us", "value")

    def __init__(self, keys, fire: float, rearm: float):
        super().__init__(*keys)
        self.fire, self.rearm = fire, rearm

    def begin(self, handle):
        self.on = handle.getValueState(f"on_{VERSION}", "on boolean")

    def take(self, row):
        on = self.on.exists() and self.on.get()[0]
        if row[1] is not None and row[1] >= self.fire and not on:
            self.on.update((True,))
            yield row
        elif row[1] is not None and row[1] < self.rearm and on:
            self.on.update((False,))


class Debt(InOrder):
    """Blocking time of each identity; a bucket is given out, and forgotten, when its identity has been idle for too long."""

    shape, names = "us long, identity string", ("identity", "debt_s", "polls", "first_us", "last_us")

    def __init__(self, keys, idle_s: int):
        super().__init__(*keys)
        self.idle = idle_s * 1_000_000

    def begin(self, handle):
        self.polls = handle.getValueState(f"polls_{VERSION}", "prev long, cur long")
        self.buckets = handle.getMapState(f"buckets_{VERSION}", "identity string", "debt_s long, polls long, first_us long, last_us long")

    def take(self, row):
        us, who = row
        prev, cur = self.polls.get() if self.polls.exists() else (None, None)
        if us != cur:
            prev, cur = cur, us
            self.polls.update((prev, cur))
        if who is None:
            return
        if not self.buckets.containsKey((who,)):
            self.buckets.updateValue((who,), (0, 1, us, us))
            return
        debt, n, first, last = self.buckets.getValue((who,))
        if us == last:
            return
        gap = us // 1_000_000 - last // 1_000_000
        if gap * 1_000_000 > self.idle:
            yield (who, debt, n, first, last)
            self.buckets.updateValue((who,), (0, 1, us, us))
        else:
            self.buckets.updateValue((who,), (debt + (gap if last == prev else 0), n + 1, first, us))

    def quiet(self, us):
        gone = [(k[0], *v) for k, v in self.buckets.iterator() if v[3] + self.idle + 1_000_000 <= us] if self.buckets.exists() else []
        for x in gone:
            self.buckets.removeKey((x[0],))
            yield x

    def wake(self):
        return [v[3] + self.idle + 1_000_000 for v in self.buckets.values()] if self.buckets.exists() else []


class RuleDebt(InOrder):
    """Seconds of each rule: a gap counts inside one blocker's episode; a poll that no rule matches moves on."""

    shape, names = "us long, blocker_spid long, rule long", ("rule", "debt_s", "polls")

    def __init__(self, keys, idle_s: int):
        super().__init__(*keys)
        self.idle = idle_s * 1_000_000

    def begin(self, handle):
        self.last = handle.getValueState(f"last_{VERSION}", "us long, blocker_spid long")
        self.buckets = handle.getMapState(f"rules_{VERSION}", "rule long", "debt_s long, polls long, last_us long")

    def take(self, row):
        us, blocker, rule = row
        at, was = self.last.get() if self.last.exists() else (None, None)
        gap = us // 1_000_000 - at // 1_000_000 if blocker is not None and was == blocker else 0
        self.last.update((us, blocker))
        if rule is None:
            return
        debt, n, last = self.buckets.getValue((rule,)) if self.buckets.containsKey((rule,)) else (0, 0, us)
        if (us // 1_000_000 - last // 1_000_000) * 1_000_000 > self.idle:
            yield (rule, debt, n)
            debt, n = 0, 0
        self.buckets.updateValue((rule,), (debt + gap, n + 1, us))

    def quiet(self, us):
        gone = [(k[0], *v[:2]) for k, v in self.buckets.iterator() if v[2] + self.idle + 1_000_000 <= us] if self.buckets.exists() else []
        for x in gone:
            self.buckets.removeKey((x[0],))
            yield x

    def wake(self):
        return [v[2] + self.idle + 1_000_000 for v in self.buckets.values()] if self.buckets.exists() else []


class Relief(InOrder):
    """Open pauses of a key, closed by a sample without pressure, by a log that doesn't drain, or by silence."""

    shape, names = "us long, side int, blocked boolean, log_over boolean", ("pause_us", "ended", "relief_us")

    def __init__(self, keys, drain_s: int, blind_s: int):
        super().__init__(*keys)
        self.drain, self.blind = drain_s * 1_000_000, blind_s * 1_000_000

    def begin(self, handle):
        self.open = handle.getListState(f"open_{VERSION}", "pause_us long, seen boolean, drained boolean")

    def _rows(self):
        return [tuple(x) for x in self.open.get()] if self.open.exists() else []

    def _keep(self, rows):
        self.open.put(rows) if rows else self.open.clear()

    def take(self, row):
        us, side, blocked, over = row
        yield from self.quiet(us, whole=side == 0)
        left = self._rows()
        if side == 0:
            self._keep(left + ([] if any(x[0] == us for x in left) else [(us, False, False)]))
            return
        kept = []
        for at, seen, drained in left:
            if at == us:  # only a later sample counts
                kept.append((at, seen, drained))
            elif not blocked and not over:
                yield (at, "relief", us)
            else:
                kept.append((at, True, drained or not over))
        self._keep(kept)

    def quiet(self, us, whole=True):
        """whole: no sample is at hand. A wait of just drain_s is not over, one of just blind_s is."""
        kept = []
        for at, seen, drained in self._rows():
            second = us // 1_000_000 - at // 1_000_000
            if self.blind and not seen and second * 1_000_000 >= self.blind:
                yield (at, "blind", None)
            elif self.drain and (seen or not whole) and not drained and second * 1_000_000 > self.drain:
                yield (at, "drain", None)
            else:
                kept.append((at, seen, drained))
        self._keep(kept)

    def wake(self):
        return [at + d + 1_000_000 for at, seen, drained in self._rows() for d in ([self.blind] if self.blind and not seen else [self.drain] if self.drain and not drained else [])]


class Latest(InOrder):
    """A row for each row of the sides asked for, with the last value of each column that isn't null, up to and with it."""

    def __init__(self, keys, values: dict[str, str], sides: tuple[int, ...]):
        super().__init__(*keys)
        self.types, self.sides = values, sides
        self.shape = ", ".join(["us long", "side int", *(f"{c} {t}" for c, t in values.items())])
        self.names = ("us", *values)

    def begin(self, handle):
        self.last = handle.getValueState(f"last_{VERSION}", ", ".join(f"{c} {t}" for c, t in self.types.items()))

    def take(self, row):
        old = self.last.get() if self.last.exists() else [None] * len(self.types)
        now = tuple(o if n is None else n for o, n in zip(old, row[2:], strict=True))
        self.last.update(now)
        if row[1] in self.sides:
            yield (row[0], *now)


class Progress(InOrder):
    """Remaining seconds of a request, reading by reading."""

    shape, names = "us long, elapsed_s double, pct double", ("us", "eta_s")

    def begin(self, handle):
        self.anchor = handle.getValueState(f"anchor_{VERSION}", "elapsed_s double, pct double")

    def take(self, row):
        us, elapsed, pct = row
        eta = None
        if elapsed is not None and pct is not None:
            was = tuple(self.anchor.get()) if self.anchor.exists() else None
            now, eta = pressure.next_eta(was, elapsed, pct)
            if now is None and was is not None:
                self.anchor.clear()
            elif now is not None and now != was:
                self.anchor.update(now)
        yield (us, eta)


def _run(sides: list[DataFrame], delay: str, keys: list[str], processor: InOrder, out: str) -> DataFrame:
    """Rows (keys, ts, columns) of all sides through the processor, behind the slowest side's watermark; out: what it gives, beside the keys."""
    each = [s.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", delay) for s in sides]
    d = reduce(DataFrame.unionByName, each).withColumn("us", F.unix_micros("_at"))
    shape = ", ".join([f"{k} {dict(d.dtypes)[k]}" for k in keys] + [out])
    return d.groupBy(*keys).transformWithStateInPandas(processor, shape, "Append", "EventTime")


def _at(c: str):
    return F.timestamp_micros(F.col(c))


def latch_stream(samples: DataFrame, value, fire: float, rearm: float, keys: list[str], delay: str = "2 minutes") -> DataFrame:
    """(keys, poll_ts, value) where the latch fires, whatever order readings within the delay come in."""
    got = _run([samples.select(*keys, F.col("poll_ts").alias("ts"), value.cast("double").alias("value"))], delay, keys, Latch(keys, fire, rearm), "us long, value double")
    return got.select(*keys, _at("us").alias("poll_ts"), "value")


def log_full_alarm_in_order(samples: DataFrame, fire: float = 90, rearm: float = 85, delay: str = "2 minutes") -> DataFrame:
    return latch_stream(samples, F.col("used_percent"), fire, rearm, ["server"], delay).withColumnRenamed("value", "used_percent")


def cpu_pressure_alarm_in_order(samples: DataFrame, fire: float = 1.0, rearm: float = 0.5, delay: str = "2 minutes") -> DataFrame:
    s = samples.where("schedulers > 0")
    return latch_stream(s, F.col("runnable_tasks") / F.col("schedulers"), fire, rearm, ["server"], delay).withColumnRenamed("value", "ratio")


def offender_debt_stream(observed: DataFrame, idle_s: int = 300, keys: tuple[str, ...] = ("server",), delay: str = "2 minutes") -> DataFrame:
    """Of (keys, poll_ts, identity), with a row without identity for a poll that saw none: each bucket when it is over.

    A bucket is over when its identity has been idle for longer than idle_s by the watermark, or is seen again after
    that. The rows are those of ``blocking.offender_debt`` without the bucket's number, which nobody remembers.
    """
    got = _run([observed.select(*keys, F.col("poll_ts").alias("ts"), "identity")], delay, [*keys], Debt(keys, idle_s), "identity string, debt_s long, polls long, first_us long, last_us long")
    return got.select(*keys, "identity", "debt_s", "polls", _at("first_us").alias("first_seen"), _at("last_us").alias("last_seen"))


def rule_debt_stream(blocks: DataFrame, idle_s: int = 300, keys: tuple[str, ...] = ("server",), delay: str = "2 minutes") -> DataFrame:
    """Of (keys, poll_ts, blocker_spid, rule): (keys, rule, debt_s, polls) of each bucket when it is over."""
    columns = [F.col(c).cast("long").alias(c) for c in ("blocker_spid", "rule")]
    return _run([blocks.select(*keys, F.col("poll_ts").alias("ts"), *columns)], delay, [*keys], RuleDebt(keys, idle_s), "rule long, debt_s long, polls long")


def time_to_relief_stream(pauses: DataFrame, samples: DataFrame, drain_timeout_s: int = 0, blind_s: int = 0, keys: tuple[str, ...] = ("server",), delay: str = "2 minutes") -> DataFrame:
    """(keys, pause_ts, ended, relief_ts) of each pause when it ends; relief_ts only of ``relief``. Both inputs are streams."""
    p = pauses.select(*keys, F.col("pause_ts").alias("ts"), F.lit(0).alias("side"), F.lit(None).cast("boolean").alias("blocked"), F.lit(None).cast("boolean").alias("log_over"))
    s = samples.select(*keys, F.col("poll_ts").alias("ts"), F.lit(1).alias("side"), "blocked", "log_over")
    got = _run([p, s], delay, [*keys], Relief(keys, drain_timeout_s, blind_s), "pause_us long, ended string, relief_us long")
    return got.select(*keys, _at("pause_us").alias("pause_ts"), "ended", _at("relief_us").alias("relief_ts"))


def progress_eta_stream(samples: DataFrame, keys: list[str], delay: str = "2 minutes") -> DataFrame:
    """(keys, poll_ts, eta_s) of each reading, as ``pressure.progress_eta`` has it."""
    s = samples.select(*keys, F.col("poll_ts").alias("ts"), F.col("elapsed_s").cast("double").alias("elapsed_s"), F.col("pct").cast("double").alias("pct"))
    got = _run([s], delay, keys, Progress(*keys), "us long, eta_s long")
    return got.select(*keys, _at("us").alias("poll_ts"), "eta_s")


def _latest(sides: list[DataFrame], keys: list[str], values: dict[str, str], asked: tuple[int, ...], delay: str) -> DataFrame:
    rows = []
    for n, s in enumerate(sides):
        r = s.select(*keys, F.col("poll_ts").alias("ts"), F.lit(n).alias("side"), *(F.col(c).cast(t).alias(c) if c in s.columns else F.lit(None).cast(t).alias(c) for c, t in values.items()))
        rows.append(r)
    got = _run(rows, delay, keys, Latest(keys, values, asked), "us long, " + ", ".join(f"{c} {t}" for c, t in values.items()))
    return got.select(*keys, _at("us").alias("poll_ts"), *values)


def merge_channels_stream(block: DataFrame, log: DataFrame, keys: list[str], values: dict[str, str], delay: str = "2 minutes") -> DataFrame:
    """A row per poll of either channel with the latest known value of every column; a failed poll (NULL) keeps the old one.

    values: the columns and their types. Of polls at one time the block channel's comes first.
    """
    return _latest([block, log], keys, values, (0, 1), delay)


def as_of_stream(events: DataFrame, samples: DataFrame, keys: list[str], values: dict[str, str], delay: str = "2 minutes") -> DataFrame:
    """(keys, poll_ts, values): of each event (keys, poll_ts) the samples' last values at that time or before."""
    return _latest([samples, events], keys, values, (1,), delay)


class Silence(StatefulProcessor):
    """A timer by the clock, armed anew by each good poll; a channel turns blind once, and is told to be back once."""

    def __init__(self, keys: tuple[str, ...], after_s: float):
        self.keys, self.after = keys, int(after_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(f"seen_{VERSION}", "ok_us long, due_ms long, dark boolean")

    def _frame(self, key, rows):
        return pd.DataFrame([(*key, *r) for r in rows], columns=[*self.keys, "event", "last_ok_us", "silent_s"])

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        every = pd.concat(list(rows))
        good = every[~every["failed"]]
        ok, due, dark = self.state.get() if self.state.exists() else (None, None, False)
        if len(good):
            now = timerValues.getCurrentProcessingTimeInMs()
            newest = int(good["us"].max())
            cadence = good["cadence_s"].max()
            wait = max(self.after, int(2000 * cadence) if cadence == cadence else 0)
            if due is not None and not dark:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(now + wait)
            self.state.update((max(newest, ok or newest), now + wait, False))
            if dark:
                yield self._frame(key, [("answering", ok, (newest - ok) // 1_000_000)])
                return
        yield self._frame(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        ok, due, dark = self.state.get()
        if dark or expiredTimerInfo.getExpiryTimeInMs() != due:
            yield self._frame(key, [])
            return
        self.state.update((ok, due, True))
        yield self._frame(key, [("blind", ok, None)])

    def close(self) -> None:
        pass


def blind_channels_stream(polls: DataFrame, keys: list[str], after_s: float = 120) -> DataFrame:
    """Of (keys, poll_ts, failed, cadence_s): a row when a channel turns blind by the clock, and one when it answers again.

    A channel is blind once no good poll has come for max(after_s, 2 cadences), also if none ever comes again.
    """
    d = polls.select(*keys, F.unix_micros(F.col("poll_ts").cast("timestamp")).alias("us"), F.coalesce("failed", F.lit(False)).alias("failed"), F.col("cadence_s").cast("double").alias("cadence_s"))
    shape = ", ".join([f"{k} {dict(polls.dtypes)[k]}" for k in keys] + ["event string, last_ok_us long, silent_s long"])
    got = d.groupBy(*keys).transformWithStateInPandas(Silence(tuple(keys), after_s), shape, "Append", "ProcessingTime")
    return got.select(*keys, "event", _at("last_ok_us").alias("last_ok_ts"), "silent_s")


def suppress_recent_stream(victims: DataFrame, actions: DataFrame, grace_s: int = 15, keys: tuple[str, ...] = ("server",), delay: str = "2 minutes") -> DataFrame:
    """Victims (keys, poll_ts, spid) that no action covers: an outer interval join of two streams, of which the unmatched side stays.

    actions: (keys, spid, action_ts, done_ts, failed). One covers grace_s from done_ts on, and all before it since
    action_ts; while it is pending (no done_ts) it covers ``PENDING_S`` at most, as its interval must end for the state
    to go. A failed action covers nothing, but moves the watermark, without which no victim is given out.
    """
    v = victims.withColumn("poll_ts", F.col("poll_ts").cast("timestamp")).withWatermark("poll_ts", delay).alias("v")
    end = F.coalesce(F.col("done_ts") + F.expr(f"INTERVAL {grace_s} SECONDS"), F.col("action_ts") + F.expr(f"INTERVAL {PENDING_S} SECONDS"))
    until = F.when(F.coalesce("failed", F.lit(False)), F.col("action_ts")).otherwise(end)  # no filter: Spark would move it before the watermark
    a = actions.withColumn("action_ts", F.col("action_ts").cast("timestamp")).withWatermark("action_ts", delay).select(*(F.col(k).alias(f"a_{k}") for k in (*keys, "spid")), "action_ts", until.alias("end_ts"))
    same = F.lit(True)
    for k in (*keys, "spid"):
        same = same & (F.col(f"v.{k}") == F.col(f"a_{k}"))
    bound = F.col("action_ts") >= F.col("v.poll_ts") - F.expr(f"INTERVAL {PENDING_S} SECONDS")
    j = v.join(a, same & (F.col("action_ts") <= F.col("v.poll_ts")) & bound & (F.col("v.poll_ts") < F.col("end_ts")), "left_outer")
    return j.where("a_spid IS NULL").select("v.*")


#: The longest that an action is taken to be pending, or to have been.
PENDING_S = 3600


def held_through_stream(held: DataFrame, keys: tuple[str, ...] = ("server", "spid", "login", "program"), delay: str = "2 minutes") -> DataFrame:
    """The first of each ignored session's rows; it may come again once the delay has passed since."""
    return held.withColumn("poll_ts", F.col("poll_ts").cast("timestamp")).withWatermark("poll_ts", delay).dropDuplicatesWithinWatermark([*keys])
