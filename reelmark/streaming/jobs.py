"""A queue as a stream of two inputs: what happens to jobs, and what is set for services, marks and profiles.

State is kept for shards of jobs, not for single jobs: a shard's jobs lie in one sorted array, and the steps of a batch are applied to all of
them at once, the first step of each job, then the second, and so on. Settings go to every shard. A setting that changes lets all waiting jobs
be looked at again; what comes of it depends on a job's own service, profile and day alone, so the settings of a batch are summed up for those
(Facts), and a job passes all settings between two of its steps in one look-up. The work grows with steps and settings, not with their
product; what a task holds grows with the changes of a service's settings in a batch times the days that its jobs have. Shards are a number of
their own (SHARDS), so that a shard's array stays small: take about a ten-thousandth of the jobs that are held at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SHARDS = 64
GONE, PENDING, QUEUED, ENCODING, COMPLETE, FAILED, CANCELED, PREFAILED = range(8)
STATES = ("", "LogoPending", "Queue", "Encoding", "Complete", "Failed", "Canceled", "PreFailed")
# Why a job waits.
REASONS = ("", "TS情報取得中", "このTSのチャンネル設定がありません（追加し直してください）", "ロゴ設定がありません")
#: A job as the feed adds it: its service (-1 while it is unknown), profile, the day of its recording, and what it is.
FEED = "seq long, item long, op string, service long, profile long, day long, check boolean, needs_hash boolean, broken boolean, a long, b long"
_JOB = np.dtype([("item", "i8"), ("state", "i1"), ("reason", "i1"), ("decided", "?"), ("chapter", "?"), ("hash", "?"), ("changes", "i8"), ("service", "i8"), ("profile", "i8"), ("day", "i8"), ("check", "?"), ("needs_hash", "?")])
_STEPS = {"start": ((QUEUED,), ENCODING), "done": ((ENCODING,), COMPLETE), "fail": ((ENCODING,), FAILED), "cancel": ((PENDING, QUEUED, ENCODING), CANCELED)}
SETTINGS = ("service", "mark", "profile")
#: What a job takes from the step that adds it, besides whether it is broken.
_OWN = ("service", "profile", "day", "check", "needs_hash")


class Settings:
    """Known services, days from and to which a service's mark is usable, and profiles with whether they look for chapters."""

    def __init__(self, text: str = "{}") -> None:
        read = json.loads(text)
        self.services, self.marks, self.profiles = ({int(k): v for k, v in read.get(name, {}).items()} for name in ("services", "marks", "profiles"))

    def text(self) -> str:
        return json.dumps({"services": self.services, "marks": self.marks, "profiles": self.profiles})

    def change(self, op: str, key: int, a: int, b: int) -> None:
        """service: known if a; mark: usable from day a to b, never if b lies before; profile: there if a, without chapters if b."""
        if op == "service":
            self.services[key] = bool(a)
        elif op == "mark":
            self.marks[key] = [a, b]
        else:
            self.profiles[key] = [bool(a), not b]


class _Timeline:
    """What each key is set to as of each epoch. keys: all that are asked for, sorted; held: what they are set to at epoch 0."""

    def __init__(self, keys: np.ndarray, held: dict[int, object], default: list[int], changed: np.ndarray, epochs: np.ndarray, values: np.ndarray, most: int) -> None:
        self.keys, self.most = keys, most
        rank = np.concatenate((np.arange(len(keys)), np.searchsorted(keys, changed)))
        epoch = np.concatenate((np.zeros(len(keys), np.int64), epochs))
        first = np.array([np.ravel(held.get(int(k), default)) for k in keys], np.int64).reshape(len(keys), len(default))
        order = np.lexsort((epoch, rank))
        self.rank, self.epoch, self.values = rank[order], epoch[order], np.concatenate((first, values))[order]
        self.codes = self.rank * most + self.epoch

    def place(self, keys: np.ndarray, epochs: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.codes, np.searchsorted(self.keys, keys) * self.most + epochs, "right") - 1

    def of(self, key: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(self.rank, (k := np.searchsorted(self.keys, key), k + 1))
        return self.epoch[a:b], self.values[a:b]


class Facts:
    """What is set as of each epoch of a batch, an epoch being the number of settings before it.

    rows: the settings in their order; jobs: all whose services, profiles and days may be asked for. Of each service and day, with chapters
    or without, only the epochs are kept at which another reason holds jobs back.
    """

    def __init__(self, settings: Settings, rows: pd.DataFrame, jobs: np.ndarray) -> None:
        self.most = len(rows) + 2
        op, key, values, epochs = rows["op"].to_numpy(str), rows["item"].to_numpy(np.int64), rows[["a", "b"]].astype(np.int64).to_numpy(), np.arange(1, len(rows) + 1)

        def timeline(name: str, wanted: np.ndarray, held: dict[int, object], default: list[int], shape: Callable[[np.ndarray], np.ndarray]) -> _Timeline:
            own = op == name
            return _Timeline(np.unique(np.concatenate((wanted, key[own]))), held, default, key[own], epochs[own], shape(values[own]), self.most)

        self.services = timeline("service", jobs["service"], settings.services, [0], lambda v: (v[:, :1] != 0).astype(np.int64))
        self.marks = timeline("mark", jobs["service"], settings.marks, [0, -1], lambda v: v)
        self.profiles = timeline("profile", jobs["profile"], settings.profiles, [0, 0], lambda v: np.stack((v[:, 0] != 0, v[:, 1] == 0), 1).astype(np.int64))
        there = np.where(self.profiles.values[:, 0] != 0, np.arange(len(self.profiles.rank)), len(self.profiles.rank))
        self.next_there = np.minimum.accumulate(there[::-1])[::-1]
        self._sum_up(jobs)

    def _sum_up(self, jobs: np.ndarray) -> None:
        self.days = np.unique(jobs["day"])
        self.pairs = np.unique(self._pair(jobs))
        parts, service = [], None
        for k, pair in enumerate(self.pairs.tolist()):
            if service != (service := self.services.keys[pair // len(self.days)]):
                (at, known), (mark_at, mark) = self.services.of(service), self.marks.of(service)
                epoch = np.union1d(at, mark_at)
                known = known[np.searchsorted(at, epoch, "right") - 1, 0] != 0
                first, last = mark[np.searchsorted(mark_at, epoch, "right") - 1].T
            day = self.days[pair % len(self.days)]
            for chapter in range(2):
                reason = np.where(~known, 2, np.where((first <= day) & (day <= last), 0, 3 * chapter))
                new = np.concatenate(([True], reason[1:] != reason[:-1]))
                parts.append(((2 * k + chapter) * self.most + epoch[new], reason[new]))
        self.codes, self.reasons = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (list(zip(*parts, strict=True)) or [(), ()]))
        free = self.reasons == 0
        self.flips = np.cumsum(np.concatenate(([False], free[1:] != free[:-1]))[: len(free)])
        self.last_held = np.maximum.accumulate(np.where(free, -1, np.arange(len(free)))) if len(free) else self.flips

    def _pair(self, jobs: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.services.keys, jobs["service"]) * len(self.days) + np.searchsorted(self.days, jobs["day"])

    def of(self, jobs: np.ndarray, epochs: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each job as of its epoch: its service is known, its mark usable, its profile there, and looks for chapters."""
        known = self.services.values[self.services.place(jobs["service"], epochs), 0] != 0
        first, last = self.marks.values[self.marks.place(jobs["service"], epochs)].T
        there, chapter = (self.profiles.values[self.profiles.place(jobs["profile"], epochs)] != 0).T
        return known, (first <= jobs["day"]) & (jobs["day"] <= last), there, chapter

    def there_from(self, jobs: np.ndarray, epochs: np.ndarray) -> np.ndarray:
        """The first epoch, this one or later, at which a job's profile is there; beyond all epochs if none."""
        place = self.profiles.place(jobs["profile"], epochs)
        then = self.next_there[place]
        at = np.minimum(then, len(self.next_there) - 1)
        return np.where((then > at) | (self.profiles.rank[at] != self.profiles.rank[place]), self.most, np.maximum(self.profiles.epoch[at], epochs))

    def passed(self, jobs: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of decided jobs: how often they are held back or let go after epoch start up to stop, the reason that holds them then, and the last reason that held them, start included; 0 for none."""
        code = (2 * np.searchsorted(self.pairs, self._pair(jobs)) + jobs["chapter"]) * self.most
        a, b = (np.searchsorted(self.codes, code + x, "right") - 1 for x in (start, stop))
        last = self.last_held[b]
        return self.flips[b] - self.flips[a], self.reasons[b], np.where(last >= a, self.reasons[last], 0)


def looked_at(jobs: np.ndarray, facts: tuple[np.ndarray, ...]) -> np.ndarray:
    """Jobs that wait or are queued, after it was looked at whether they may start. facts: see Facts.of()."""
    known, usable, there, chapter = facts
    waiting = np.isin(jobs["state"], (PENDING, QUEUED))
    ready = waiting & jobs["check"]
    rest = waiting & ~jobs["check"]
    now = rest & ~jobs["decided"] & there  # a profile that was once chosen stays
    jobs["decided"] |= now
    jobs["chapter"] = np.where(now, chapter, jobs["chapter"])
    rest &= jobs["decided"]
    for test, reason in ((jobs["service"] == -1, 1), (~known, 2), (jobs["chapter"] & ~usable, 3), (jobs["needs_hash"] & ~jobs["hash"], None)):
        held = rest & test
        jobs["state"][held] = PENDING
        if reason is not None:
            jobs["reason"][held] = reason
        rest &= ~test
    ready = (ready | rest) & (jobs["state"] == PENDING)
    jobs["state"][ready] = QUEUED
    jobs["reason"][ready] = 0
    return jobs


def waited(jobs: np.ndarray, facts: Facts, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Jobs after all settings from epoch start to stop: those that wait were looked at as of start and are as if looked at after each setting."""
    waiting = np.isin(jobs["state"], (PENDING, QUEUED)) & ~jobs["check"] & (start < stop)
    at = np.flatnonzero(waiting & ~jobs["decided"])
    then = facts.there_from(jobs[at], start[at])
    at, then = at[then <= stop[at]], then[then <= stop[at]]
    own = looked_at(jobs[at], facts.of(jobs[at], then))
    own["changes"] += own["state"] != jobs["state"][at]
    jobs[at] = own
    start = start.copy()
    start[at] = then
    at = np.flatnonzero(waiting & jobs["decided"] & (jobs["service"] != -1))
    own = jobs[at]
    flips, now, last = facts.passed(own, start[at], stop[at])
    hashed = own["hash"] | ~own["needs_hash"]
    own["state"] = np.where(hashed & (now == 0), QUEUED, PENDING)
    own["reason"] = np.where(hashed, now, np.where(last > 0, last, own["reason"]))
    own["changes"] += np.where(hashed, flips, 0)
    jobs[at] = own
    return jobs


def stepped(jobs: np.ndarray, steps: dict[str, np.ndarray], facts: Facts, epochs: np.ndarray) -> np.ndarray:
    """One step of each of these jobs, as of its epoch."""
    before, op = jobs["state"].copy(), steps["op"]
    new = (op == "add") & (before == GONE)
    for name in _OWN:
        jobs[name] = np.where(new, steps[name], jobs[name])
    jobs["state"] = np.where(new, np.where(steps["broken"], PREFAILED, PENDING), before)
    again = (op == "retry") & ~np.isin(before, (GONE, ENCODING, PREFAILED))
    jobs["state"][again] = PENDING
    for name in ("decided", "hash", "reason"):
        jobs[name][new] = 0
    jobs["decided"][again] = False
    for name, (own, then) in _STEPS.items():
        jobs["state"] = np.where((op == name) & np.isin(before, own), then, jobs["state"])
    jobs["hash"] |= (op == "hash") & (before != GONE)
    jobs["state"][op == "remove"] = GONE
    looked = new | again | (op == "hash")
    jobs[looked] = looked_at(jobs[looked], facts.of(jobs[looked], epochs[looked]))
    jobs["changes"] += jobs["state"] != before
    return jobs


def advanced(jobs: np.ndarray, settings: Settings, batch: pd.DataFrame) -> np.ndarray:
    """All jobs of a shard after a batch of its steps and settings, in the order of seq."""
    batch = batch.sort_values("seq", kind="stable", ignore_index=True)
    is_setting = batch["op"].isin(SETTINGS).to_numpy(bool)
    is_step = ~is_setting & batch["item"].notna().to_numpy(bool)
    rows, own = batch[is_setting], batch[is_step]
    items, epochs = own["item"].to_numpy(np.int64), np.cumsum(is_setting)[is_step]
    steps = {name: own[name].fillna(False if name == "broken" else 0).to_numpy(bool if name == "broken" else _JOB[name]) for name in (*_OWN, "broken")} | {"op": own["op"].to_numpy(str)}
    fresh = np.setdiff1d(items, jobs["item"])
    added = np.zeros(len(fresh), _JOB)
    added["item"] = fresh
    jobs = np.concatenate((jobs, added))
    jobs = jobs[np.argsort(jobs["item"])]
    asked = np.zeros(int((steps["op"] == "add").sum()), _JOB)
    for name in ("service", "profile", "day"):
        asked[name] = steps[name][steps["op"] == "add"]
    facts = Facts(settings, rows, np.concatenate((jobs, asked)))
    turn, at, since = own.groupby("item").cumcount().to_numpy(), np.searchsorted(jobs["item"], items), np.zeros(len(jobs), np.int64)
    order = np.argsort(turn, kind="stable")
    cuts = np.flatnonzero(np.diff(turn[order], prepend=-1, append=-1)) if len(order) else [0]
    for first, stop in zip(cuts[:-1], cuts[1:], strict=True):
        k = order[first:stop]
        before = waited(jobs[at[k]], facts, since[at[k]], epochs[k])
        jobs[at[k]] = stepped(before, {name: x[k] for name, x in steps.items()}, facts, epochs[k])
        since[at[k]] = epochs[k]
    for row in rows.drop_duplicates(["op", "item"], keep="last").itertuples():
        settings.change(row.op, int(row.item), int(row.a), int(row.b))
    return waited(jobs, facts, since, np.full(len(jobs), len(rows)))


def queue_states(feed: DataFrame, shards: int = SHARDS) -> DataFrame:
    """feed: see FEED, item being the service or profile of a setting. (item, state, reason, changes) of jobs whose row changed in a batch; a removed job has the state ''."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, text = state.get if state.exists else (b"", "{}")
        jobs, settings = np.frombuffer(held, _JOB).copy(), Settings(text)
        after = advanced(jobs.copy(), settings, pd.concat(list(batches), ignore_index=True))
        at = np.minimum(np.searchsorted(jobs["item"], after["item"]), max(0, len(jobs) - 1))
        changed = np.ones(len(after), bool) if not len(jobs) else (jobs["item"][at] != after["item"]) | (jobs["changes"][at] != after["changes"]) | (jobs["reason"][at] != after["reason"])
        state.update((after.tobytes(), settings.text()))
        out = after[changed]
        yield pd.DataFrame({"item": out["item"], "state": [STATES[x] for x in out["state"]], "reason": [REASONS[x] for x in out["reason"]], "changes": out["changes"]})

    everywhere = F.sequence(F.lit(0), F.lit(shards - 1))
    own = F.array(F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int"))
    dealt = feed.withColumn("shard", F.explode(F.when(F.col("op").isin(*SETTINGS), everywhere).otherwise(own)))
    return dealt.groupBy("shard").applyInPandasWithState(step, "item long, state string, reason string, changes long", "jobs binary, settings string", "update", GroupStateTimeout.NoTimeout)


def walked(items: np.ndarray, states: np.ndarray, changes: np.ndarray, batch: pd.DataFrame, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items, states and numbers of changes after a batch of coded steps (item, op); table[state, op] is the next state, or -1 where a step is refused."""
    fresh = np.setdiff1d(batch["item"].to_numpy(np.int64), items)
    items = np.concatenate((items, fresh))
    order = np.argsort(items)
    items = items[order]
    states, changes = (np.concatenate((x, np.zeros(len(fresh), x.dtype)))[order] for x in (states, changes))
    at, turn, op = np.searchsorted(items, batch["item"].to_numpy(np.int64)), batch.groupby("item").cumcount().to_numpy(), batch["op"].to_numpy(np.int64)
    for k in range(int(turn.max()) + 1 if len(turn) else 0):
        own = turn == k
        then = table[states[at[own]], op[own]]
        taken = then >= 0
        states[at[own][taken]] = then[taken]
        changes[at[own][taken]] += 1
    return items, states, changes
