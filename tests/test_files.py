"""Files of odd contents, the watcher, packets, hook commands and symbols on written-out cases."""

from __future__ import annotations

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from reelmark.functions import arib, genre
from reelmark.operators import hooks, lists
from reelmark.sources import storage
from reelmark.streaming import jobs, updates


def test_digests_of_odd_files(spark, tmp_path):
    rng = random.Random(9)
    contents = {"empty": b"", "feed": b"\n", "feeds": b"\n\n\n", "open": b"a\nb", "ended": b"a\nb\n", "returns": b"a\r\nb\rc\r\n", "bytes": rng.randbytes(300_000), "name with blank+plus%.ts": b"x"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {r.path.rsplit("/", 1)[1]: (r.length, r.sha512) for r in storage.file_digests(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {name: (len(data), hashlib.sha512(data).hexdigest()) for name, data in contents.items() if data}


def test_a_step_of_the_watcher_can_be_repeated(spark, tmp_path):
    folder, state = tmp_path / "f", str(tmp_path / "state")
    folder.mkdir()
    (folder / "a.ts").write_text("1")
    names = lambda n: sorted((r.path.rsplit("/", 1)[1], r.change) for r in updates.look(spark, str(folder), [".ts"], state, n).collect())
    assert names(0) == names(0) == [("a.ts", "add")]
    (folder / "b.ts").write_text("2")
    assert names(1) == [("b.ts", "add")]
    (folder / "a.ts").write_text("longer")
    assert names(1) == [("a.ts", "change"), ("b.ts", "add")]
    (folder / "b.ts").unlink()
    assert names(2) == [("b.ts", "remove")] and names(3) == []
    assert spark.read.parquet(f"{state}/changes").count() == 4


def test_a_watcher_runs_until_it_is_stopped(spark, tmp_path):
    folder = tmp_path / "f"
    folder.mkdir()
    (folder / "a.ts").write_text("1")
    seen = []
    query = updates.watch(spark, str(folder), [".ts"], str(tmp_path / "state"), 1, lambda found: seen.extend(r.change for r in found.collect()), str(tmp_path / "checkpoint"))
    try:
        until = time.time() + 40
        while "add" not in seen and time.time() < until:
            time.sleep(0.2)
        (folder / "a.ts").unlink()
        while "remove" not in seen and time.time() < until:
            time.sleep(0.2)
    finally:
        query.stop()
    assert seen == ["add", "remove"]


def test_scores_lie_in_a_folder_for_each_candidate(spark, tmp_path):
    storage.write_by_candidate(spark.range(6).withColumn("logo", F.col("id") % 2), str(tmp_path / "s"), "logo")
    assert sorted(x.name for x in (tmp_path / "s").iterdir() if x.is_dir()) == ["logo=0", "logo=1"]


def test_packets_hold_their_comments_in_order(spark):
    rows = [(1, 2, "b"), (1, 1, "a"), (2, 1, "c")]
    got = {r.key: r.packet for r in storage.comment_packet(spark.createDataFrame(rows, "key int, no int, line string"), "key", "no", "line").collect()}
    assert got[1] == "<?xml version='1.0' encoding='UTF-8'?>\n<packet>\na\nb\n</packet>" and got[2].endswith("\nc\n</packet>")


def test_a_sorted_view_is_in_order(spark):
    df = spark.createDataFrame([(k * 7 % 10, k) for k in range(10)], "price int, id int")
    once = lists.toggled(None, "price")
    assert [r.price for r in lists.sorted_view(df, once).collect()] == sorted(range(10))
    assert [r.price for r in lists.sorted_view(df, lists.toggled(once, "price")).collect()] == sorted(range(10), reverse=True)


def test_commands_are_guarded_by_their_phase(spark):
    job = spark.createDataFrame([(1, ["x"], "C:\\a\\b.mp4", 3, "Queue", ["f"]), (2, [], "d", 1, "Queue", [])], "job int, tags array<string>, dst_path string, priority int, state string, out_files array<string>")
    said = [
        (hooks.ON_ADD, "AddTag", "x"), (hooks.ON_ADD, "AddTag", ""), (hooks.ON_ADD, "AddTag", "y"), (hooks.ON_ADD, "SetPriority", "6"), (hooks.ON_ADD, "SetPriority", None), (hooks.ON_ADD, "SetPriority", "5"),
        (hooks.PRE_ENCODE, "SetPriority", "1"), (hooks.PRE_ENCODE, "SetOutDir", "E:\\n\\\\"), (hooks.PRE_ENCODE, "GetOutFiles", "all"), (hooks.POST_ENCODE, "SetOutDir", "F:"), (hooks.POST_ENCODE, "GetOutFiles", None),
        (hooks.POST_ENCODE, "CancelItem", None), (hooks.PRE_ENCODE, "SetOutDir", None),
    ]
    commands = spark.createDataFrame([(1, k, *c) for k, c in enumerate(said)], "job int, seq long, phase string, command string, arg string").orderBy(F.rand(1))
    got = {r.job: r for r in hooks.commanded(job, commands, "job").collect()}
    r = got[1]
    assert (r.tags, r.dst_path, r.priority, r.state) == (["x", "y"], "E:\\n\\b.mp4", 5, "Queue")
    assert [x.reply for x in r.replies] == ["x", "x", "x;y", hooks.OUT_OF_RANGE, hooks.OUT_OF_RANGE, hooks.DONE, hooks.ONLY_ON_ADD, hooks.DONE, hooks.NOT_ENCODED, hooks.NO_DIR_AFTER, "f", hooks.NO_CANCEL, hooks.NO_DIR]
    assert got[2].replies == [] and got[2].dst_path == "d"


def test_symbols():
    text = lambda data, **more: "".join(r["text"] for r in arib.decode(bytes.fromhex(data), **more))
    assert text("7A50 7A74 7E21 7E7D 7D21 7D28 7C40 7E5A 7C2F") == "[HV]ほかⅠ㉛㈪㈷０,(Z)㎤"
    assert text("1B24293B 0E 1B7E 7A56") in ("[字]", "")  # designated to G1 as a set of its own
    assert text("7521") == arib.PLACEHOLDER and text("7521", symbols={0x7521: "㐂"}) == "㐂"


def test_genres_are_known():
    names = {(a, b, c): (d, e) for a, b, c, d, e in genre.named()}
    assert names[0, 0, 1] == ("ニュース／報道", "天気") and names[0, 11, 15] == ("福祉", "その他") and names[2, 3, 0] == ("アダルト(CS)", "アダルト") and names[0, 15, 15] == ("その他", "その他")
    assert len(names) == len(genre.named()) and (0, 3, 5) not in names


def feed(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], jobs.FEED)


def test_waiting_jobs_are_looked_at_again_when_settings_change(spark, tmp_path):
    job = lambda item, op, service=1, profile=0, day=5, check=False, needs=False, broken=False: (item, op, service, profile, day, check, needs, broken, None, None)
    setting = lambda item, op, a, b=0: (item, op, None, None, None, None, None, None, a, b)
    batches = [
        [job(1, "add"), job(2, "add", check=True), job(3, "add", service=-1), job(4, "add", broken=True), job(5, "add", needs=True)],
        [setting(0, "profile", 1, 0)],
        [setting(1, "service", 1)],
        [setting(1, "mark", 0, 9), job(5, "hash"), job(2, "start")],
        [setting(1, "mark", 6, 9), job(2, "remove"), setting(0, "profile", 0, 0)],
        [job(1, "retry"), job(5, "cancel"), job(2, "add", check=True)],
    ]
    path = str(tmp_path / "feed")
    seq = 0
    for batch in batches:
        rows = [(seq + k, *r) for k, r in enumerate(batch)]
        seq += len(batch)
        spark.createDataFrame(rows, jobs.FEED).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    out = updates.run_to_end(jobs.queue_states(updates.files(spark, path, jobs.FEED, 1), 3), "update", "queue").collect()
    seen = {}
    for r in sorted(out, key=lambda r: r.batch):
        seen.setdefault(r.item, []).append((r.batch, r.state, jobs.REASONS.index(r.reason)))
    assert seen[1] == [(0, "LogoPending", 0), (1, "LogoPending", 2), (2, "LogoPending", 3), (3, "Queue", 0), (4, "LogoPending", 3), (5, "LogoPending", 3)][: len(seen[1])]
    assert seen[2] == [(0, "Queue", 0), (3, "Encoding", 0), (4, "", 0), (5, "Queue", 0)]
    assert seen[3] == [(0, "LogoPending", 0), (1, "LogoPending", 1)] and seen[4] == [(0, "PreFailed", 0)]
    assert seen[5][-1][1] == "Canceled" and ("Queue" in [s for _, s, _ in seen[5]])


def plain_queue(rows):
    """Each job by itself: [state, reason, changes] by item. rows: as in FEED, in their order."""
    services, marks, profiles, held, out = {}, {}, {}, {}, {}

    def look(item):
        own = out[item]
        if own[0] not in ("LogoPending", "Queue"):
            return
        j = held[item]
        there, chapter = profiles.get(j["profile"], (False, False))
        if not j["check"]:
            if not j["decided"] and there:
                j["decided"], j["chapter"] = True, chapter
            if not j["decided"]:
                return
            first, last = marks.get(j["service"], (0, -1))
            why = 1 if j["service"] == -1 else 2 if not services.get(j["service"]) else 3 if j["chapter"] and not first <= j["day"] <= last else None
            if why or j["needs"] and not j["hash"]:
                own[0], own[1] = "LogoPending", why or own[1]
                return
        own[:2] = ["Queue", 0] if own[0] == "LogoPending" else own[:2]

    def counted(item, change):
        before = out[item][0]
        change()
        out[item][2] += out[item][0] != before

    for _, item, op, service, profile, day, check, needs, broken, a, b in rows:
        if op in jobs.SETTINGS:
            {"service": services, "mark": marks, "profile": profiles}[op][item] = {"service": bool(a), "mark": (a, b), "profile": (bool(a), not b)}[op]
            for other in out:
                counted(other, lambda other=other: look(other))
            continue
        own = out.setdefault(item, ["", 0, 0])

        def step(item=item, op=op, own=own, job=(service, profile, day, check, needs), broken=broken):
            was = own[0]
            if op == "add" and was == "":
                held[item] = dict(zip(("service", "profile", "day", "check", "needs"), job, strict=True), decided=False, chapter=False, hash=False)
                own[:2] = ["PreFailed" if broken else "LogoPending", 0]
            elif op == "retry" and was not in ("", "Encoding", "PreFailed"):
                own[0], held[item]["decided"] = "LogoPending", False
            elif op == "hash" and was:
                held[item]["hash"] = True
            elif (op, was) in (("start", "Queue"), ("done", "Encoding"), ("fail", "Encoding")) or op == "cancel" and was in ("LogoPending", "Queue", "Encoding"):
                own[0] = {"start": "Encoding", "done": "Complete", "fail": "Failed", "cancel": "Canceled"}[op]
            elif op == "remove":
                own[0] = ""
            if item in held and (op in ("retry", "hash") or op == "add" and was == ""):
                look(item)

        counted(item, step)
    return out


def test_a_queue_passes_many_settings_at_once(monkeypatch):
    """As if every setting let every waiting job be looked at; jobs that are looked at grow with steps, not with steps times settings."""
    import random

    import numpy as np
    import pandas as pd

    looked, plain = [], jobs.looked_at
    monkeypatch.setattr(jobs, "looked_at", lambda own, facts: looked.append(len(own)) or plain(own, facts))
    names = [c.split()[0] for c in jobs.FEED.split(", ")]
    ops = ("add", "add", "start", "done", "fail", "cancel", "retry", "hash", "remove")
    for seed, share in enumerate((0.1, 0.5, 0.9, 0.0, 1.0, 0.7)):
        rng, rows = random.Random(seed), []
        for seq in range(900):
            item, kind, j = rng.randint(0, 29), rng.choice(jobs.SETTINGS), rng.randint(0, 99)
            setting = (rng.randint(-1, 3), kind, None, None, None, None, None, None, rng.randint(0, 3) if kind == "mark" else rng.randint(0, 1), rng.randint(0, 3) if kind == "mark" else rng.randint(0, 1))
            rows.append((seq, *setting) if rng.random() < share else (seq, item, rng.choice(ops), j % 6 - 1, j % 3, j % 4, j % 11 == 0, j % 3 == 0, j % 13 == 0, None, None))
        settings, held = jobs.Settings(), np.zeros(0, jobs._JOB)
        looked.clear()
        for a in range(0, 900, 300):
            held = jobs.advanced(held.copy(), jobs.Settings(settings.text()) if a else settings, pd.DataFrame(rows[a : a + 300], columns=names).sample(frac=1, random_state=seed))
            for r in rows[a : a + 300]:
                if r[2] in jobs.SETTINGS:
                    settings.change(r[2], r[1], r[-2], r[-1])
        got = {int(r["item"]): [jobs.STATES[r["state"]], int(r["reason"]), int(r["changes"])] for r in held}
        assert got == plain_queue(rows)
        steps = sum(r[2] not in jobs.SETTINGS for r in rows)
        assert sum(looked) <= 2 * steps + 3 * len(held)


def test_a_key_of_many_steps_is_walked_side_by_side():
    import numpy as np
    import pandas as pd

    table = np.array([[1, -1], [0, 1]])
    none = np.zeros(0, np.int64)
    batch = pd.DataFrame({"item": [5, 5, 5, 0, 5], "op": [0, 1, 0, 1, 0]})
    items, states, changes = jobs.walked(none, none, none, batch, table)
    assert items.tolist() == [0, 5] and states.tolist() == [0, 1] and changes.tolist() == [0, 4]
    items, states, changes = jobs.walked(items, states, changes, pd.DataFrame({"item": [3], "op": [0]}), table)
    assert items.tolist() == [0, 3, 5] and states.tolist() == [0, 1, 1] and changes.tolist() == [0, 1, 4]
