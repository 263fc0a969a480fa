from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from quernstone.sources import files as S
from quernstone.streaming import breaker as B
from quernstone.streaming import limits as L


def test_files(spark, tmp_path):
    (tmp_path / "src" / "a").mkdir(parents=True)
    (tmp_path / "node_modules" / "x").mkdir(parents=True)
    (tmp_path / "src" / "a" / "one.ts").write_text("import {b} from './two'\nimport z from '../lib'\nimport r from 'react'\n// TODO: later\n")
    (tmp_path / "node_modules" / "x" / "no.ts").write_text("import q from 'q'")
    (tmp_path / "skill.md").write_text("---\nname: tester\ndescription: Writes tests\n---\n# Body\ntext\n")
    src = S.source_files(spark, str(tmp_path), "*.ts")
    assert src.count() == 1
    got = {r.target.rsplit("/src/", 1)[-1] for r in S.imports(src).collect()}
    assert got == {"a/two", "lib", "react"}
    assert [(r.line, r.mark, r.note) for r in S.note_lines(src).collect()] == [(4, "TODO", "later")]
    skill = S.frontmatter(S.source_files(spark, str(tmp_path), "*.md")).first()
    assert (skill.name, skill.description, skill.body) == ("tester", "Writes tests", "# Body\ntext")


def test_commit_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text("commit\tabc\tfix: crash\t2024-01-01T00:00:00Z\na.py\nb.py\n\ncommit\tdef\tadd feature\t2024-01-02T00:00:00Z\n\n")
    got = [tuple(r) for r in S.commit_log(spark, str(tmp_path)).orderBy("hash", "file").collect()]
    assert got == [("abc", "fix: crash", "2024-01-01T00:00:00Z", "a.py"), ("abc", "fix: crash", "2024-01-01T00:00:00Z", "b.py"), ("def", "add feature", "2024-01-02T00:00:00Z", None)]


def test_commit_log_in_parts(spark, tmp_path):
    """A log longer than a task's share is read by several tasks, each commit once; new files are read by a stream that goes on."""
    text = "\n".join(f"commit\th{k}\tsubject {k}\t2024-01-01T00:00:00Z\n" + "".join(f"dir/{j}.py\n" for j in range(k % 5)) for k in range(4000))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = S.commit_log(spark, str(tmp_path / "in"))
        assert df.rdd.getNumPartitions() > 4
        got = sorted((r.hash, r.file or "") for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted((f"h{k}", f"dir/{j}.py" if k % 5 else "") for k in range(4000) for j in range(max(1, k % 5)))

    def drain():
        q = S.commit_stream(spark, str(tmp_path / "in")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert drain() == len(got)
    (tmp_path / "in/b.txt").write_text("commit\tz\tlater\t2024-01-02T00:00:00Z\nx.py\n")
    assert drain() == len(got) + 1


def test_append_and_xml(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b" <c>&')], "id long, t string")
    S.append(df, str(tmp_path / "t"))
    S.append(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert S.xml_rows(df, "row").first()[0] == '<row id="1" t="a &quot;b&quot; &lt;c&gt;&amp;"/>'
    many = spark.createDataFrame([(1, k) for k in range(5)] + [(2, 1)], "g long, t long")
    assert {tuple(r) for r in S.keep_newest(many, "g", "t", 2).collect()} == {(1, 4), (1, 3), (2, 1)}


def stream(spark, tmp_path, rows, schema):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "0.json").write_text("\n".join(json.dumps(r) for r in rows))
    return spark.readStream.schema(schema).json(str(folder))


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name).collect()


def test_breaker_stream(spark, tmp_path):
    second = 1_000_000
    plan = [(1, True), (2, True), (3, True), (10, False), (64, False), (65, True), (70, True), (71, True), (132, True), (133, False), (200, False)]
    rows = [{"k": "m", "id": i, "us": t * second, "failed": f} for i, (t, f) in enumerate(plan)]
    src = stream(spark, tmp_path, rows, "k string, id long, us long, failed boolean")
    got = {r.id: (r.state, r.streak) for r in drain(L.circuit_breaker(src, "k", "id", "us", "failed"), "breaker", "append")}
    assert got[2] == ("open", 3) and got[3] == ("open", 3), "an open breaker lets nothing through"
    assert got[4] == ("closed", 0), "61 seconds after the last failure it is tried, and closes"
    assert got[7] == ("open", 3) and got[8] == ("open", 4), "a failed trial opens it again"
    assert got[9] == ("open", 4) and got[10] == ("closed", 0)


@pytest.mark.parametrize("seed", [1, 2])
def test_event_time_breaker(spark, tmp_path, seed):
    """Files in any order, with a stop in the middle, give what the events in order of time give."""
    rng = random.Random(seed)
    events = [(rng.choice("ab"), k, rng.randrange(0, 1200) * 500_000, rng.random() < 0.6) for k in range(160)]
    want = {}
    for key in "ab":
        state, streak, last = "closed", 0, 0
        for _, i, us, bad in sorted((e for e in events if e[0] == key), key=lambda e: (e[2], e[1])):
            state, streak, last = L.breaker_step(state, streak, last, us, bad)
            want[i] = (state, streak)
    assert {s for s, _ in want.values()} == {"open", "closed"}
    rng.shuffle(events)
    (tmp_path / "in").mkdir()
    schema = "k string, id long, us long, failed boolean"

    def put(name, rows):
        (tmp_path / f"in/{name}.json").write_text("\n".join(json.dumps(dict(zip(("k", "id", "us", "failed"), r, strict=True))) for r in rows))

    def go():
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).json(str(tmp_path / "in")).withColumn("ts", F.timestamp_micros("us"))
        old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", B.ROCKSDB)
        try:
            out = B.event_time_breaker(src, "k", "id", "ts", "failed", "20 minutes")
            q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            q.awaitTermination()
        finally:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
        return {r.id: (r.state, r.streak) for r in spark.read.schema("key string, id long, state string, streak int").parquet(str(tmp_path / "out")).collect()}

    for k in range(4):
        put(f"first{k}", [*events[20 * k : 20 * k + 20], (None, 1, 5, True), ("a", None, 5, True)])
    assert go() == {}  # the watermark has passed none of them yet
    for k in range(4):
        put(f"second{k}", events[80 + 20 * k : 100 + 20 * k])
    put("tick", [("tick", -1, 90_000_000_000, False)])
    go()
    put("late", [("a", 999, 1, True), ("tick", -2, 95_000_000_000, False)])
    got = go()
    assert got.pop(-1, ("closed", 0)) == ("closed", 0)
    assert got == want


def test_window_stream(spark, tmp_path):
    rows = [{"k": "a", "ts": f"2024-01-01T00:00:{s:02d}Z", "id": s, "v": 2.5} for s in (1, 5, 5, 40)]
    src = stream(spark, tmp_path, rows, "k string, ts timestamp, id long, v double")
    got = drain(L.requests_per_window(src, "k", "ts", "60 seconds", "60 seconds"), "windows", "complete")
    assert [(r.k, r.n) for r in got] == [("a", 4)]
    budget = drain(L.running_budget(src, "k", "v", 9), "budget", "complete")
    assert [(float(r.spent), r.exceeded) for r in budget] == [(10.0, True)]
    assert len(drain(L.once(src, "id", "ts"), "once", "append")) == 3


def test_session_stream(spark, tmp_path):
    rows = [{"k": "a", "ts": f"2024-01-01T{h}:00:00Z"} for h in ("00", "03")]
    src = stream(spark, tmp_path, rows, "k string, ts timestamp")
    assert len(drain(L.sessions(src, "k", "ts"), "sessions", "complete")) == 2


def test_fan_out(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, "{}")], "id long, state string")
    assert {tuple(r) for r in L.fan_out(df, "id", "state").select("id", "key", F.col("value")).collect()} == {(1, "a", "1"), (1, "b", "x")}


def test_breaker_packs_waiting_events():
    """A key's events of a micro-batch take one call of state and one entry; nothing is given out before they are due."""
    import pandas as pd

    class State:
        def __init__(self):
            self.values = []

        def get(self):
            return iter(self.values)

        def appendValue(self, value):
            self.values.append(value)

        def put(self, values):
            self.values = list(values)

        def clear(self):
            self.values = []

    class Value:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    class Handle:
        def __init__(self):
            self.timers = []

        def getListState(self, *_):
            return State()

        def getValueState(self, *_):
            return Value()

        def registerTimer(self, at):
            self.timers.append(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    handle, b = Handle(), B.EventTimeBreaker()
    b.init(handle)
    rng = random.Random(5)
    events = [(rng.randrange(0, 1200) * 500_000, k, rng.random() < 0.6) for k in range(300)]
    frame = lambda rows: pd.DataFrame(rows, columns=["at", "id", "failed"])
    assert list(b.handleInputRows(("a",), iter([frame(events[:100]), frame(events[100:200])]), At(0))) == []
    assert list(b.handleInputRows(("a",), iter([frame(events[200:]), frame([])]), At(0))) == []
    assert len(b.waiting.values) == 2 and handle.timers == [min(events)[0] // 1000 + 1]
    got = []
    for ms in (handle.timers[0], 300_000, 300_001, 10**9):
        if handle.timers:
            for out in b.handleExpiredTimer(("a",), At(ms), At(handle.timers.pop())):
                got += out.itertuples(index=False, name=None)
            assert len(b.waiting.values) <= 1
    state, want = ("closed", 0, 0), []
    for at, i, bad in sorted(events):
        state = L.breaker_step(*state, at, bad)
        want.append(("a", i, *state[:2]))
    assert got == want and b.waiting.values == [] and not handle.timers
