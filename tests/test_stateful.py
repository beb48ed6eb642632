"""Streams with state: what is new across restarts and within bounds, and the queue in which the latest content wins."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leakloom.operators import findings
from leakloom.plans import steps
from leakloom.streaming import stateful


@pytest.fixture
def feed(spark, tmp_path):
    """Writes rows as a file that a stream reads next; runs a query over all that has come."""
    folder, seen = tmp_path / "in", []
    folder.mkdir()

    def write(rows):
        path = folder / f"{len(seen):03}.json"
        path.write_text("\n".join(map(json.dumps, rows)))
        os.utime(path, (1_700_000_000 + len(seen),) * 2)  # files are read in the order of their times
        seen.append(rows)

    def run(build, schema, out):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
        query = build(stream).writeStream.format("parquet").option("path", str(tmp_path / out)).option("checkpointLocation", str(tmp_path / f"{out}-checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert not query.isActive and query.exception() is None
        return spark.read.parquet(str(tmp_path / out)).collect()

    return write, run


HIT = "rule_id string, secret string, place long"


def test_only_new_findings_pass_also_after_a_restart(feed):
    write, run = feed
    write([{"rule_id": r, "secret": s, "place": i} for i, (r, s) in enumerate([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("a", None), ("a", None)])])
    build = lambda s: stateful.first_seen(s, buckets=4)
    assert sorted((r.rule_id, r.secret or "") for r in run(build, HIT, "out")) == [("a", ""), ("a", "x"), ("a", "y"), ("b", "x")]
    write([{"rule_id": "a", "secret": "x", "place": 9}, {"rule_id": "c", "secret": "x", "place": 10}])
    assert sorted((r.rule_id, r.secret or "") for r in run(build, HIT, "out")) == [("a", ""), ("a", "x"), ("a", "y"), ("b", "x"), ("c", "x")]


def test_state_is_bounded_and_the_oldest_go_first(feed):
    write, run = feed
    for k in range(4):
        write([{"rule_id": "a", "secret": f"s{i}", "place": i} for i in range(10 * k, 10 * k + 10)])
    write([{"rule_id": "a", "secret": "s39", "place": 1}, {"rule_id": "a", "secret": "s0", "place": 2}])
    got = [r.secret for r in run(lambda s: stateful.first_seen(s, most=20, buckets=1), HIT, "out")]
    assert got.count("s39") == 1 and got.count("s0") == 2 and len(got) == 41  # the newest is still known, the oldest is not


def test_pages_are_processed_again_only_with_other_content(feed):
    write, run = feed
    write([{"source": "u", "content": "1"}, {"source": "u", "content": "1"}, {"source": "v", "content": None}])
    write([{"source": "u", "content": "2"}, {"source": "u", "content": "1"}, {"source": "v", "content": ""}])
    rows = run(lambda s: stateful.unprocessed(s, buckets=2), "source string, content string", "out")
    assert sorted((r.source, r.content or "") for r in rows) == [("u", "1"), ("u", "2"), ("v", "")]


def test_the_queue_releases_the_latest_content_in_batches_of_ten(spark, feed):
    write, run = feed
    rows = [{"source": f"u{i % 23}", "content": f"c{i}", "at": f"2024-01-01T00:00:{i % 5:02}Z"} for i in range(60)]
    for k in (0, 20, 40):
        write(rows[k : k + 20])
    write([{"source": "late", "content": "x", "at": "2024-01-01T00:10:00Z"}, {"source": None, "content": "x", "at": None}])
    write([{"source": "later", "content": "x", "at": "2024-01-01T00:20:00Z"}])
    got = run(lambda s: stateful.latest_batches(s, "at", buckets=1), "source string, content string, at timestamp", "out")
    df = spark.createDataFrame(rows).withColumn("at", F.col("at").cast("timestamp"))
    newest = df.groupBy("source").agg(F.max("at").alias("at"))
    allowed = {(r.source, r.content) for r in df.join(newest, ["source", "at"]).collect()}
    first = [r for r in got if r.source not in ("late", "later")]
    assert sorted(r.source for r in first) == sorted({r["source"] for r in rows}) and {(r.source, r.content) for r in first} <= allowed
    sizes = {b: sum(r.batch == b for r in first) for b in {r.batch for r in first}}
    assert sorted(sizes.values()) == [3, 10, 10] and "late" in {r.source for r in got}
    latest = findings.latest(df.withColumn("at", F.struct("at", "content")), ["source"], "at")
    assert {r.source for r in latest.collect()} == {r.source for r in first}


def test_each_pair_passes_once_however_many_there_are(spark, tmp_path):
    """More pairs than bounded buckets remember, and all of them again in a later micro-batch; a null is a user too."""
    user = F.when(F.col("id") > 0, F.col("id")).alias("user_id")
    for i, part in enumerate(("a", "b", "c", "d", "e", "f")):
        spark.range(100_000).select(user, F.lit("view").alias("event_type")).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
        for x in set((tmp_path / "events.parquet").glob("part-*.parquet")):
            if not x.stem.startswith("part-z"):
                x.rename(x.with_name(f"part-z{part}.parquet"))
                os.utime(x.with_name(f"part-z{part}.parquet"), (1_700_000_000 + i,) * 2)
    n = steps.streamed_new_pairs(spark, str(tmp_path)).agg(F.count("*").alias("pairs"), F.max("n").alias("most")).first()
    assert (n.pairs, n.most) == (100_000, 1)


def test_a_bucket_calls_its_store_twice_a_batch_whatever_its_keys():
    """Calls to the store are counted, and the clock is ours: keys whose time has ended are new again."""
    calls, now = [], [0]

    class Held:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    class Handle:
        def getValueState(self, *_):
            return Held()

    class Clock:
        def getCurrentProcessingTimeInMs(self):
            return now[0]

    for ttl, again in ((None, 0), (100, 500)):
        seen = stateful.FirstSeen(["place"], 2000, ttl)
        seen.init(Handle())

        def passed(places):
            keys = [i.to_bytes(stateful.KEY_BYTES, "big") for i in places]
            return sum(map(len, seen.handleInputRows((0,), iter([pd.DataFrame({"place": places, "key": keys})]), Clock())))

        now[0] = 0
        assert passed([*range(500), *range(500)]) == 500
        now[0] = 60
        calls.clear()
        assert passed(range(1000)) == 500 and calls == ["get", "update"]
        now[0] = 110  # the first 500 have ended, the others have not
        assert passed(range(1000)) == again
