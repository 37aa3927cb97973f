"""Admission, assignment and block intervals against brute force, and the streamed form across a restart."""

import hashlib
import random
from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import admission, assignment, resampling

START = datetime(2024, 3, 1, 9, 30)


def journal(seed: int = 5, n: int = 400):
    r = random.Random(seed)
    rows = [("a", START, 0, "DESIGN", None, None, None, None, None), ("b", START + timedelta(minutes=30), 1, "DESIGN", None, None, None, None, None), ("b", START + timedelta(hours=1), 2, "DESIGN", None, None, None, None, None)]
    for k in range(n):
        book, did = r.choice(["a", "a", "a", "b", "c"]), f"d{r.randint(0, 120)}"
        decided = START + timedelta(seconds=r.randint(-600, 20_000))
        leave = decided + timedelta(seconds=r.choice([30, 60, 900, 4000]))
        received = decided + timedelta(seconds=r.choice([0, 5, 120, 121, -1]))
        risk = r.choice([500, 2500, 4000, 0, None, -3])
        rows.append((book, received, 10 + k, "ADMIT", did, decided, leave, r.choice([None, leave, decided]), risk))
        if r.random() < 0.6:
            rows.append((book, leave + timedelta(seconds=r.choice([0, 120, 121, -5])), 10_000 + k, "EXIT", did, None, None, None, None))
    early = START + timedelta(minutes=30)
    return rows + [("a", START, 99_999, "ADMIT", None, START, START, None, 5), ("b", early + timedelta(seconds=10), 99_998, "ADMIT", "early", early - timedelta(seconds=10), early + timedelta(hours=1), None, 5)]


def sequential(rows, budget):
    """The rules said again, over plain lists."""
    verdicts, registered, held, done = {}, {}, defaultdict(dict), defaultdict(set)
    for book, received, seq, kind, did, decided, leave, expires, risk in sorted(rows, key=lambda x: (x[0], x[1], x[2])):
        mine = held[book]
        before = sum(v[2] for k, v in mine.items() if k != did)
        late = lambda a, b: not 0 <= (a - b).total_seconds() <= 120
        if kind == "DESIGN":
            v = "REPLAY" if book in registered else "REGISTERED"
            registered.setdefault(book, received)
        elif kind == "EXIT":
            v = "REPLAY" if did in done[book] else "UNKNOWN" if did not in mine else "LATE" if late(received, mine[did][1]) else "CLOSED_NOW"
            if v == "CLOSED_NOW":
                del mine[did]
                done[book].add(did)
        elif did is None or risk is None or risk <= 0:
            v = "INVALID"
        elif book not in registered:
            v = "NO_DESIGN"
        elif late(received, decided):
            v = "UNTIMELY"
        elif leave < decided + timedelta(seconds=60) or (expires and leave > expires):
            v = "BAD_EXIT"
        elif decided < registered[book]:
            v = "UNREGISTERED"
        elif did in done[book]:
            v = "CLOSED"
        elif did in mine:
            v = "REPLAY" if mine[did] == (decided, leave, risk) else "REWRITTEN"
        else:
            v = "EXHAUSTED" if before >= budget else "OVER_BUDGET" if before + risk > budget else "ADMITTED"
            if v == "ADMITTED":
                mine[did] = (decided, leave, risk)
        verdicts[book, seq] = (v, before)
    return verdicts, held


def test_admissions_equal_a_sequential_book(spark):
    rows = journal()
    events = spark.createDataFrame(rows, admission.EVENTS)
    want, held = sequential(rows, 10_000)
    assert {"ADMITTED", "OVER_BUDGET", "CLOSED", "REWRITTEN", "LATE", "CLOSED_NOW", "UNTIMELY", "BAD_EXIT", "NO_DESIGN", "UNREGISTERED", "INVALID"} <= {v for v, _ in want.values()}
    verdicts = admission.admissions(events)
    assert {(r.book, r.seq): (r.verdict, r.open_risk) for r in verdicts.collect()} == want
    now = START + timedelta(seconds=9000)
    got = {(r.book, r.decision_id): r.due for r in admission.due(events, verdicts, now).collect()}
    assert got == {(b, d): t[1] <= now for b, mine in held.items() for d, t in mine.items()}
    assert admission.admissions(events.limit(0)).count() == 0
    assert {r.verdict for r in admission.admissions(spark.createDataFrame([(None, START, 1, "ADMIT", "x", START, START + timedelta(hours=1), None, 5)], admission.EVENTS)).collect()} == {"NO_DESIGN"}


def test_exhausted_budget(spark):
    ask = lambda k, risk: ("a", START + timedelta(seconds=k), k, "ADMIT", f"d{k}", START + timedelta(seconds=k), START + timedelta(hours=1), None, risk)
    events = spark.createDataFrame([("a", START, 0, "DESIGN", None, None, None, None, None), ask(1, 100), ask(2, 1)], admission.EVENTS)
    assert [r.verdict for r in admission.admissions(events, 100).orderBy("seq").collect()] == ["REGISTERED", "ADMITTED", "EXHAUSTED"]


def test_streamed_admissions_survive_a_restart(spark, tmp_path):
    rows = sorted(journal(8, 150), key=lambda x: (x[1], x[2]))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for part in (rows[:90], rows[90:]):  # two runs of the query; the second begins from the first one's checkpoint
            spark.createDataFrame(part, admission.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(admission.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            run = admission.streaming_admissions(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
            assert run.awaitTermination(180) and run.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = {(r.book, r.seq): (r.verdict, r.open_risk) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == sequential(rows, 10_000)[0]


def test_greedy_assignment(spark):
    r = random.Random(2)
    rows = [(k, r.choice([None, r.randint(0, 30), r.randint(0, 12)])) for k in [None, *range(40)] for _ in range(r.choice([0, 1, 2, 5, 30]))]
    targets, want = [7, 14, 7, 21], set()
    for key in {k for k, _ in rows}:
        free = {v for k, v in rows if k == key and v is not None}
        for turn, t in enumerate(targets, 1):
            if free:
                best = min(free, key=lambda v: (abs(v - t), v))
                free.remove(best)
                want.add((key, turn, t, best))
    out = assignment.nearest_without_replacement(spark.createDataFrame(rows, "k int, v int"), ["k"], "v", targets).collect()
    assert len(out) == len(want) and {tuple(x) for x in out} == want


def test_block_intervals(spark):
    r = random.Random(4)
    rows = [(k, b, r.choice([None, round(r.gauss(3, 9), 3)])) for k in "xy" for b in range(3 if k == "y" else 11) for _ in range(r.randint(1, 6))] + [("z", 0, None)]
    df = spark.createDataFrame(rows, "k string, b int, v double")
    out = {x.k: x for x in resampling.block_bootstrap(df, ["k"], F.col("b"), F.col("v"), repetitions=200, seed=9, rule="rank_of_n_less_one", least_blocks=5).collect()}
    digest = lambda s, n: int(hashlib.md5(s.encode()).hexdigest()[:n], 16)
    for key in "xy":
        sums = defaultdict(list)
        for k, b, v in rows:
            if k == key and v is not None:
                sums[b].append(v)
        blocks = [sums[b] for b in sorted(sums, key=lambda b: (digest(str(b), 4) % 64, hashlib.md5(str(b).encode()).hexdigest()))]
        n, means = len(blocks), []
        for rep in range(200):
            drawn = [blocks[digest(f"9:{rep}:{slot}", 8) % n] for slot in range(n)]
            means.append(sum(map(sum, drawn)) / sum(map(len, drawn)))
        means.sort()
        x = out[key]
        assert x.blocks == n and x.n == sum(map(len, blocks)) and abs(x.mean - sum(map(sum, blocks)) / x.n) < 1e-9
        assert (x.low, x.high) == (None, None) if n < 5 else abs(x.low - means[int(0.025 * 199)]) < 1e-9 and abs(x.high - means[int(0.975 * 199)]) < 1e-9
    assert set(out) == {"x", "y"}
