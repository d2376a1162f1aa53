"""Banks as streams against the batch operators after each update."""

import random

import pytest
from pyspark.sql import functions as F

from episodeframe.operators import banks as batch
from episodeframe.streaming import banks


@pytest.fixture
def streamed(spark, tmp_path):
    """Runs a stream over files in turn, each part a batch, and gives what came out."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def run(parts, operator, name):
        for part in parts:
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = operator(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
        return spark.table(name).collect()

    yield run
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_bank_with_a_time_to_live(spark, streamed):
    rng = random.Random(1)
    rows = [(t, u, i, 4 + i % 3) for t in (0, 1) for u in range(8) for i in (t * 100 + rng.randrange(12) for _ in range(5))]
    frame = lambda part: spark.createDataFrame(sorted(set(part)), "tier long, update long, id long, lookback long")
    got = streamed([frame(r for r in rows if r[1] in us) for us in ((0,), (1, 2, 3), (3, 4), (5, 6, 7))], lambda s: banks.refreshed_stream(s, max_age=3, cap=7), "aged")
    bank = spark.createDataFrame([], "id long, tier long, lookback long, admitted long")
    want = set()
    for u in range(8):
        kept = batch.refreshed(bank, frame(r for r in rows if r[1] == u).select("id", "tier", "lookback"), u, max_age=3, cap=7).collect()
        want |= {(r.tier, u, r.id, r.lookback, r.admitted, r.place) for r in kept}
        bank = spark.createDataFrame([(r.id, r.tier, r.lookback, r.admitted) for r in kept], bank.schema)
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_evictions(spark, streamed):
    rng = random.Random(2)
    schema = "bank long, update long, id long, bucket string, seed long, usage long, last_probe long"
    rows = [[(0, u, rng.randrange(40), f"b{rng.randrange(4)}", rng.randrange(3), rng.randrange(3), rng.randrange(9)) for _ in range(9)] for u in range(4)]
    rows = [list({r[2]: r for r in part}.values()) for part in rows]
    got = streamed([spark.createDataFrame(part, schema) for part in rows], lambda s: banks.evicted_stream(s, 3, 4), "evicted")
    bank, want = {}, set()
    for u, part in enumerate(rows):
        bank |= {r[2]: r[2:] for r in part}
        gone = batch.evicted(spark.createDataFrame(list(bank.values()), "state_id long, bucket string, seed long, usage long, last_probe long"), per_bucket=3, per_seed=4).collect()
        want |= {(0, u, r.state_id, r.reason) for r in gone}
        for r in gone:
            del bank[r.state_id]
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 4


def test_decisions_of_probes(spark, streamed):
    rng = random.Random(3)
    rows = [(s, n, rng.random() < (s % 5) / 4) for s in range(12) for n in range(24 if s % 4 else 8)]
    frame = lambda part: spark.createDataFrame(list(part), "state_id long, n long, won boolean")
    got = streamed([frame(r for r in rows if low <= r[1] < high) for low, high in ((0, 5), (3, 8), (8, 24))], banks.accepted_stream, "decided")
    table = batch.accepted(frame(rows)).where((F.col("probes") == 24) | ((F.col("probes") == 8) & F.col("wins").isin(0, 8)))
    assert {tuple(r) for r in got} == {tuple(r) for r in table.collect()} and len(got) == table.count()
