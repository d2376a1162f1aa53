"""A bank without a cap, dealt to many keys, against the batch operator and the capped bank's replays."""

import random

from episodeframe.operators import banks as batch
from episodeframe.streaming import banks


def test_a_bank_of_any_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(banks, "SLOTS", 5)
    rng, big = random.Random(4), 2**60 + 1
    rows = sorted({(t, u, big + t * 100 + rng.randrange(30), 4) for t in (0, 1, 2) for u in range(8) if (t, u) != (2, 5) for _ in range(5)})
    frame = lambda part: spark.createDataFrame(list(part), "tier long, update long, id long, lookback long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for us in ((0,), (1, 2, 3), (3, 4), (5, 6, 7)):  # update 3 comes twice
            frame(r for r in rows if r[1] in us).write.mode("append").parquet(str(tmp_path / "in"))
            stream = banks.refreshed_stream(spark.readStream.schema(frame(rows).schema).parquet(str(tmp_path / "in")), max_age=2, cap=None)
            q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination(200)
            assert q.exception() is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = [tuple(r) for r in spark.read.schema("tier long, update long, id long, lookback long, admitted long").parquet(str(tmp_path / "out")).collect()]
    want, held = set(), {}
    for u in range(8):
        held |= {r[2]: (r[0], r[3], u) for r in rows if r[1] == u}
        touched = {r[0] for r in rows if r[1] == u}
        want |= {(t, u, i, look, at) for i, (t, look, at) in held.items() if t in touched and at >= u - 2}
    assert set(got) == want and len(got) == len(want)
    bank = spark.createDataFrame([(i, t, look, at) for i, (t, look, at) in held.items() if at < 7], "id long, tier long, lookback long, admitted long")
    kept = batch.refreshed(bank, frame(r for r in rows if r[1] == 7).select("id", "tier", "lookback"), 7, max_age=2, cap=10**6)
    assert {(r.tier, 7, r.id, r.lookback, r.admitted) for r in kept.collect()} == {w for w in want if w[1] == 7}
