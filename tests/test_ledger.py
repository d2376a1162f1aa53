"""The ledger of a stream's batches."""

import pytest

from episodeframe.sources import sinks


def test_replays_and_a_batch_without_entry(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n long, s string")
    ledger = sinks.Ledger(str(tmp_path / "l"))
    assert ledger.committed(spark, df.schema).collect() == []
    ledger(df, 0)
    ledger(df.where("n = 2"), 0)  # a replay, even with other rows
    stop = sinks.Ledger(str(tmp_path / "l"), before_entry=lambda _: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        stop(df.where("n = 1"), 1)
    assert sorted(map(tuple, ledger.committed(spark, df.schema).collect())) == [(0, 1, "a"), (0, 2, "b")]
    ledger(df.where("n = 2"), 1)
    assert sorted(map(tuple, ledger.committed(spark, df.schema).collect())) == [(0, 1, "a"), (0, 2, "b"), (1, 2, "b")]
    assert sorted(r.batch for r in ledger.batches(spark).collect()) == [0, 1]


def test_of_two_writers_of_a_batch_one_fails(spark, tmp_path):
    df = spark.range(3)
    ledger = sinks.Ledger(str(tmp_path / "l"))
    with pytest.raises(Exception, match="already exists"):
        sinks.Ledger(str(tmp_path / "l"), before_entry=lambda n: ledger(df, n))(df, 4)
    assert ledger.committed(spark, df.schema).count() == 3
