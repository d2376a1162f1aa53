"""A staged table leaves no shuffle files behind; lists of buckets go out only as far as a row needs them."""

import time

from pyspark.sql import functions as F

from episodeframe.llm import common, partenum


def test_shuffle_files_go_with_the_write(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before, conf, until = files(), spark.conf.get(common.CLEANUP, None), time.time() + 5
    counted = common.stage(spark.range(5000).groupBy((F.col("id") % 50).alias("k")).count(), "test-files")
    while files() - before and time.time() < until:  # they are removed in the background
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(common.CLEANUP, None) == conf
    assert counted.count() == 50 and counted.agg(F.sum("count")).first()[0] == 5000
    common.unstage(counted)


def test_lists_hold_the_buckets_below_a_row(spark):
    rows = [(s, n) for n in (1, 2, 3) for s in (1 << 47, 5, 300, (1 << 33) + n, 7) if s % (n + 1)]
    members = spark.createDataFrame(rows, "sig long, node long")
    found = partenum.lists_below(members).collect()
    assert len(found) == len(rows)
    for r in found:
        assert partenum.unpacked_signatures(r.buckets).tolist() == sorted(s for s, n in rows if n == r.node and s < r.sig)
