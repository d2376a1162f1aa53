"""Journals written by tasks, line by line."""

import random

from pyspark.sql import functions as F

from episodeframe.sources import growing, sinks


def test_files_of_lines_in_order(spark):
    path = sinks.shared_path(spark, "journals")
    rows = [(f"{i % 3}.jsonl", i, f"é{i}") for i in range(25_000)] + [("1.jsonl", 10_000, "END")]
    random.Random(8).shuffle(rows)
    frame = spark.createDataFrame(rows, "name string, at long, line string").repartition(7)
    for upto, rest in ((9_000, '{"half'), (25_000, "")):
        growing.rewrite(frame.where(F.col("at") < upto), path, [F.col("at"), F.col("line") == "END"], rest)
        for name in ("0.jsonl", "1.jsonl", "2.jsonl"):
            system, root = growing.opened(path)
            with system.open_input_file(f"{root}/{name}") as f:
                got = f.read().decode()
            own = sorted((r for r in rows if r[0] == name and r[1] < upto), key=lambda r: (r[1], r[2] == "END"))
            assert got == "".join(r[2] + "\n" for r in own) + rest
    found = growing.complete_lines(spark, path, stream=False)
    assert found.where("closed").count() == 1 and found.where("file = '1.jsonl'").count() == 3334 + 1
    growing.rewrite(frame.where("false"), path, [F.col("at")])  # nothing to write is no error
