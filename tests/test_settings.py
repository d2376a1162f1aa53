"""Settings from YAML files, and recipes made of them."""

import pytest
from pyspark.sql import functions as F

from episodeframe.operators.contracts import RewardRecipe, shaped_reward
from episodeframe.sources import readers


def test_leaves_of_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("x: 1\ny:\n  z: [true, null, 2.5]\n  e: {}\n'n': ñ\n")
    (tmp_path / "b.txt").write_text("- no\n")
    got = sorted((r._file, r.key, r.value) for r in readers.yaml_settings(spark, str(tmp_path)).collect())
    assert got == [("a.yaml", "n", '"\\u00f1"'), ("a.yaml", "x", "1"), ("a.yaml", "y.e", "{}"), ("a.yaml", "y.z.0", "true"), ("a.yaml", "y.z.1", "null"), ("a.yaml", "y.z.2", "2.5")]
    assert readers.nested(readers.yaml_settings(spark, str(tmp_path)), "y") == {"a.yaml": {"z.0": True, "z.1": None, "z.2": 2.5, "e": {}}}


@pytest.mark.parametrize("text,told", [("[1, 2]", "no mapping"), ("a: [", "no YAML"), ("a.b: 1", "a point in key")])
def test_files_that_are_no_settings(spark, tmp_path, text, told):
    (tmp_path / "a.yaml").write_text(text)
    with pytest.raises(Exception, match=told):
        readers.yaml_settings(spark, str(tmp_path)).collect()


def test_recipes():
    assert RewardRecipe.of({}) == RewardRecipe() and RewardRecipe.of({"ghost": 5, "use_base": False}).ghost == 5
    for wrong, told in (({"gost": 1}, "unknown coefficients: gost"), ({"step": float("nan")}, "step is nan"), ({"use_base": 1}, "use_base is 1"), ({"wall": True}, "wall is True"), ({"fruit": "2"}, "fruit is '2'")):
        with pytest.raises(ValueError, match=told):
            RewardRecipe.of(wrong)


def test_terms_of_a_step(spark):
    rows = spark.createDataFrame([(10.0, 1, False, True, 6, 4, 0.5, 0.75), (0.0, 0, True, False, 6, 4, 0.5, 1.0), (0.0, 0, False, False, None, 4, 0.5, 1.0)], "base double, ate int, dead boolean, wall boolean, b int, a int, ratio double, was double")
    none = {n: F.lit(0) for n in RewardRecipe.counted}
    told = lambda recipe, **k: [round(r[0], 9) for r in rows.select(shaped_reward(recipe, base=F.col("base"), counts=none | {"normal_pellet": F.col("ate")}, completed=F.lit(False), death=F.col("dead"), wall=F.col("wall"), before=F.col("b"), after=F.col("a"), ratio=F.col("ratio"), **k)["shaped"]).collect()]
    assert told(RewardRecipe()) == [8.0, -1.0, -1.0]
    recipe = RewardRecipe(normal_pellet=3, death=100, step=0.5, step_cleared=2, use_base=False, alpha=0.5, threshold=0.5, by_cleared=True, skip_on_eat=True)
    assert told(recipe) == [3 - 1 - 0.5 - 1, -100 - 0.5 - 1 + 0.5, -0.5 - 1]
    assert told(recipe, ratio_before=F.col("was")) == [3 - 1 - 0.5 - 0.5, -100 - 0.5 + 0.5, -0.5]
    with pytest.raises(Exception, match="not in"):
        rows.select(shaped_reward(recipe, base=F.lit(0.0), counts=none, completed=F.lit(False), death=F.lit(False), wall=F.lit(False), before=F.col("b"), after=F.col("a"), ratio=F.col("ratio") + 1)["shaped"]).collect()
