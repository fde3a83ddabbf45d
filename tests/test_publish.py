"""Published section sets: readers see one whole build, the old one if a new one fails."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from storelens.sources import sinks


@pytest.fixture
def base():
    return os.path.join(tempfile.mkdtemp(prefix="storelens-test-"), "out")


def sections(spark, n):
    return {"a": spark.range(n), "b": spark.range(2 * n).withColumn("texto", F.lit("ação\nlinha")), "vazio": spark.range(0)}


def test_nothing_published(spark, base):
    assert sinks.published(spark, base) is None
    with pytest.raises(KeyError):
        sinks.read_section(spark, base, "a")


def test_publish_and_read(spark, base):
    made = sinks.publish_sections(sections(spark, 3), base)
    assert made["number"] == 1 and {n: s["rows"] for n, s in made["sections"].items()} == {"a": 3, "b": 6, "vazio": 0}
    assert sinks.published(spark, base) == made
    assert sorted(r.id for r in sinks.read_section(spark, base, "a").collect()) == [0, 1, 2]
    assert {r.texto for r in sinks.read_section(spark, base, "b").collect()} == {"ação\nlinha"}
    with pytest.raises(KeyError):
        sinks.read_section(spark, base, "c")


def test_a_failing_build_leaves_the_old_set(spark, base):
    old = sinks.publish_sections(sections(spark, 2), base)
    broken = {**sections(spark, 9), "z": spark.range(1).select(F.raise_error(F.lit("stop")).alias("x"))}
    with pytest.raises(Exception, match="stop"):
        sinks.publish_sections(broken, base)
    assert sinks.published(spark, base) == old
    assert sinks.read_section(spark, base, "a").count() == 2
    assert os.listdir(os.path.join(base, sinks.BUILDS)) == [old["build"]]


def test_a_build_in_the_making_is_unseen(spark, base, monkeypatch):
    """While the second build is written, and until its manifest appears, readers get the first."""
    old = sinks.publish_sections(sections(spark, 2), base)
    seen = []
    commit = sinks._commit

    def look_first(*args):
        seen.append((sinks.published(spark, base), sinks.read_section(spark, base, "a").count()))
        return commit(*args)

    monkeypatch.setattr(sinks, "_commit", look_first)
    new = sinks.publish_sections(sections(spark, 5), base)
    assert seen == [(old, 2)] and new["number"] == 2
    assert sinks.read_section(spark, base, "a").count() == 5
    assert sinks.read_section(spark, base, "a", old).count() == 2  # a reader that holds the old manifest goes on with it


def test_a_taken_number_is_passed_over(spark, base):
    sinks.publish_sections(sections(spark, 1), base)
    open(os.path.join(base, sinks.MANIFESTS, "00000002.claim"), "w").close()  # another publisher is at work, or failed
    assert sinks.publish_sections(sections(spark, 4), base)["number"] == 3
    assert sinks.published(spark, base)["sections"]["a"]["rows"] == 4


def test_old_builds_go(spark, base):
    made = [sinks.publish_sections({"a": spark.range(i)}, base) for i in range(1, 4)]
    assert sinks.remove_old_builds(spark, base, keep=2) == [made[0]["build"]]
    assert sorted(os.listdir(os.path.join(base, sinks.BUILDS))) == sorted(m["build"] for m in made[1:])
    assert sinks.read_section(spark, base, "a").count() == 3
    with pytest.raises(ValueError):
        sinks.remove_old_builds(spark, base, keep=0)


@pytest.mark.parametrize("names", [[], ["a/b"], ["_a"], [""]])
def test_section_names(spark, base, names):
    with pytest.raises(ValueError):
        sinks.publish_sections({n: spark.range(1) for n in names}, base)
