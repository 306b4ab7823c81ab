"""What stages and the pipeline leave in the shared folder."""

import os

import corpus_pipeline
import pytest
from tideglass.llm.shared import Stage, keep, shared_dir


def names(spark, before=()):
    return sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(shared_dir(spark))) - set(before))


def test_the_pipeline_leaves_its_result_and_files(spark):
    before = os.listdir(shared_dir(spark))
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert names(spark, before) == ["token-documents", "token-ids"]


def test_a_stage_owns_nested_tables_and_those_of_a_failure(spark):
    before = os.listdir(shared_dir(spark))
    with Stage(spark) as outer:
        keep(spark.range(3), "a")
        with Stage(spark) as inner:
            out = inner.outlive(keep(spark.range(4), "b"), "c")
        assert out.count() == 4 and names(spark, before) == ["a", "c"]
        out = outer.outlive(out, "d")
    assert out.count() == 4 and names(spark, before) == ["d"]
    with pytest.raises(ValueError), Stage(spark):
        keep(spark.range(1), "e")
        raise ValueError
    keep(spark.range(1), "f")
    assert names(spark, before) == ["d", "f"]
