"""Steps of a run are delivered once each, in order, whatever fails between."""

import pytest

from tideglass.plans import registry
from tideglass.streaming.steps import Replay

SF = "/root/testdata/sf0.001"


def test_each_step_is_delivered_once(spark, tmp_path):
    info = registry.QUERIES["wf_step_info"](spark, SF)
    info = spark.createDataFrame(info.collect(), info.schema)
    n, seen = info.count(), []
    replay = Replay(spark, f"{tmp_path}/run")
    replay.add(info.where("step < 4"))

    def fails(row):
        if row["step"] == 2 and not seen[2:]:
            seen.append(-1)
            raise RuntimeError("down")
        seen.append(row["step"])

    with pytest.raises(Exception, match="down"):
        replay.run(info.schema, fails)
    assert seen == [0, 1, -1]
    assert replay.run(info.schema, fails) == 2 and seen == [0, 1, -1, 2, 3]
    assert replay.run(info.schema, fails) == 0
    replay.add(info)  # the steps that are there come again, others are new
    again = Replay(spark, f"{tmp_path}/run")
    assert again.run(info.schema, fails) == n - 4 and seen[3:] == list(range(2, n))
    # a stream that lost its checkpoint delivers nothing twice
    (tmp_path / "run" / "at").rename(tmp_path / "lost")
    assert again.run(info.schema, fails) == 0
    assert sorted(map(tuple, again.log(info.schema, list(range(n))).collect())) == sorted(map(tuple, info.collect()))
