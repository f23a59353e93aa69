"""Components: right on graphs with repeats, loops and nulls, and with few tasks, each of which costs the driver memory."""

import random

import pytest

from lumafind.llm.components import components


def brute(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in links:
        if u is not None and v is not None and u != v:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_loops_and_nulls(spark, seed):
    draw = random.Random(seed)
    links = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)]
    links += [(v, u) for u, v in links[:80]] + links[:40] + [(7, 7), (900, 900), (None, 3), (4, None), (None, None)]
    found = components(spark.createDataFrame(links, "u long, v long")).collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.component for r in found} == brute(links)


def test_tasks_of_a_hub(spark):
    """A star is done in one round: five shuffles, and one to see that it is done."""
    context, tracker, name = spark.sparkContext, spark.sparkContext.statusTracker(), "components-of-a-hub"
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    links = spark.range(1, 2000).selectExpr("0L as u", "id as v").repartition(2)
    try:
        for k, v in zip(before, ("20", "false")):
            spark.conf.set(k, v)
        context.setJobGroup(name, name)
        found = components(links)
        stages = {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(x.numTasks for x in map(tracker.getStageInfo, stages) if x and x.numCompletedTasks)
        assert tasks <= 200
        assert found.count() == 2000 and found.filter("component <> 0").isEmpty()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
