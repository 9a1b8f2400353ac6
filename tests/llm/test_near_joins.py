"""The joins of the near groups send no table of fingerprints through the driver."""

import pytest

from convolens.llm import components as C
from convolens.llm import simhash
from convolens.llm.common import staged
from convolens.llm.simhash import links, near_groups, one_per_group


def joins(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("Initial Plan")[0]


def test_probes_are_not_broadcast(spark):
    fps = staged(spark.range(500).selectExpr("id * 7 as fp", "id as first"), "fps")  # a small file, 66 probes a row
    pairs = links(fps, 3)
    plan = joins(pairs)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    want = {(7 * a, 7 * b) for a in range(500) for b in range(a + 1, 500) if bin((7 * a) ^ (7 * b)).count("1") <= 3}
    assert {(r.u, r.v) for r in pairs.collect()} == want


def recorded(monkeypatch, module):
    """The plans of the tables that the module writes, by name."""
    plans = []

    def write(df, name, *args):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return staged(df, name, *args)

    monkeypatch.setattr(module, "staged", write)
    return plans


def test_tables_of_fingerprints_are_not_broadcast(spark, monkeypatch):
    plans = recorded(monkeypatch, simhash)
    docs = spark.createDataFrame([(i, f"a b c d{i % 40}") for i in range(200)], "doc_id long, text string")
    groups = near_groups(docs)
    assert "Broadcast" not in joins(groups) and groups.count() == 200
    of_labels = [p for name, p in plans if name == "simhash-labels"]
    assert of_labels and "SortMergeJoin" in of_labels[0] and "Broadcast" not in of_labels[0]
    assert one_per_group(docs).count() == groups.select("component_id").distinct().count()


@pytest.mark.parametrize("sent", [0, 10, 10_000])
def test_picks_are_broadcast_in_small_rounds_only(spark, monkeypatch, sent):
    plans = recorded(monkeypatch, C)
    monkeypatch.setattr(C, "SENT", sent)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(None, 7), (9, 9)]
    sets = {}
    for r in C.components(spark.createDataFrame(pairs, "u long, v long")).collect():
        sets.setdefault(r.component, set()).add(r.node)
    assert sorted(map(sorted, sets.values())) == [list(range(41)), list(range(100, 140))]
    rounds = ["Broadcast" in p for name, p in plans if name == "edges" and "Join" in p]
    assert rounds == sorted(rounds) and rounds[0] == (sent > 79) and (sent > 0 or not any(rounds))
