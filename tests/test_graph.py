"""Grades of evidence: how it is dealt over tasks."""

from millrace.operators import graph
from millrace.plans import stores

SF = "/root/testdata/sf0.001"


def test_tasks_grow_with_the_evidence_and_grades_do_not_change(spark, monkeypatch):
    evidence = stores.evidence(spark, SF)
    whole = sorted(map(tuple, graph.full_grades(evidence).drop("reason").collect()))
    monkeypatch.setattr(graph, "PART_ROWS", 20, raising=False)
    found = graph.full_grades(evidence)
    parts = -(-evidence.count() // 20)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert parts > 8 and plan.count("RepartitionByExpression [asset_id#") == plan.count(f", {parts}\n") > 0
    assert sorted(map(tuple, found.drop("reason").collect())) == whole
