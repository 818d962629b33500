"""The physical plan as rows (id, parent, notused, detail)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def explain_rows(df: DataFrame) -> list[dict]:
    """Nodes of the executed plan in reading order; parent 0 is the top's."""
    node = df._jdf.queryExecution().executedPlan()
    rows: list[dict] = []

    def walk(plan, parent: int) -> None:
        rows.append({"id": len(rows) + 1, "parent": parent, "notused": 0, "detail": plan.simpleString(1000)})
        own = len(rows)
        children = plan.children()
        for i in range(children.size()):
            walk(children.apply(i), own)
        if not children.size() and plan.nodeName() == "AdaptiveSparkPlan":
            walk(plan.initialPlan(), own)

    walk(node, 0)
    return rows
