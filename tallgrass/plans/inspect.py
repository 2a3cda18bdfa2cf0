"""Plan trees, their explanation in words, and how alike two plans are."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession

#: What an operator does, by the start of its name.
WORDS = {
    "Scan": "reads a table", "FileScan": "reads files", "Filter": "keeps the rows that pass a predicate", "Project": "computes columns",
    "HashAggregate": "aggregates by hashing", "SortAggregate": "aggregates sorted rows", "ObjectHashAggregate": "aggregates by hashing",
    "Exchange": "redistributes rows between tasks", "BroadcastExchange": "sends a small side to all tasks", "BroadcastHashJoin": "joins with a broadcast side",
    "SortMergeJoin": "joins two sorted sides", "ShuffledHashJoin": "joins two shuffled sides by hashing", "BroadcastNestedLoopJoin": "compares every pair of rows",
    "Sort": "sorts", "TakeOrderedAndProject": "keeps the first rows of an order", "Window": "computes over windows", "Sample": "draws a sample", "Union": "puts inputs together",
    "GlobalLimit": "limits the rows", "LocalLimit": "limits the rows of a task", "Expand": "repeats rows for grouping sets", "Generate": "unfolds nested values",
}


def _name(node) -> str:
    return node.nodeName().split("(")[0].strip()


def _tree(node) -> dict:
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _tree(node.executedPlan())
    if kind == "WholeStageCodegenExec" or kind == "InputAdapter":
        return _tree(node.child())
    if kind.endswith("QueryStageExec"):
        return _tree(node.plan())
    output = node.output()
    children = node.children()
    metrics = node.metrics()
    rows = metrics.get("numOutputRows")
    return {
        "type": _name(node),
        "columns": [output.apply(i).name() for i in range(output.size())],
        "detail": re.sub(r"#\d+L?", "", node.simpleString(200)),
        "rows": rows.get().value() if rows.isDefined() else None,
        "children": [_tree(children.apply(i)) for i in range(children.size())],
    }


def plan_tree(df: DataFrame, run: bool = False) -> dict:
    """The physical plan as nested dicts; with ``run`` the query is executed first, so that row counts are real."""
    if run:
        df._jdf.queryExecution().executedPlan().executeCollect()
    return _tree(df._jdf.queryExecution().executedPlan())


def explain_tree(tree: dict, depth: int = 0) -> list[str]:
    """A line of English for each operator, inputs indented under it."""
    words = next((w for k, w in sorted(WORDS.items(), key=lambda x: -len(x[0])) if tree["type"].startswith(k)), "is another operator")
    rows = f" ({tree['rows']} rows)" if tree.get("rows") else ""
    return ["  " * depth + f"{tree['type']} {words}{rows}", *(line for c in tree["children"] for line in explain_tree(c, depth + 1))]


def get_plan(spark: SparkSession, sql: str, run: bool = True) -> dict:
    """Tree, explanation and Spark's own text; if running fails, the plan alone."""
    df = spark.sql(sql)
    try:
        tree = plan_tree(df, run)
    except Exception:
        if not run:
            raise
        tree = plan_tree(spark.sql(sql))
    return {"tree": tree, "explanation": explain_tree(tree), "text": df._jdf.queryExecution().toString()}


def _operators(tree: dict) -> Counter:
    found = Counter([f"{tree['type']}|{re.sub(r'[0-9]+', '', tree.get('detail', ''))}"])
    for child in tree["children"]:
        found += _operators(child)
    return found


def fingerprint(tree: dict) -> str:
    """Hash of what stays the same between runs: operators, columns and shape."""
    stable = lambda t: {"type": t["type"], "columns": t["columns"], "children": [stable(c) for c in t["children"]]}
    return hashlib.sha256(json.dumps(stable(tree), sort_keys=True).encode()).hexdigest()


def similarity(a: dict, b: dict) -> float:
    """1 for equal plans, else the Jaccard similarity of their operators as multisets."""
    if fingerprint(a) == fingerprint(b):
        return 1.0
    x, y = _operators(a), _operators(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))
