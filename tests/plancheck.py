"""What a physical plan must not contain."""

from __future__ import annotations

import re

ROW_TASKS = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def faults(df) -> list[str]:
    """Operators that would not scale, and windows over an unpartitioned exchange."""
    text = plan_text(df)
    found = [op for op in ROW_TASKS if op in text]
    lines = [re.sub(r"^[\s:+\-*()0-9!]*", "", line) for line in text.splitlines()]
    for i, line in enumerate(lines):
        if line.startswith("Window "):
            below = " ".join(lines[i + 1 : i + 4])
            if "SinglePartition" in below:
                found.append("window over a single partition")
    return found
