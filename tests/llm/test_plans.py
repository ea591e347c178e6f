"""Plans stay small: what the driver plans and broadcasts at once doesn't grow with an operator's levels."""

import re

from gridloom.llm import mixing


def test_mixing_plan_holds_no_level_twice(spark):
    rows = [(i, f"word{i} " * (i % 7 + 1), "abc"[i % 3]) for i in range(300)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    plan = mixed._jdf.queryExecution().optimizedPlan().toString()
    # the sources, and one table of cuts for each level
    assert len(re.findall(r"\bJoin\b", plan)) <= mixing.LEVELS + 1
    assert mixed.count() == len(rows)
