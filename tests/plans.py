"""Rows that the nodes of an executed plan made."""


def most_rows(df, name: str) -> int:
    """The most output rows of a node whose name has ``name``, after the query has run."""
    df.collect()
    found, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            left.append(node.plan())
            continue
        if name in kind and node.metrics().contains("numOutputRows"):
            found = max(found, node.metrics().apply("numOutputRows").value())
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return found
