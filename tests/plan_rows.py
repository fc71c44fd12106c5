"""Row counts of the operators of an executed plan."""


def metric_of(frame, operator: str, metric: str = "numOutputRows") -> list[int]:
    """The metric of every node whose name holds ``operator``; reused exchanges count once."""
    found, todo = [], [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if operator in name and node.metrics().contains(metric):
            found.append(node.metrics().apply(metric).value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found
