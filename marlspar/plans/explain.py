"""EXPLAIN: the plan that Catalyst has chosen, as text and as a tree.

Operators are read from the physical plan before stages are cut; rows and bytes are Catalyst's estimates,
or the counts of the last ANALYZE where they still hold.  Nothing is run and no table is counted."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

#: Names of physical operators in the dialect; others keep their own.
NAMES = {
    "HashAggregate": "Aggregate", "ObjectHashAggregate": "Aggregate", "SortAggregate": "Aggregate",
    "BroadcastHashJoin": "HashJoin", "ShuffledHashJoin": "HashJoin", "SortMergeJoin": "MergeJoin",
    "BroadcastNestedLoopJoin": "NestedLoopJoin", "CartesianProduct": "NestedLoopJoin",
    "TakeOrderedAndProject": "TopK", "CollectLimit": "Limit", "GlobalLimit": "Limit", "LocalLimit": "Limit",
}
_EQUAL = re.compile(r"Equal(?:To|NullSafe)\(([^,()]+),")


@dataclass
class Node:
    kind: str
    spark: str  # the operator's own name
    rows: int
    bytes: int
    table: str = ""
    about: str = ""
    filter: str = ""
    children: list[Node] = field(default_factory=list)

    @property
    def cost(self) -> int:
        """Bytes that go through this operator and all below it."""
        return self.bytes + sum(c.cost for c in self.children)

    def lines(self, depth: int = 0) -> list[str]:
        pad = "  " * depth
        out = [f"{pad}{self.kind}({self.about}) rows={self.rows} cost={self.cost} operator={self.spark}"]
        if self.filter:
            out.append(f'{pad}  Filter(predicate="{self.filter}")')
        for c in self.children:
            out += c.lines(depth + 1)
        return out

    def tree(self) -> dict:
        return {"node_type": self.kind, "table": self.table, "estimated_rows": self.rows, "estimated_cost": float(self.cost), "details": self.about, "operator": self.spark, "filter": self.filter, "children": [c.tree() for c in self.children]}


def usable(indexes: list[list[str]], equal: set[str]) -> list[str]:
    """The index of which the filter fixes most leading columns."""
    prefix = lambda index: next((i for i, c in enumerate(index) if c not in equal), len(index))
    best = max(indexes, key=prefix, default=[])
    return best if best and prefix(best) else []


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _plain(text: str) -> str:
    return re.sub(r"#\d+L?", "", text)


def read(plan, facts: Callable[[str], tuple[str, int | None, list[list[str]]]]) -> Node:
    """The tree of a physical plan; ``facts(path)`` tells a folder's table, its rows if known, and its indexes."""
    name = plan.nodeName().split(" ")[0]
    inner = [read(c, facts) for c in _items(plan.children())]
    link = plan.logicalLink()
    stats = link.get().stats() if link.isDefined() else None
    size = int(str(stats.sizeInBytes())) if stats is not None else sum(c.bytes for c in inner)
    if stats is not None and stats.rowCount().isDefined():
        rows = int(str(stats.rowCount().get()))
    else:
        rows = size // max(8, 8 + plan.schema().defaultSize())
    node = Node(NAMES.get(name, name), name, rows, size, children=inner)
    if hasattr(plan, "relation") and name in ("Scan", "FileScan") and plan.getClass().getSimpleName() == "FileSourceScanExec":
        paths = [p.toString() for p in _items(plan.relation().location().rootPaths())]
        node.table, known, indexes = facts(paths[0] if paths else "")
        pushed = plan.metadata().get("PushedFilters")
        pushed = pushed.get() if pushed.isDefined() else "[]"
        index = usable(indexes, set(_EQUAL.findall(pushed)))
        node.kind = "SeqScan" if not index else "IndexScan" if len(index) == 1 else "CompositeIndexScan"
        node.about = f"table={node.table}" + (f", index={','.join(index)}" if index else "")
        node.filter = "" if pushed == "[]" else pushed.strip("[]")
        if known is not None and pushed == "[]":
            node.rows = known
        return node
    if node.kind == "Filter" and len(inner) == 1 and inner[0].kind.endswith("Scan"):  # a scan and what remains of its filter are one step
        inner[0].filter = _plain(plan.condition().sql()) if hasattr(plan, "condition") else inner[0].filter
        inner[0].rows = min(inner[0].rows, rows) if stats is not None and stats.rowCount().isDefined() else inner[0].rows
        return inner[0]
    if node.kind in ("HashJoin", "MergeJoin"):
        keys = zip(_items(plan.leftKeys()), _items(plan.rightKeys()), strict=True)
        node.about = "keys=" + ", ".join(f"{_plain(a.sql())}={_plain(b.sql())}" for a, b in keys) + f", type={plan.joinType().sql()}"
    elif node.kind == "Aggregate":
        by = ",".join(_plain(e.name()) for e in _items(plan.groupingExpressions())) or "none"
        node.about = f"group_by={by}"
        if len(inner) == 1 and inner[0].kind == "Aggregate" and inner[0].about == node.about:  # the partial step of the same aggregate
            node.children = inner[0].children
    elif node.kind in ("Sort", "TopK"):
        node.about = "order_by=" + ",".join(_plain(e.sql()) for e in _items(plan.sortOrder()))
    if node.kind in ("Limit", "TopK"):
        node.about += (", " if node.about else "") + f"count={plan.limit()}"
        node.rows = min(node.rows, plan.limit())
    return node
