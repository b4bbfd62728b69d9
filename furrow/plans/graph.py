"""The graph of foreign keys: cycles, insertion order, pictures."""

from __future__ import annotations

from dataclasses import dataclass, field
from heapq import heappop, heappush

from ..errors import CircularDependency, UnbreakableCycle
from ..schema import ForeignKey, Schema


@dataclass(frozen=True)
class Edge:
    """A child table's foreign key to a parent."""

    child: str
    parent: str
    key: ForeignKey
    nullable: bool


@dataclass
class DependencyGraph:
    tables: list[str]
    edges: list[Edge]
    deferred: list[Edge] = field(default_factory=list)

    @staticmethod
    def of(schema: Schema) -> DependencyGraph:
        """An edge may be null if all its columns may; keys to tables outside the schema have no edge."""
        edges = [Edge(t.name, k.parent, k, all(t.columns[c].nullable for c in k.columns if c in t.columns)) for t in schema.tables.values() for k in t.foreign_keys if k.parent in schema.tables]
        return DependencyGraph(list(schema.tables), edges)

    def components(self) -> list[list[str]]:
        """Strongly connected components in the order in which a depth-first walk closes them, without recursion."""
        children: dict[str, list[str]] = {t: [] for t in self.tables}
        for e in self.edges:
            children[e.child].append(e.parent)
        index: dict[str, int] = {}
        low: dict[str, int] = {}
        stack: list[str] = []
        held: set[str] = set()
        out = []
        for root in self.tables:
            if root in index:
                continue
            walk = [(root, iter(children[root]))]
            index[root] = low[root] = len(index)
            stack.append(root)
            held.add(root)
            while walk:
                node, rest = walk[-1]
                step = next(rest, None)
                if step is None:
                    walk.pop()
                    if walk:
                        low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                    if low[node] == index[node]:
                        part = []
                        while True:
                            part.append(stack.pop())
                            held.discard(part[-1])
                            if part[-1] == node:
                                break
                        out.append(part)
                elif step not in index:
                    index[step] = low[step] = len(index)
                    stack.append(step)
                    held.add(step)
                    walk.append((step, iter(children[step])))
                elif step in held:
                    low[node] = min(low[node], index[step])
        return out

    def break_cycles(self, break_at: tuple[str, ...] | list[str] = ()) -> list[Edge]:
        """Take edges out until the graph has no cycle; they are filled in after all rows exist.

        Of each component one edge goes: one that ``break_at`` names as ``table.column``, else one that may be null, else a
        deferrable one, else any. References of a table to itself go last.
        """
        while loops := [set(c) for c in self.components() if len(c) > 1]:
            for loop in loops:
                inside = [e for e in self.edges if e.child in loop and e.parent in loop and e.child != e.parent]
                if not inside:
                    raise UnbreakableCycle(", ".join(sorted(loop)))
                named = lambda e: any(f"{e.child}.{c}" in break_at for c in e.key.columns)
                chosen = min(inside, key=lambda e: (not named(e), not e.nullable, not e.key.deferrable))
                self.edges.remove(chosen)
                self.deferred.append(chosen)
        own = [e for e in self.edges if e.child == e.parent]
        self.edges = [e for e in self.edges if e.child != e.parent]
        self.deferred += own
        return self.deferred

    def order(self) -> list[str]:
        """Tables, parents before children; of those that are ready, the first in the schema's order."""
        place = {t: i for i, t in enumerate(self.tables)}
        parents = {t: set() for t in self.tables}
        children: dict[str, set[str]] = {t: set() for t in self.tables}
        for e in self.edges:
            parents[e.child].add(e.parent)
            children[e.parent].add(e.child)
        waits = {t: len(p) for t, p in parents.items()}
        ready = [place[t] for t in self.tables if not waits[t]]
        done: list[str] = []
        while ready:
            t = self.tables[heappop(ready)]
            done.append(t)
            for c in children[t]:
                waits[c] -= 1
                if not waits[c]:
                    heappush(ready, place[c])
        if len(done) < len(self.tables):
            raise CircularDependency(", ".join(t for t in self.tables if waits[t]))
        return done

    def levels(self) -> dict[str, int]:
        """The longest chain of parents above each table."""
        out: dict[str, int] = {}
        above: dict[str, list[str]] = {t: [] for t in self.tables}
        for e in self.edges:
            above[e.child].append(e.parent)
        for t in self.order():
            out[t] = max((out[p] + 1 for p in above[t]), default=0)
        return out

    def self_references(self) -> list[Edge]:
        """Keys of a table to itself, deferred ones included."""
        return [e for e in [*self.edges, *self.deferred] if e.child == e.parent]

    def ancestors(self, names: list[str]) -> set[str]:
        """The tables and all that they depend on, deferred keys included."""
        found, todo = set(), [n for n in names if n in self.tables]
        while todo:
            t = todo.pop()
            if t not in found:
                found.add(t)
                todo += [e.parent for e in [*self.edges, *self.deferred] if e.child == t]
        return found


def filter_tables(order: list[str], graph: DependencyGraph, include: list[str] = (), exclude: list[str] = ()) -> list[str]:
    """Included tables with their ancestors (all, if none is named), less the excluded ones, in the given order."""
    wanted = graph.ancestors(list(include)) if include else set(order)
    return [t for t in order if t in wanted and t not in set(exclude)]


def mermaid(graph: DependencyGraph) -> str:
    """A Mermaid flow chart; deferred keys are dashed."""
    lines = ["graph TD", *(f"    {t}[{t}]" for t in graph.tables)]
    lines += [f"    {e.child} -->|{', '.join(e.key.columns)}| {e.parent}" for e in graph.edges]
    lines += [f"    {e.child} -.->|{', '.join(e.key.columns)} (deferred)| {e.parent}" for e in graph.deferred]
    return "\n".join(lines) + "\n"


def dot(graph: DependencyGraph) -> str:
    """A Graphviz graph; deferred keys are dashed."""
    lines = ["digraph dependencies {", "    rankdir=LR;", "    node [shape=box];", *(f'    "{t}";' for t in graph.tables)]
    lines += [f'    "{e.child}" -> "{e.parent}" [label="{", ".join(e.key.columns)}"];' for e in graph.edges]
    lines += [f'    "{e.child}" -> "{e.parent}" [label="{", ".join(e.key.columns)}", style=dashed];' for e in graph.deferred]
    return "\n".join([*lines, "}"]) + "\n"
