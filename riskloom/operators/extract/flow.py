"""Control-flow graphs of functions, as counts of nodes and edges, and complexity from them."""

from __future__ import annotations


class Flow:
    """A graph under construction. ``at`` is where control is, None after a jump."""

    ENTRY, EXIT = 0, 1

    def __init__(self) -> None:
        self.size, self.edges, self.at = 2, [], 0
        self.targets: list[dict] = []

    def node(self, *sources: int | None) -> int:
        n = self.size
        self.size += 1
        for s in sources:
            if s is not None:
                self.edges.append((s, n))
        return n

    def edge(self, a: int | None, b: int) -> None:
        if a is not None:
            self.edges.append((a, b))

    def step(self) -> None:
        if self.at is not None:
            self.at = self.node(self.at)

    def finish(self) -> None:
        """What is left of a block goes to the exit, once."""
        if self.at not in (None, self.EXIT) and (self.at, self.EXIT) not in self.edges:
            self.edge(self.at, self.EXIT)

    def complexity(self) -> int:
        """Edges less inner nodes, plus two; 1 for a graph without inner nodes."""
        return len(self.edges) - (self.size - 2) + 2 if self.size > 2 else 1

    def reached(self) -> bool:
        """Whether every node is reached from the entry and reaches the exit."""
        for start, flip in ((self.ENTRY, False), (self.EXIT, True)):
            to: dict[int, list[int]] = {}
            for a, b in self.edges:
                if flip:
                    a, b = b, a
                to.setdefault(a, []).append(b)
            seen, todo = {start}, [start]
            while todo:
                for n in to.get(todo.pop(), []):
                    if n not in seen:
                        seen.add(n)
                        todo.append(n)
            if len(seen) < self.size:
                return False
        return True
