"""A minimum cut between content and boilerplate: maximum flow by blocking flows in layered networks."""

from __future__ import annotations


class Network:
    """Nodes with a cost for either side, and edges that cost what they bind when their ends part."""

    def __init__(self, nodes: int):
        self.source, self.sink = nodes, nodes + 1
        self.edges: list[list[int]] = [[] for _ in range(nodes + 2)]
        self.to: list[int] = []
        self.room: list[float] = []

    def _edge(self, a: int, b: int, forth: float, back: float) -> None:
        self.edges[a].append(len(self.to))
        self.to.append(b)
        self.room.append(forth)
        self.edges[b].append(len(self.to))
        self.to.append(a)
        self.room.append(back)

    def lean(self, node: int, gain: float) -> None:
        """``gain``: what the source's side saves at ``node`` over the sink's; below 0 it costs."""
        if gain > 0:
            self._edge(self.source, node, gain, 0.0)
        elif gain < 0:
            self._edge(node, self.sink, -gain, 0.0)

    def bind(self, a: int, b: int, cost: float) -> None:
        self._edge(a, b, cost, cost)

    def _layers(self) -> list[int]:
        layer = [-1] * len(self.edges)
        layer[self.source] = 0
        now = [self.source]
        while now and layer[self.sink] < 0:
            after = []
            for a in now:
                for e in self.edges[a]:
                    b = self.to[e]
                    if layer[b] < 0 and self.room[e] > 1e-9:
                        layer[b] = layer[a] + 1
                        after.append(b)
            now = after
        return layer

    def source_side(self) -> list[bool]:
        """For each node whether it stays with the source in the minimum cut; nodes that are free either way go to the sink's side."""
        to, room, edges, sink = self.to, self.room, self.edges, self.sink
        while True:
            layer = self._layers()
            if layer[sink] < 0:
                return [x >= 0 for x in layer[:-2]]
            at, path = [0] * len(edges), []
            node = self.source
            while True:
                if node == sink:
                    flow = min(room[e] for e in path)
                    full = None
                    for place, e in enumerate(path):
                        room[e] -= flow
                        room[e ^ 1] += flow
                        if full is None and room[e] <= 1e-9:
                            full = place
                    del path[full:]
                    node = to[path[-1]] if path else self.source
                    continue
                out, place = edges[node], at[node]
                while place < len(out) and not (room[out[place]] > 1e-9 and layer[to[out[place]]] == layer[node] + 1):
                    place += 1
                at[node] = place
                if place < len(out):
                    path.append(out[place])
                    node = to[out[place]]
                elif path:  # a dead end: step back and leave it out
                    layer[node] = -2
                    path.pop()
                    node = to[path[-1]] if path else self.source
                else:
                    break
