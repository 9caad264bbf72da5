"""Colour refinement of labelled graphs, and order-free fingerprints."""

from __future__ import annotations

import hashlib
import struct
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from .blake3 import digest

#: Fixed values.
WL_TAG, SPD_WL_TAG, LABEL_TAG = "wl-v1", "spd-wl-v1", "pua-graph/label/1"
UNDIRECTED, OUT, IN = 0, 1, 2
UNREACHABLE = 2**32 - 1

HASHES: dict[str, Callable[[bytes], bytes]] = {"blake3": digest, "sha2_256": lambda data: hashlib.sha256(data).digest()}


def label_of(*parts: bytes) -> int:
    """A node or edge label from parts, unsigned."""
    return int.from_bytes(digest(LABEL_TAG.encode() + b"".join(struct.pack("<Q", len(p)) + p for p in parts))[:8], "little")


@dataclass
class Graph:
    labels: list[int] = field(default_factory=list)
    near: list[list[tuple[int, int | None, int]]] = field(default_factory=list)  # neighbour, edge label, direction
    edges: int = 0

    def add_node(self, label: int) -> int:
        self.labels.append(label)
        self.near.append([])
        return len(self.labels) - 1

    def add_edge(self, a: int, b: int, label: int | None = None, directed: bool = False) -> None:
        for v in (a, b):
            if not 0 <= v < len(self.labels):
                raise ValueError(f"unknown node {v}")
        if directed:
            self.near[a].append((b, label, OUT))
            self.near[b].append((a, label, IN))
        else:
            self.near[a].append((b, label, UNDIRECTED))
            if a != b:
                self.near[b].append((a, label, UNDIRECTED))
        self.edges += 1


@dataclass
class Refinement:
    colours: list[bytes]
    rounds: int
    mode: str
    requested: int | None  # None: to stability
    make: Callable[[bytes], bytes] = digest

    @property
    def classes(self) -> int:
        return len(set(self.colours))

    def fingerprint(self) -> str:
        head = bytes([1, 0]) if self.requested is None else bytes([0, self.requested])
        return self.make(self.mode.encode() + head + struct.pack("<IQ", self.rounds, len(self.colours)) + b"".join(sorted(self.colours))).hex()


def _refine(graph: Graph, rounds: int | None, mode: str, signature: Callable[[int, list[bytes]], bytes], make: Callable[[bytes], bytes]) -> Refinement:
    colours, run = [make(mode.encode() + b"init" + struct.pack("<Q", x)) for x in graph.labels], 0
    limit = len(colours) if rounds is None else rounds
    while run < limit:
        before = len(set(colours))
        colours = [make(mode.encode() + colours[v] + signature(v, colours)) for v in range(len(colours))]
        run += 1
        if rounds is None and len(set(colours)) == before:
            break
    return Refinement(colours, run, mode, rounds, make)


def wl_refine(graph: Graph, rounds: int | None = 3, hash: str = "blake3") -> Refinement:
    """Each round colours a node by its colour and the sorted edge marks and colours around it."""

    def signature(v: int, colours: list[bytes]) -> bytes:
        around = sorted((label is not None, label or 0, way, colours[u]) for u, label, way in graph.near[v])
        return struct.pack("<Q", len(around)) + b"".join(struct.pack("<BQB", *x[:3]) + x[3] for x in around)

    return _refine(graph, rounds, WL_TAG, signature, HASHES[hash])


def distances(graph: Graph, start: int) -> list[int]:
    """Edges on the shortest way to each node, directions aside."""
    out, queue = [UNREACHABLE] * len(graph.labels), deque([start])
    out[start] = 0
    while queue:
        v = queue.popleft()
        for u, _, _ in graph.near[v]:
            if out[u] == UNREACHABLE:
                out[u] = out[v] + 1
                queue.append(u)
    return out


def spd_wl_refine(graph: Graph, rounds: int | None = 3, hash: str = "blake3") -> Refinement:
    """As wl_refine, by the distances and colours of all other nodes."""
    far = [distances(graph, v) for v in range(len(graph.labels))]

    def signature(v: int, colours: list[bytes]) -> bytes:
        others = sorted((far[v][u], colours[u]) for u in range(len(colours)) if u != v)
        return struct.pack("<Q", len(others)) + b"".join(struct.pack("<I", n) + c for n, c in others)

    return _refine(graph, rounds, SPD_WL_TAG, signature, HASHES[hash])
