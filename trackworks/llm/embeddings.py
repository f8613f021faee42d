"""Embedding near-duplicates with one HNSW graph per shard."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackworks.llm.components import connected_components
from trackworks.llm.shared import forget, mixed, passed_through, stored

#: Different vectors of a label that are at home in one shard, and bytes of them in single precision.
SHARD_ROWS, SHARD_BYTES = 65_536, 1 << 24
#: Times its own classes that a shard holds with its guests; larger ones are compared part by part.
STRETCH = 4
#: Bytes of pivots, by which labels of several shards are dealt, and the cosine of two pivots at most.
PIVOT_BYTES, PIVOTS_APART = 1 << 23, 0.9
#: Neighbours a node keeps, and the beam of first searches from above and from a node itself.
NEIGHBOURS, SEARCH_BEAM, OWN_BEAM = 12, 32, 8
#: Nodes that a cell has when a level is linked, cells that each node is compared in, and members that are compared at once.
CELL_ROWS, CELLS, CELL_MOST = 128, 3, 2048
#: Nodes of the top level, which is compared whole, and nodes that a beam opens in a step.
TOP, OPENED = 1024, 2
#: Rows of a shard for each place of a beam, up to which comparing all is not dearer than the beam.
WHOLE = 2000
#: An audit compares queries with the whole shard until it has seen so many links, or tried so many queries; recall it asks for.
AUDIT_LINKS, AUDIT_QUERIES, RECALL = 200, 1024, 0.99
#: Queries that every audit makes itself: rows of the shard turned away by up to the angle of a link.
AUDIT_PLANTED = 128
#: What single precision may take from a cosine; what is so near is decided in double.
SINGLE = 1e-5
_BLOCK = 256


class Graph:
    """Hierarchical navigable small world over unit vectors, linked and searched in blocks.

    Levels are nested random samples, the base holds all. A level is linked at once: a node gets the closest members of
    its nearest cells (cells are those of some of the level's nodes), and links back from them. The top is compared whole.
    """

    def __init__(self, x: np.ndarray, seed: int = 0) -> None:
        self.x = x
        n = len(x)
        self.drawn = np.random.default_rng(seed).permutation(n)
        #: by level: nodes, neighbours by node (-1: none)
        self.nodes = [np.arange(n)]
        while len(self.nodes) == 1 or len(self.nodes[-1]) > TOP:
            self.nodes.append(np.sort(self.drawn[: max(1, n // NEIGHBOURS ** len(self.nodes))]))
        self.near = [np.full((n, NEIGHBOURS * (2 if k == 0 else 1)), -1, np.int32) for k in range(len(self.nodes) - 1)]
        #: the base's nodes by cell, so that those that follow one another share neighbours
        self.order = self.nodes[0]
        self._mark = np.zeros(0, np.uint8)
        for k in range(len(self.near)):
            self._link(k)

    def packed(self) -> dict[str, np.ndarray]:
        return {"x": self.x} | {f"nodes{k}": v for k, v in enumerate(self.nodes)} | {f"near{k}": v for k, v in enumerate(self.near)}

    @classmethod
    def unpacked(cls, a: dict[str, np.ndarray]) -> Graph:
        g = cls.__new__(cls)
        levels = sum(name.startswith("nodes") for name in a)
        g.x, g.nodes, g.near = a["x"], [a[f"nodes{k}"] for k in range(levels)], [a[f"near{k}"] for k in range(levels - 1)]
        g._mark = np.zeros(0, np.uint8)
        return g

    def _link(self, k: int) -> None:
        x, nodes, near = self.x, self.nodes[k], self.near[k]
        n, width = len(nodes), near.shape[1]
        pivots = self.drawn[: max(1, min(n // CELL_ROWS, 2 * TOP))]
        m = min(CELLS, len(pivots))
        cell = np.concatenate([_most(x[b] @ x[pivots].T, m) for b in _blocks(nodes, 1024)]) if n else np.zeros((0, m), int)
        if k == 0:
            self.order = np.argsort(cell[:, 0], kind="stable")
        by = np.argsort(cell.ravel(), kind="stable")
        who, turn = by // m, by % m
        cuts = np.searchsorted(cell.ravel()[by], np.arange(len(pivots) + 1))
        # by node and cell: the closest other members
        ids, sims = np.full((n, m, width), -1, np.int32), np.full((n, m, width), -2, np.float32)
        for at, to in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            parts = -(-(to - at) // CELL_MOST)
            for p in range(parts):
                w = np.arange(at + p, to, parts)
                rows, most = nodes[who[w]], min(width, len(w) - 1)
                if not most:
                    continue
                v = x[rows]
                for b in _blocks(np.arange(len(w)), _BLOCK):
                    s = v[b] @ v.T
                    s[np.arange(len(b)), b] = -2
                    best = _most(s, most)
                    ids[who[w[b]], turn[w[b]], :most], sims[who[w[b]], turn[w[b]], :most] = rows[best], np.take_along_axis(s, best, 1)
        kept = np.full(near.shape, -2, np.float32)
        for b in _blocks(np.arange(n), 4096):
            i, s = ids[b].reshape(len(b), -1), sims[b].reshape(len(b), -1)
            order = np.argsort(i, axis=1, kind="stable")
            i, s = np.take_along_axis(i, order, 1), np.take_along_axis(s, order, 1)
            s[:, 1:][i[:, 1:] == i[:, :-1]] = -2  # seen in another cell
            best = _most(s, width)
            s = np.take_along_axis(s, best, 1)
            near[nodes[b]], kept[nodes[b]] = np.where(s > -1.5, np.take_along_axis(i, best, 1), -1), s
        del ids, sims
        for b in _blocks(nodes, 4096):
            _back(near, kept, b, near[b].copy(), kept[b].copy())

    def _entry(self, q: np.ndarray) -> np.ndarray:
        """Entry nodes of the base for each query: the closest of the top, then beams down the levels between."""
        top = self.nodes[-1]
        e = top[_most(q @ self.x[top].T, min(4, len(top)))]
        for k in range(len(self.near) - 1, 0, -1):
            e = self._beam(q, e, k, 8)[0][:, :4]
        return e

    def _beam(self, q: np.ndarray, entry: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The `width` best nodes found for each query, best first (-1 with similarity -2 where there are fewer)."""
        x, near, n, size = self.x, self.near[k], len(q), len(self.x)
        if len(self._mark) < n * size:
            self._mark = np.zeros(n * size, np.uint8)
        mark, entry = self._mark, entry[:, :width]
        ids, sims = np.full((n, width), -1, np.int64), np.full((n, width), -2, np.float32)
        ids[:, : entry.shape[1]] = entry
        sims[:, : entry.shape[1]] = np.where(entry >= 0, np.einsum("ij,ikj->ik", q, x[entry]), -2)
        open_ = sims > -1.5
        r, c = np.nonzero(ids >= 0)
        touched = [r * size + ids[r, c]]
        mark[touched[0]] = 1
        act, opened = np.arange(n), min(OPENED, width)
        slot = np.arange(1, opened * near.shape[1] + 1, dtype=np.uint8)
        while len(act):
            i, s, o = ids[act], sims[act], open_[act]
            cand = np.where(o, s, np.float32(-3))
            pick = _most(cand, opened)
            best = np.take_along_axis(cand, pick, 1)
            go = (best > -2.5).any(1)
            act, i, s, o, pick, best = act[go], i[go], s[go], o[go], pick[go], best[go]
            if not len(act):
                break
            np.put_along_axis(o, pick, False, 1)
            nb = near[np.take_along_axis(i, pick, 1)]
            nb[best < -2.5] = -1
            nb = nb.reshape(len(act), -1)
            r, c = np.nonzero(nb >= 0)
            f = act[r] * size + nb[r, c]
            new = mark[f] == 0
            r, c, f = r[new], c[new], f[new]
            # a node that several opened ones lead to counts once
            mark[f] = slot[c]
            new = mark[f] == slot[c]
            r, c, f = r[new], c[new], f[new]
            touched.append(f)
            more = np.full(nb.shape, -2, np.float32)
            more[r, c] = np.einsum("ij,ij->i", q.take(act[r], 0), x.take(nb[r, c], 0))
            s, i, o = np.concatenate([s, more], 1), np.concatenate([i, nb], 1), np.concatenate([o, more > -1.5], 1)
            best = _most(s, width)
            sims[act], ids[act], open_[act] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1), np.take_along_axis(o, best, 1)
        for f in touched:
            mark[f] = 0
        order = np.argsort(-sims, axis=1, kind="stable")
        ids[sims < -1.5] = -1
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, q: np.ndarray, width: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of each query the `width` best nodes found. own: the nodes that the queries are, from which beams start then."""
        width = min(width, len(self.x))
        step = min(_BLOCK, max(64, (1 << 25) // max(1, len(self.x))))
        parts = [self._beam(q[b], self._entry(q[b]) if own is None else own[b, None], 0, width) for b in _blocks(np.arange(len(q)), step)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _blocks(rows: np.ndarray, size: int) -> Iterator[np.ndarray]:
    return (rows[i : i + size] for i in range(0, len(rows), size))


def _most(s: np.ndarray, k: int) -> np.ndarray:
    """By row the places of its k largest values, in any order."""
    return np.argpartition(-s, k - 1, axis=1)[:, :k] if k < s.shape[1] else np.broadcast_to(np.arange(s.shape[1]), s.shape)


def _back(near: np.ndarray, kept: np.ndarray, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
    """Links back to the new nodes, a few at a time; a full node keeps its closest, and some of the others."""
    width = near.shape[1]
    half = width // 2
    u, v, s = np.repeat(new, ids.shape[1]), ids.ravel(), sims.ravel()
    ok = v >= 0
    u, v, s = u[ok], v[ok], s[ok]
    ok = ~(near[v] == u[:, None]).any(1)
    u, v, s = u[ok], v[ok], s[ok]
    order = np.lexsort((u, v))
    u, v, s = u[order], v[order], s[order]
    node, first, count = np.unique(v, return_index=True, return_counts=True)
    step = np.arange(4)
    while len(node):
        place = np.minimum(first[:, None] + step, len(u) - 1)
        has = step < count[:, None]
        i, w = np.concatenate([near[node], np.where(has, u[place], -1)], 1), np.concatenate([kept[node], np.where(has, s[place], np.float32(-2))], 1)
        by, n = np.argsort(-w, axis=1, kind="stable"), (i >= 0).sum(1)
        # half are the closest, the others spread over the rest, so that tight groups stay reachable
        pick = np.tile(np.arange(width), (len(node), 1))
        over = np.flatnonzero(n > width)
        pick[over, half:] = half + (n[over] - half - 1)[:, None] * np.arange(width - half) // (width - half - 1)
        by = np.take_along_axis(by, pick, 1)
        near[node], kept[node] = np.take_along_axis(i, by, 1), np.take_along_axis(w, by, 1)
        go = count > len(step)
        node, first, count = node[go], first[go] + len(step), count[go] - len(step)


def _found(graph: Graph, q: np.ndarray, least: float, width: int, own: np.ndarray | None = None, order: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(queries, rows close to them, cosines, whether all rows were compared), for all queries: beams of `width`, wider
    where all of a beam is close.

    Such a query may have more links than its beam is wide; where a wider beam is dearer than all of the shard, that is
    compared.
    """
    x, first = graph.x, width
    todo = np.arange(len(q)) if order is None else order
    while len(todo):
        if width > first and len(x) <= WHOLE * width:
            for b in _blocks(todo, max(1, min(_BLOCK, (1 << 22) // len(x)))):
                s = (q[b] @ x.T).ravel()
                at = np.flatnonzero(s >= least)
                yield b[at // len(x)], at % len(x), s[at], True
            return
        more = []
        for b in _blocks(todo, 4 * _BLOCK):
            ids, sims = graph.search(q[b], width, None if own is None else own[b])
            good = (ids >= 0) & (sims >= least)
            full = good[:, -1] & (ids.shape[1] < len(x))
            more.append(b[full])
            r, c = np.nonzero(good & ~full[:, None])
            yield b[r], ids[r, c], sims[r, c], False
        todo, width = np.concatenate(more), width * 4


def planted_queries(x: np.ndarray, least: float, rng: np.random.Generator) -> np.ndarray:
    """Unit vectors whose cosine with a row of x each is between `least` and 1, in random directions from it."""
    rows = x[rng.permutation(len(x))[:AUDIT_PLANTED]]
    if x.shape[1] < 2:
        return rows
    away = rng.normal(size=rows.shape)
    away -= (away * rows).sum(1, keepdims=True) * rows
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
    c = rng.uniform(least, 1, size=(len(rows), 1))
    return (c * rows + np.sqrt(1 - c * c) * away).astype(np.float32)


def audited(graph: Graph, q: np.ndarray, least: float, own: np.ndarray | None = None, seed: int = 0, planted: np.ndarray | None = None) -> dict[str, int]:
    """The first beam of queries like q, and what the audit saw that chose it.

    The audit goes through queries in random order and compares each with all rows, until it has seen AUDIT_LINKS links
    or tried AUDIT_QUERIES; and as q may have few links or none, it adds planted queries, which have. own: the nodes that
    the queries are, where they are rows themselves; they are no links of theirs, and planted are the nodes of planted
    queries then, which are in the graph as all rows are. The very search that all queries get is then tried on these;
    its first beam is doubled until it finds RECALL of the links of either kind.
    """
    rng, n = np.random.default_rng(seed), len(graph.x) - (0 if planted is None else len(planted))

    def truth_of(queries: np.ndarray, self_: np.ndarray | None) -> np.ndarray:
        """Links as query * rows + row."""
        s = queries @ graph.x[:n].T >= least
        if self_ is not None:
            s[np.flatnonzero(self_ < n), self_[self_ < n]] = False
        r, c = np.nonzero(s)
        return r * n + c

    order = rng.permutation(len(q))[:AUDIT_QUERIES]
    truth, tried = [np.zeros(0, np.int64)], 0
    for b in _blocks(order, 64):
        truth.append(truth_of(q[b], None if own is None else own[b]) + tried * n)
        tried += len(b)
        if sum(map(len, truth)) >= AUDIT_LINKS:
            break
    order = order[:tried]
    hidden = planted_queries(graph.x, least, rng) if planted is None else graph.x[planted]
    kinds = [(q[order], None if own is None else own[order], np.concatenate(truth)), (hidden, planted, truth_of(hidden, planted))]
    width = SEARCH_BEAM if own is None else OWN_BEAM
    while True:
        hits = []
        for queries, nodes, links in kinds:
            found = [r * n + c for r, c, *_ in _found(graph, queries, least, width, nodes) for r, c in [(r[c < n], c[c < n])]] if len(links) else []
            hits.append(int(np.isin(links, np.concatenate(found)).sum()) if found else 0)
        if all(h >= RECALL * len(links) for h, (*_, links) in zip(hits, kinds, strict=True)) or width >= len(graph.x):
            break
        width *= 2
    return {"queries": tried, "links": len(kinds[0][2]), "hits": hits[0], "planted": len(kinds[1][2]), "planted_hits": hits[1], "beam": width}


def links_of(graph: Graph, q: np.ndarray, least: float, own: np.ndarray | None = None, seed: int = 0) -> tuple[Iterator[tuple[int, np.ndarray]], dict[str, int]]:
    """For each unit vector of q, the rows of the graph with cosine >= least, in single precision; and what the audit saw."""
    audit = audited(graph, q, least - SINGLE, own, seed)
    found = _found(graph, q, least - SINGLE, audit["beam"], own)
    return ((i, c[r == i]) for r, c, *_ in found for i in np.unique(r).tolist()), audit


def _scaled(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By row what to divide by in turn, so that the row becomes a unit vector in double precision: its largest component, its length then."""
    most = np.abs(v).max(1).astype(float)
    return most, np.concatenate([np.zeros(0), *(np.sqrt(np.square(v[b].astype(float) / most[b, None]).sum(1)) for b in _blocks(np.arange(len(v)), 4096))])


def _unit(v: np.ndarray, most: np.ndarray, length: np.ndarray) -> np.ndarray:
    return v.astype(float) / most[:, None] / length[:, None]


def _single(v: np.ndarray, most: np.ndarray, length: np.ndarray) -> np.ndarray:
    out = np.empty(v.shape, np.float32)
    for b in _blocks(np.arange(len(v)), 4096):
        out[b] = _unit(v[b], most[b], length[b])
    return out


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class _Pairs:
    """Which of the pairs that a shard finds count in it, so that each counts in one shard.

    A class is at home in the first of its cells and a guest in the others. Two that are at home in a cell count there; a
    guest and one at home do too, unless the other is a guest of the guest's home as well: then the lower cell counts them.
    Of a cell that goes part by part, shard (i, j) has parts i and j: pairs across count, and those within a part where
    the other part is the next one.
    """

    def __init__(self, t: pa.Table) -> None:
        cells = t.column("cells").combine_chunks()
        one = {c: t.column(c)[0].as_py() for c in ("cell", "i", "j", "parts")}
        self.cell, self.part = one["cell"], t.column("part").to_numpy()
        self.split = one["parts"] > 1
        self.within = np.zeros(one["parts"], bool)
        for a, b in ((one["i"], one["j"]), (one["j"], one["i"])):
            self.within[a] |= b == (a + 1) % one["parts"]
        count, flat = cells.value_lengths().to_numpy(), cells.flatten().to_numpy()
        self.routed = bool((count > 1).any()) or bool((flat != self.cell).any())
        self.home = flat[np.cumsum(count) - count]
        self.most = int(flat.max(initial=0)) + 1
        self.guest = np.sort(np.repeat(np.arange(len(count)), count) * self.most + flat) if self.routed else flat

    def count(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        ok = np.ones(len(r), bool)
        if self.split:
            ok &= (self.part[r] != self.part[c]) | self.within[self.part[r]]
        if self.routed:
            here, there = self.home[r] == self.cell, self.home[c] == self.cell
            ok &= here | there
            k = np.flatnonzero(here != there)
            host, home = np.where(here[k], r[k], c[k]), self.home[np.where(here[k], c[k], r[k])]
            code = host * self.most + home
            both = self.guest[np.minimum(np.searchsorted(self.guest, code), len(self.guest) - 1)] == code
            ok[k] &= ~both | (self.cell < home)
        return ok


class _Forest:
    """Groups of a shard's rows, and the links that made them."""

    def __init__(self, n: int) -> None:
        self.of, self.links = np.arange(n), []

    def join(self, r: np.ndarray, c: np.ndarray) -> None:
        new = self.of[r] != self.of[c]
        r, c = r[new], c[new]
        if not len(r):
            return
        a, b = self.of[r], self.of[c]
        _, some = np.unique(np.minimum(a, b) * len(self.of) + np.maximum(a, b), return_index=True)
        parent: dict[int, int] = {}

        def top(z: int) -> int:
            while z in parent:
                parent[z] = z = parent.get(parent[z], parent[z])
            return z

        for k, x, y in zip(some.tolist(), a[some].tolist(), b[some].tolist(), strict=True):
            x, y = top(x), top(y)
            if x != y:
                parent[y] = x
                self.links.append((int(r[k]), int(c[k])))
        now = np.arange(len(self.of))
        for z in list(parent):
            now[z] = top(z)
        self.of = now[self.of]


_AUDIT = ("queries", "links", "hits", "planted", "planted_hits", "beam")
_LINKS = "cid bigint, n bigint, to bigint, " + ", ".join(f"{k} bigint" for k in _AUDIT)


def _rows(cid: Iterable[int | None], n: Iterable[int], to: Iterable[int | None], audit: dict[str, int]) -> pa.Table:
    cid = pa.array(cid, pa.int64())
    return pa.table({"cid": cid, "n": pa.array(n, pa.int64()), "to": pa.array(to, pa.int64())} | {k: pa.array([audit[k]] * len(cid), pa.int64()) if audit else pa.nulls(len(cid), pa.int64()) for k in _AUDIT})


def _linked(least: float) -> Callable[[pa.Table], pa.Table]:
    """A shard's links: rows with a class and its number of links, rows with two linked classes, and a row with what the audit saw."""

    def run(t: pa.Table) -> pa.Table:
        v, cid, copies, pairs = _vectors(t.column("v")), t.column("cid").to_numpy(), t.column("copies").to_numpy(), _Pairs(t)
        most, length = _scaled(v)
        x, n = _single(v, most, length), len(cid)
        # planted rows are linked and searched as all others are, and are no links of theirs
        graph = Graph(np.concatenate([x, planted_queries(x, least, np.random.default_rng(2))]))
        # a pair that counts here has one that is at home, from which it is searched
        asked = pairs.home == pairs.cell if pairs.routed else np.ones(n, bool)
        audit = audited(graph, x[asked], least - SINGLE, np.flatnonzero(asked), planted=np.arange(n, len(graph.x)))
        links, forest, whole, beams = np.zeros(n), _Forest(n), np.zeros(n, bool), []

        def take(r: np.ndarray, c: np.ndarray) -> None:
            ok = pairs.count(r, c)
            r, c = r[ok], c[ok]
            links[:] += np.bincount(r, copies[c], n)
            forest.join(r, c)

        order = graph.order[graph.order < n]
        for r, c, s, all_ in _found(graph, x, least - SINGLE, audit["beam"], np.arange(n), order[asked[order]]):
            ok = (c < n) & (c != r)
            r, c, near = r[ok], c[ok], np.flatnonzero(s[ok] < least + SINGLE)
            if len(near):
                exact = [((_unit(v[c[b]], most[c[b]], length[c[b]]) * _unit(v[r[b]], most[r[b]], length[r[b]])).sum(1) >= least) for b in _blocks(near, 4096)]
                ok = np.ones(len(r), bool)
                ok[near] = np.concatenate(exact)
                r, c = r[ok], c[ok]
            if all_:
                whole[r] = True
                back = ~asked[c]
                take(np.concatenate([r, c[back]]), np.concatenate([c, r[back]]))
            else:
                beams.append(r * n + c)
        # what one of two rows has found is a link of both; where all rows were compared, there is none to add
        code = np.concatenate([np.zeros(0, np.int64), *beams])
        r, c = code // n, code % n
        back = ~whole[c]
        for b in _blocks(np.unique(np.concatenate([code, c[back] * n + r[back]])), 1 << 20):
            take(b // n, b % n)
        some = np.flatnonzero(links)
        u, w = np.array(forest.links, np.int64).reshape(-1, 2).T
        return pa.concat_tables([_rows(cid[some], links[some].astype(np.int64), [None] * len(some), {}), _rows(cid[u], np.zeros(len(u), np.int64), cid[w], {}), _rows([None], [0], [None], audit)])

    return run


def _cells(x: np.ndarray, pivots: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of unit vectors, each row's home first: that of its nearest pivot.

    Of two vectors at a cosine of `least` that are at home in two cells, at least one is a guest in the other's: their
    distance bounds how far they lie from the plane between the pivots together, so one of them by half of it at most.
    """
    half = np.sqrt(max(0.0, 2 - 2 * (least - SINGLE))) / 2 + SINGLE
    rows, cells = [], []
    for b in _blocks(np.arange(len(x)), max(1, min(1024, (1 << 22) // len(pivots)))):
        s = x[b] @ pivots.T
        home = s.argmax(1)
        apart = np.sqrt(np.maximum(0, 2 - 2 * (pivots[home] @ pivots.T)))
        near = s[np.arange(len(b)), home][:, None] - s <= half * apart + SINGLE
        near[np.arange(len(b)), home] = False
        r, c = np.nonzero(near)
        r, c = np.concatenate([np.arange(len(b)), r]), np.concatenate([home, c])
        order = np.argsort(r, kind="stable")
        rows.append(b[r[order]])
        cells.append(c[order])
    return np.concatenate(rows), np.concatenate(cells)


def _by_label(b: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], np.ndarray]]:
    label = b.column(b.schema.get_field_index("label")).dictionary_encode()
    dim = b.column(b.schema.get_field_index("dim")).to_numpy()
    code = label.indices.to_numpy() * (int(dim.max(initial=0)) + 1) + dim
    order = np.argsort(code, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
        if len(rows):
            yield (label.dictionary[label.indices[rows[0]].as_py()].as_py(), int(dim[rows[0]])), rows


def _cells_of(b: pa.RecordBatch, rows: np.ndarray, pivots: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    v = _vectors(b.column(b.schema.get_field_index("v")).take(pa.array(rows)))
    return _cells(_single(v, *_scaled(v)), pivots, least)


def _counted(pivots: dict[tuple[str, int], np.ndarray], least: float):
    """Classes that each cell holds, as far as a task has read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = {k: np.zeros(len(p), np.int64) for k, p in pivots.items()}
        for b in batches:
            for key, rows in _by_label(b):
                if key in pivots:
                    n[key] += np.bincount(_cells_of(b, rows, pivots[key], least)[1], minlength=len(n[key]))
        for (label, dim), x in n.items():
            some = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(some), pa.string()), pa.array([dim] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array(x[some])], names=["label", "dim", "cell", "rows"])

    return run


_DEAL = ("cell", "i", "j", "parts", "part")


def _dealt(pivots: dict[tuple[str, int], np.ndarray], parts: dict[tuple[str, int], np.ndarray], least: float):
    """Classes with the shards they belong to, a row for each. parts: by cell; a label without pivots has one cell."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cid = b.column(b.schema.get_field_index("cid")).to_numpy()
            for key, rows in _by_label(b):
                r, cell = _cells_of(b, rows, pivots[key], least) if key in pivots else (np.arange(len(rows)), np.zeros(len(rows), np.int64))
                n = parts.get(key, np.ones(1, np.int64))[cell]
                part = (mixed(cid[rows[r]].astype(np.uint64)) % n.astype(np.uint64)).astype(np.int64)
                times = np.maximum(1, n - 1)
                k = np.repeat(np.arange(len(r)), times)
                other = np.arange(len(k)) - np.repeat(np.cumsum(times) - times, times)
                other = np.where(n[k] > 1, other + (other >= part[k]), 0)
                of_row = np.bincount(r, minlength=len(rows))
                cells = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(of_row)), pa.int32()), pa.array(cell, pa.int32())).take(pa.array(r[k]))
                deal = (cell[k], np.minimum(part[k], other), np.maximum(part[k], other), n[k], part[k])
                out = b.take(pa.array(rows[r[k]]))
                yield pa.RecordBatch.from_arrays([*out.columns, *(pa.array(x, pa.int32()) for x in deal), cells], names=[*out.schema.names, *_DEAL, "cells"])

    return run


def _parts(rows: int, most: int) -> int:
    """Parts of half of what a shard holds; two would be no less than all."""
    return 1 if rows <= most else max(3, -(-2 * rows // most))


def _deal(classes: DataFrame, least: float, shard_rows: int) -> DataFrame:
    """Classes with the shards they belong to: all of a label in one, or by cells of pivots, or part by part where that is less."""
    fit = lambda dim: max(1, min(shard_rows, SHARD_BYTES // (4 * dim)))
    classes = classes.select("label", "dim", "cid", "copies", "v")
    large = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > F.greatest(F.lit(1), F.least(F.lit(shard_rows), F.floor(SHARD_BYTES / (4 * F.col("dim")))))).collect()
    if not large:
        one = {"cell": 0, "i": 0, "j": 0, "parts": 1, "part": 0}
        return classes.withColumns({k: F.lit(x).cast("int") for k, x in one.items()} | {"cells": F.array(F.lit(0).cast("int"))})
    n = {(r["label"], r["dim"]): r["n"] for r in large}
    wanted = {k: -(-x // fit(k[1])) for k, x in n.items()}
    share = min(1.0, PIVOT_BYTES / sum(4 * k[1] * x for k, x in wanted.items()))
    wanted = {k: max(2, int(share * x)) for k, x in wanted.items()}
    drawn = classes.sparkSession.createDataFrame([(*k, (2 * x + 40) / n[k]) for k, x in wanted.items()], "label string, dim int, share double")
    turn = F.xxhash64("v", F.lit(3))
    picked = classes.select("label", "dim", "v", turn.alias("turn")).join(F.broadcast(drawn), ["label", "dim"]).filter(F.pmod("turn", F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("label", "dim", "turn", "v").toArrow()
    pivots = {}
    for b in picked.sort_by("turn").combine_chunks().to_batches():
        for key, rows in _by_label(b):
            v = _vectors(b.column(3).take(pa.array(rows)))
            x, kept = _single(v, *_scaled(v)), []
            for i in range(len(x)):
                if len(kept) < wanted[key] and not (kept and (x[kept] @ x[i]).max() > PIVOTS_APART):
                    kept.append(i)
            pivots[key] = x[kept]
    kind = "label string, dim int, cell int, rows bigint"
    held = classes.select("label", "dim", "v").mapInArrow(_counted(pivots, least), kind).groupBy("label", "dim", "cell").agg(F.sum("rows").alias("rows")).collect()
    parts = {k: np.ones(len(p), np.int64) for k, p in pivots.items()}
    cost = dict.fromkeys(n, 0)
    for r in held:
        key = r["label"], r["dim"]
        parts[key][r["cell"]] = p = _parts(r["rows"], STRETCH * fit(key[1]))
        cost[key] += r["rows"] * max(1, p - 1)
    for key, rows in n.items():
        alone = max(4, _parts(rows, STRETCH * fit(key[1])))
        if len(pivots.get(key, ())) < 2 or cost[key] > rows * (alone - 1):
            pivots.pop(key, None)
            parts[key] = np.array([alone])
    return classes.mapInArrow(_dealt(pivots, parts, least), passed_through(classes, **dict.fromkeys(_DEAL, "int"), cells="array<int>"))


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", shard_rows: int = SHARD_ROWS, audit: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """One row per row of `vectors`: id_col, n_links, component_id (the smallest id reachable), kept.

    Rows of equal labels, not null, are linked at a cosine of `least` or more in double precision. Vectors that are
    null or zero, hold null or non-finite components, or have no label or no id, link with nothing (n_links 0; the
    component is their own id, and without one they are kept). Vectors of other lengths are another label. Equal vectors
    are one class: counted, not compared. Rows that repeat an id are one node, which joins the components of all their
    vectors, and other rows to each other in n_links. An empty table gives an empty table.

    A label of up to `shard_rows` classes (fewer of long vectors) is one shard. A larger one is dealt by the nearest of
    some of its classes, the pivots, into cells of about so many, and a class is a guest in each further cell in which the
    geometry of a link allows one (`_cells`), so no link is lost between shards; a shard's size is bounded by STRETCH, and a
    larger one goes part by part, as do labels in which cells don't save anything. A task links a shard's HNSW graph and
    searches it from each row that is at home; the graph leaves no task. `audit` gets a table with a row a task: queries tried,
    links they have and hits among them, the same for planted queries, and the first beam. Other columns play no part.
    """
    v = F.col(vector_col)
    good = v.isNotNull() & (F.size(v) > 0) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
        F.when(good & F.col(label_col).isNotNull() & F.col(id_col).isNotNull(), v.cast(kind)).alias("v"),
    ).withColumns({"a": F.xxhash64("v"), "b": F.xxhash64(F.lit(1), "v"), "dim": F.size("v")})
    key = ["label", "dim", "a", "b"]
    some = rows.filter("v is not null")
    # numbers are given once, as the table is written
    classes = stored(some.groupBy(*key).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")).withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    dealt = _deal(classes, least, shard_rows)
    found = stored(dealt.groupBy("label", "dim", "cell", "i", "j").applyInArrow(_linked(least), _LINKS), "vector-links")
    if audit:
        audit(found.filter("cid is null").select(*_AUDIT))
    links = found.filter("to is not null").select(F.col("cid").alias("u"), F.col("to").alias("v"))
    components = connected_components(links.unionByName(_repeated_ids(some, classes, key)))
    counts = found.filter("n > 0").groupBy("cid").agg(F.sum("n").alias("near"))
    labelled = stored(classes.drop("v").join(counts, "cid", "left").join(components.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid")), "labelled")
    forget(classes, found)
    smallest = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = labelled.join(smallest, "component").select(*key, (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), "component_id")
    return (
        rows.drop("v")
        .join(by_class, key, "left")
        .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"))
    )


def _repeated_ids(some: DataFrame, classes: DataFrame, key: list[str]) -> DataFrame:
    """Links between the classes of ids that come with several vectors."""
    twice = some.groupBy("id").agg(F.min(F.struct(*key)).alias("x"), F.max(F.struct(*key)).alias("y")).filter("x < y").select("id")
    rows = some.select("id", *key).join(twice, "id").distinct().join(classes.select(*key, "cid"), key).select("id", "cid")
    first = rows.groupBy("id").agg(F.min("cid").alias("v"))
    return rows.join(first, "id").select(F.col("cid").alias("u"), "v").filter("u <> v").distinct()
