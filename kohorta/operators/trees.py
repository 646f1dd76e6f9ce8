"""Decision trees over binned features: any number of them grown together.

Features are binned once (`bin_table`). A tree is described by a `Plan` (seed, number, rules, features, training set); row
weights, the features tried at a node and random cuts are hashes of (seed, tree, row or node), so a tree is a function of
its plan and the table, and trees of all seeds, folds and candidates grow side by side.

`grow` has two ways to the same trees. A table of at most `LOCAL_BYTES`, counted first, is shipped to the tasks, which
share out the trees. Beyond that trees grow level by level: every task adds up its rows for all open nodes of all trees,
Spark sums (node, feature, bin), tasks pick the splits, and only the splits come back; `CELLS` bounds the sums a task holds,
more open nodes take more passes. Sums are of whole numbers (weights, or gradients rounded to 2^-30), so both ways agree.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.formulas import hash32
from ..session import discard, materialise
from .ordered import quantiles

BINS = 32
MISSING = BINS - 1  # the bin of missing values
LOCAL_BYTES = 64 << 20
CELLS = 1 << 22
FIXED = float(1 << 30)


# ---- hashes -------------------------------------------------------------------------------------

PRIME = 2147483647
#: A Poisson count of mean one is the number of these bounds that a draw reaches.
POISSON = np.floor(PRIME * np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 12.0)])))).astype(np.int64)


def _fold(x: np.ndarray, t: np.ndarray) -> None:
    """A smaller x of the same rest: PRIME is 2^31 - 1, so the digits to base 2^31 are added."""
    np.right_shift(x, 31, out=t)
    np.bitwise_and(x, PRIME, out=x)
    x += t


def draw(h: np.ndarray, *salt: int) -> np.ndarray:
    """Uniform over 0 .. PRIME - 1, a function of each h and the salt: for each s of the salt
    x = (x + s * 1000003 + 1) * 48271, x = x^2 + 69069 x + 7, x = x^2 + 40692 x + 11, each modulo PRIME.
    Small whole numbers only, so SQL can say the same."""
    h = np.asarray(h, np.int64)
    out = (h % PRIME).reshape(-1)
    for at in range(0, len(out), 8192):  # in the cache, in place
        x = out[at: at + 8192]
        t = np.empty_like(x)
        for s in salt:
            x += (s % PRIME) * 1000003 % PRIME + 1
            x *= 48271
            _fold(x, t)
            for p, q in ((69069, 7), (40692, 11)):
                np.add(x, p, out=t)
                x *= t
                x += q
                _fold(x, t)
                _fold(x, t)
        x -= PRIME * (x >= PRIME)
    return out.reshape(h.shape)


def poisson(u: np.ndarray) -> np.ndarray:
    """Poisson counts of mean one of uniform draws."""
    out = np.zeros(u.shape, np.uint8)
    for bound in POISSON:
        out += u >= bound
    return out


# ---- plans --------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Rules:
    """How a tree grows. `criterion` newton splits by gradient and Hessian sums; `tried` is the number of features looked at
    in a node (sqrt, log2, all or a number); `splitter` random draws one cut per node and feature; with `leaves` the leaf of
    greatest gain is split next until there are so many."""

    criterion: str = "gini"
    depth: int = 10
    tried: str | int = "sqrt"
    splitter: str = "best"
    min_leaf: float = 1.0
    l2: float = 0.0
    min_gain: float = 0.0
    leaves: int | None = None

    def count(self, d: int) -> int:
        kinds = {"all": d, "sqrt": int(np.ceil(np.sqrt(d))), "log2": max(1, int(np.ceil(np.log2(max(d, 2))))), None: d}
        return max(1, min(d, kinds[self.tried] if self.tried in kinds else int(self.tried)))


@dataclass(frozen=True)
class Plan:
    """One tree: rows with member[:, member] (all if None), bootstrapped by Poisson counts or not; `resampled` draws counts
    that all trees of the seed share besides."""

    seed: int
    number: int
    rules: Rules
    features: tuple[int, ...]
    member: int | None = None
    bootstrap: bool = True
    resampled: bool = False

    def weights(self, h: np.ndarray, member: np.ndarray) -> np.ndarray:
        w = np.ones(len(h)) if self.member is None else member[:, self.member].astype(np.float64)
        if self.bootstrap:
            w = w * poisson(draw(h, self.seed, self.number, 1))
        if self.resampled:
            w = w * poisson(draw(h, self.seed, 5))
        return w

    def tried(self, heap: np.ndarray) -> np.ndarray:
        """(node, feature) matrix of the features looked at in each node, ascending."""
        f = np.array(self.features, np.int64)
        m = self.rules.count(len(f))
        if m == len(f):
            return np.broadcast_to(np.sort(f), (len(heap), m))
        u = draw(heap[:, None] % PRIME * 65537 + f, self.seed, self.number, 2)
        return np.sort(f[np.argsort(u, axis=1, kind="stable")[:, :m]], axis=1)

    def cuts(self, heap: np.ndarray, tried: np.ndarray) -> np.ndarray:
        return draw(heap[:, None] % PRIME * 65537 + tried, self.seed, self.number, 3)


# ---- the growing of nodes -----------------------------------------------------------------------

def sums(bins: np.ndarray, node: np.ndarray, tried: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, tried feature, bin) sums of a and b over rows whose `node` isn't negative."""
    k, m = tried.shape
    inside = np.flatnonzero(node >= 0)
    n = node[inside]
    cell = ((n[:, None] * m + np.arange(m)) * BINS + bins[inside[:, None], tried[n]]).ravel()
    return tuple(np.bincount(cell, np.repeat(x[inside], m), k * m * BINS).reshape(k, m, BINS) for x in (a, b))


def added(flat: np.ndarray, start: np.ndarray, at: np.ndarray, tried: np.ndarray, a: np.ndarray, b: np.ndarray,
          packed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(slot, tried feature, bin) sums of a and b over rows whose bins begin at `start` of `flat` and that stand in slot `at`.
    `packed` holds a and b in one number."""
    k, m = tried.shape
    sa, sb, base = np.empty((k, m, BINS)), np.empty((k, m, BINS)), at * BINS
    for j in range(m):
        cell = tried[:, j].take(at)
        cell += start
        cell = base + flat.take(cell)
        if packed is not None:
            both = np.bincount(cell, packed, k * BINS)
            high = np.floor(both / (1 << 26))
            sa[:, j], sb[:, j] = (both - high * (1 << 26)).reshape(k, BINS), high.reshape(k, BINS)
        else:
            sa[:, j], sb[:, j] = (np.bincount(cell, x, k * BINS).reshape(k, BINS) for x in (a, b))
    return sa, sb


def pack(rules: Rules, a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """a and b in one number, if whole weights of both kinds fit into one sum."""
    whole = rules.criterion != "newton" and a.sum() < 1 << 26 and (a == np.floor(a)).all()
    return a + b * float(1 << 26) if whole else None


def _worth(rules: Rules, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What a split maximises the sum of: minus the impurity, or G^2 / (H + l2)."""
    if rules.criterion == "newton":
        return b * b / np.maximum(a + rules.l2, 1e-300)
    with np.errstate(divide="ignore", invalid="ignore"):
        if rules.criterion == "gini":
            return np.where(a > 0, -2.0 * b * (a - b) / a, 0.0)
        parts = [np.where(x > 0, x * np.log(x / a), 0.0) for x in (b, a - b)]
        return parts[0] + parts[1]


@dataclass
class Splits:
    ok: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    gain: np.ndarray
    sides: np.ndarray  # (node, 4): a and b of the left, of the right

    def part(self, rows: slice) -> Splits:
        return Splits(*[getattr(self, f)[rows] for f in self.__dataclass_fields__])


def choose(a: np.ndarray, b: np.ndarray, tried: np.ndarray, rules: Rules, cuts: np.ndarray | None = None) -> Splits:
    """Best split of every node: rows of bin <= cut go left, missing values to the side that gains more."""
    k, m, _ = a.shape
    total_a, total_b = a[:, :1].sum(2), b[:, :1].sum(2)
    lone_a, lone_b = a[:, :, MISSING], b[:, :, MISSING]
    left_a, left_b = np.cumsum(a[:, :, :MISSING], 2), np.cumsum(b[:, :, :MISSING], 2)
    best = None
    for missing_left in ((False, True) if lone_a.any() else (False,)):
        la = left_a + lone_a[:, :, None] if missing_left else left_a
        lb = left_b + lone_b[:, :, None] if missing_left else left_b
        ra, rb = total_a[:, :, None] - la, total_b[:, :, None] - lb
        ok = (la >= rules.min_leaf) & (ra >= rules.min_leaf) & (la > 0) & (ra > 0)
        if rules.splitter == "random" and cuts is not None:
            some = a[:, :, :MISSING] > 0
            first, last = some.argmax(2), MISSING - 1 - some[:, :, ::-1].argmax(2)
            at = first + cuts * np.maximum(last - first, 1) // PRIME
            ok &= np.arange(MISSING) == at[:, :, None]
        gain = np.where(ok, _worth(rules, la, lb) + _worth(rules, ra, rb), -np.inf).reshape(k, -1)
        top = gain.argmax(1)
        line = np.arange(k)
        j, cut = top // MISSING, top % MISSING
        value = gain[line, top] - _worth(rules, total_a, total_b)[:, 0]
        now = [value, tried[line, j], cut, np.full(k, missing_left),
               np.stack([x[line, j, cut] for x in (la, lb, ra, rb)], axis=1)]
        if best is None:
            best = now
        else:
            more = now[0] > best[0]
            best = [np.where(more if x.ndim == 1 else more[:, None], y, x) for x, y in zip(best, now)]
    least = max(rules.min_gain, 1e-12)
    return Splits(best[0] > least, best[1], best[2], best[3].astype(bool), best[0], best[4])


@dataclass
class Way:
    """Where rows go: from node n with bin x to `on`[n * BINS + x], which is n itself in a leaf."""

    feature: np.ndarray
    on: np.ndarray
    depth: int

    def walk(self, flat: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Last nodes of rows whose bins begin at `start` of `flat`."""
        if not self.depth:
            return np.zeros(len(start), np.int64)
        node = self.on.take(flat.take(start + self.feature[0]))
        for _ in range(self.depth - 1):
            node = self.on.take(node * BINS + flat.take(start + self.feature.take(node)))
        return node


@dataclass
class Tree:
    """Nodes in the order they were made; feature -1 is a leaf. a and b are the sums of a node, heap its number."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    heap: np.ndarray
    depth: np.ndarray
    a: np.ndarray
    b: np.ndarray
    gain: np.ndarray

    @staticmethod
    def root(a: float, b: float) -> Tree:
        i = lambda v: np.array([v], np.int64)
        return Tree(i(-1), i(0), np.array([False]), i(-1), i(1), i(0), np.array([a]), np.array([b]), np.array([0.0]))

    def split(self, nodes: np.ndarray, s: Splits) -> np.ndarray:
        """Splits those of `nodes` that can be; the new nodes, left and right of each in turn."""
        at, n = nodes[s.ok], int(s.ok.sum())
        self.feature[at], self.cut[at], self.missing_left[at] = s.feature[s.ok], s.cut[s.ok], s.missing_left[s.ok]
        self.gain[at] = s.gain[s.ok]
        first = len(self.feature)
        self.left[at] = first + 2 * np.arange(n)
        fresh = {"feature": np.full(2 * n, -1), "cut": np.zeros(2 * n, np.int64), "missing_left": np.zeros(2 * n, bool),
                 "left": np.full(2 * n, -1), "heap": (2 * self.heap[at, None] + np.arange(2)).ravel(),
                 "depth": np.repeat(self.depth[at] + 1, 2), "a": s.sides[s.ok][:, [0, 2]].ravel(),
                 "b": s.sides[s.ok][:, [1, 3]].ravel(), "gain": np.zeros(2 * n)}
        for name, new in fresh.items():
            setattr(self, name, np.concatenate([getattr(self, name), new]))
        return first + np.arange(2 * n)

    def open(self, nodes: np.ndarray, rules: Rules) -> np.ndarray:
        """Those of `nodes` that may be split: not too deep, not of one class, heavy enough."""
        mixed_ = (self.b[nodes] > 0) & (self.b[nodes] < self.a[nodes]) if rules.criterion != "newton" else True
        deep = self.depth[nodes] < min(rules.depth, 60)
        return nodes[deep & mixed_ & (self.a[nodes] >= 2 * rules.min_leaf)]

    def route(self, bins: np.ndarray, node: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """One step down for rows that stand in a split node."""
        f = self.feature[node]
        inner = np.flatnonzero(f >= 0)
        n = node[inner]
        x = bins[rows[inner], f[inner]]
        left = np.where(x == MISSING, self.missing_left[n], x <= self.cut[n])
        out = node.copy()
        out[inner] = self.left[n] + ~left
        return out

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        return self.way().walk(bins.ravel(), np.arange(len(bins)) * bins.shape[1])

    def way(self) -> Way:
        inner = self.feature >= 0
        x = np.arange(BINS)
        left = np.where(x == MISSING, self.missing_left[:, None], x <= self.cut[:, None])
        on = np.where(inner[:, None], self.left[:, None] + ~left, np.arange(len(inner))[:, None])
        return Way(np.maximum(self.feature, 0), on.ravel(), int(self.depth.max()))

    def cut_at(self, depth: int) -> Tree:
        """The tree that grows to this depth by the same rules; not for best-first trees, whose nodes aren't made level by level."""
        if not len(self.depth) or self.depth[-1] <= depth:
            return self
        n = int(np.searchsorted(self.depth, depth, side="right"))
        out = Tree(*[getattr(self, name)[:n].copy() for name in Tree.__dataclass_fields__])
        last = out.depth == depth
        out.feature[last], out.cut[last], out.missing_left[last], out.left[last], out.gain[last] = -1, 0, False, -1, 0.0
        return out

    def importance(self, d: int) -> np.ndarray:
        inner = self.feature >= 0
        out = np.bincount(self.feature[inner], self.gain[inner], d)
        return out / out.sum() if out.sum() > 0 else out


def grow_here(plan: Plan, bins: np.ndarray, a: np.ndarray, b: np.ndarray, columns: np.ndarray | None = None) -> Tree:
    """A tree over rows at hand; a: weights (or Hessians), b: weights of class 1 (or gradients). `columns`: `bins` by feature."""
    if not plan.rules.leaves:
        return grow_side_by_side([plan], bins, [(a, b)], columns)[0]
    rows = np.flatnonzero(a > 0)
    return _best_first(Tree.root(a[rows].sum(), b[rows].sum()), plan, bins, rows, a[rows], b[rows])


#: Nodes of at least so many rows are looked at one by one, each feature a column; smaller ones together.
ALONE = 1 << 10


def grow_side_by_side(plans: Sequence[Plan], bins: np.ndarray, stats: Sequence[tuple[np.ndarray, np.ndarray]],
                      columns: np.ndarray | None = None) -> list[Tree]:
    """Trees of equal rules and numbers of features over rows at hand, a level of all of them at a time. `columns`: `bins` by
    feature. Rows are kept by node: a large node has arrays of its own, the small ones share theirs."""
    rules, rows_in_all = plans[0].rules, bins.shape[0]
    columns = np.ascontiguousarray(bins.T) if columns is None else columns
    flat = columns.ravel()
    total, large, small = np.zeros((2, len(plans))), {}, []
    whole = all(pack(rules, a, b) is not None for a, b in stats)
    for i, (a, b) in enumerate(stats):
        rows = np.flatnonzero(a > 0)
        a, b = a[rows], b[rows]
        total[:, i] = a.sum(), b.sum()
        _put(large, small, i, rows, (pack(rules, a, b),) if whole else (a, b))
    n = len(plans)
    grove = Tree(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool), np.full(n, -1), np.ones(n, np.int64), np.zeros(n, np.int64),
                 total[0], total[1], np.zeros(n))
    tree = np.arange(n)
    active = grove.open(np.arange(n), rules)
    while len(active):
        k = len(active)
        slot = np.full(len(grove.feature), -1, np.int64)
        slot[active] = np.arange(k)
        ends = np.flatnonzero(np.append(True, np.diff(tree[active]) != 0)).tolist() + [k]
        parts = [(plans[tree[active[x]]], grove.heap[active[x:y]]) for x, y in zip(ends[:-1], ends[1:])]
        tried = np.concatenate([p.tried(h) for p, h in parts])
        cuts = np.concatenate([p.cuts(h, p.tried(h)) for p, h in parts]) if rules.splitter == "random" else None
        sums_ = np.zeros((1 if whole else 2, k, tried.shape[1], BINS))
        large = {v: x for v, x in large.items() if slot[v] >= 0}
        for v, (rows, weights) in large.items():
            at = slot[v]
            for j, f in enumerate(tried[at].tolist()):
                x = columns[f].take(rows)
                for to, w in zip(sums_, weights):
                    to[at, j] = np.bincount(x, w, BINS)
        together = _together(small, slot)
        if together is not None:
            node, rows, weights = together
            at = slot.take(node)
            base = at * BINS
            for j in range(tried.shape[1]):
                cell = (tried[:, j] * rows_in_all).take(at)
                cell += rows
                cell = base + flat.take(cell)
                for to, w in zip(sums_, weights):
                    to[:, j] += np.bincount(cell, w, k * BINS).reshape(k, BINS)
        if whole:
            sb = np.floor(sums_[0] / (1 << 26))
            sa = sums_[0] - sb * (1 << 26)
        else:
            sa, sb = sums_
        split = choose(sa, sb, tried, rules, cuts)
        made = grove.split(active, split)
        tree = np.concatenate([tree, np.repeat(tree[active[split.ok]], 2)])
        left_at = np.full(k, -1, np.int64)
        left_at[split.ok] = made[::2]
        small, before = [], large
        deep = rules.depth <= grove.depth[-1]  # the nodes just made stay leaves, no one asks for their rows
        large = {}
        for v, (rows, weights) in before.items() if not deep else ():
            at = slot[v]
            if not split.ok[at]:
                continue
            x = columns[split.feature[at]].take(rows)
            left = x <= split.cut[at]
            if split.missing_left[at]:
                left |= x == MISSING
            for side, some in enumerate((np.flatnonzero(left), np.flatnonzero(~left))):
                _put(large, small, int(left_at[at]) + side, rows.take(some), tuple(w.take(some) for w in weights))
        if together is not None and not deep:
            node, rows, weights = together
            at = slot.take(node)
            went = split.ok.take(at)
            if not went.all():
                some = np.flatnonzero(went)
                at, rows, weights = at.take(some), rows.take(some), tuple(w.take(some) for w in weights)
            x = flat.take(split.feature.take(at) * rows_in_all + rows)
            left = np.where(x == MISSING, split.missing_left.take(at), x <= split.cut.take(at))
            small.append((left_at.take(at) + ~left, rows, weights))
        active = grove.open(made, rules)
    out = []
    for i in range(n):
        mine = np.flatnonzero(tree == i)
        place = np.full(len(tree), -1, np.int64)
        place[mine] = np.arange(len(mine))
        t = Tree(*[getattr(grove, name)[mine] for name in Tree.__dataclass_fields__])
        t.left = np.where(t.left >= 0, place[t.left], -1)
        out.append(t)
    return out


def _put(large: dict, small: list, node: int, rows: np.ndarray, weights: tuple) -> None:
    """Rows of a node go where nodes of their number are kept."""
    if len(rows) >= ALONE:
        large[node] = rows, weights
    else:
        small.append((np.full(len(rows), node), rows, weights))


def _together(small: list, slot: np.ndarray) -> tuple | None:
    """The rows of the small nodes that have a slot: nodes, rows and weights in one array each."""
    if not small:
        return None
    node, rows = (np.concatenate([x[i] for x in small]) for i in (0, 1))
    weights = tuple(np.concatenate(w) for w in zip(*[x[2] for x in small]))
    some = np.flatnonzero(slot.take(node) >= 0)
    if len(some) < len(node):
        node, rows, weights = node.take(some), rows.take(some), tuple(w.take(some) for w in weights)
    return (node, rows, weights) if len(node) else None


def _hist(plan, tree, nodes, bins, rows, slot, a, b):
    tried = plan.tried(tree.heap[nodes])
    inside = slot >= 0
    return tried, *sums(bins[rows[inside]], slot[inside], tried, a[inside], b[inside])


def _split_of(plan, tree, nodes, tried, a, b) -> Splits:
    cuts = plan.cuts(tree.heap[nodes], tried) if plan.rules.splitter == "random" else None
    return choose(a, b, tried, plan.rules, cuts)


def _best_first(tree: Tree, plan: Plan, bins, rows, a, b) -> Tree:
    """The leaf whose split gains most is split next (a priority queue) until there are `leaves` leaves."""
    of = {0: np.arange(len(rows))}
    queue: list = []

    def look(nodes):
        nodes = tree.open(nodes, plan.rules)
        for n in nodes.tolist():
            at = of[n]
            one = np.array([n])
            s = _split_of(plan, tree, one, *_hist(plan, tree, one, bins, rows[at], np.zeros(len(at), np.int64), a[at], b[at]))
            if s.ok[0]:
                heapq.heappush(queue, (-float(s.gain[0]), n, s))

    look(np.zeros(1, np.int64))
    leaves = 1
    while queue and leaves < plan.rules.leaves:
        _, n, s = heapq.heappop(queue)
        made = tree.split(np.array([n]), s)
        at = of.pop(n)
        went = tree.route(bins, np.full(len(at), n), rows[at])
        of[int(made[0])], of[int(made[1])] = at[went == made[0]], at[went == made[1]]
        look(made)
        leaves += 1
    return tree


# ---- tables -------------------------------------------------------------------------------------

@dataclass
class Binned:
    """`table`: key, h, y, bins, member (stored); `local`: the same as arrays, if small enough."""

    table: DataFrame
    edges: list[np.ndarray]
    key: str
    local: dict[str, np.ndarray] | None = None
    _shipped: object = field(default=None, repr=False)

    @property
    def d(self) -> int:
        return len(self.edges)

    def shipped(self):
        if self._shipped is None:
            self._shipped = self.table.sparkSession.sparkContext.broadcast(self.local)
        return self._shipped


def edges_of(table: DataFrame, features: str = "features", bins: int = MISSING) -> list[np.ndarray]:
    """At most `bins` - 1 cuts per feature: exact quantiles of the values that aren't missing, to nine decimals."""
    long = table.select(F.posexplode(vector_to_array(features)).alias("i", "x"))
    last = long.agg(F.max("i")).first()[0]
    d = 0 if last is None else last + 1
    probs = {f"q{j}": j / bins for j in range(1, bins)}
    got = quantiles(long.where(~F.isnan("x")), ["i"], "x", probs).collect()  # a row per feature
    rows = {r["i"]: np.unique(np.round([r[q] for q in probs], 9)) for r in got}
    return [rows.get(i, np.zeros(0)) for i in range(d)]


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of a value: the number of cuts below it; NaN has a bin of its own."""
    out = np.empty(x.shape, np.uint8)
    for i, e in enumerate(edges):
        out[:, i] = np.searchsorted(e, x[:, i], side="left")
    out[np.isnan(x)] = MISSING
    return out


def bin_table(table: DataFrame, key: str, members: Sequence[Column] = (), carry: Sequence[str] = (),
              edges: list[np.ndarray] | None = None, local_bytes: int = LOCAL_BYTES) -> Binned:
    """Bin `table` (key, label, features). `members` are boolean columns: the training sets plans may name."""
    edges = edges_of(table) if edges is None else edges
    d, s = len(edges), len(members)
    kept = list(dict.fromkeys([key, *carry]))

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, d)
            bins = to_bins(x, edges)
            off = pa.py_buffer(np.arange(n + 1, dtype=np.int32) * d)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.Array.from_buffers(pa.binary(), n, [None, off, pa.py_buffer(bins)]),
                 *batch.columns[3:]], names=["h", "y", "bins", *batch.schema.names[3:]])

    kinds = {f.name: f.dataType.simpleString() for f in table.schema}
    rows = table.where(F.col("label").isNotNull()).select(hash32(F.col(key), 0).alias("h"), F.col("label").cast("double").alias("y"),
                        vector_to_array("features").alias("x"), F.array(*members).cast("array<boolean>").alias("member"),
                        *[F.col(c) for c in kept])
    schema = "h long, y double, bins binary, member array<boolean>, " + ", ".join(f"`{c}` {kinds[c]}" for c in kept)
    stored = materialise(rows.mapInArrow(run, schema), "binned")
    out = Binned(stored, edges, key)
    if stored.count() * (d + s + 32) <= local_bytes:
        got = stored.select("h", "y", "bins", "member").orderBy("h", "y", "bins").toArrow()
        out.local = arrays(got.combine_chunks(), d, s)
    return out


def _bytes(column) -> np.ndarray:
    """The bytes of a binary column, end to end."""
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8)
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], wide)[column.offset: column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0]: ends[-1]]


def blocks(batches, d: int, s: int, size: int = 1 << 16) -> Iterator[dict[str, np.ndarray]]:
    """The rows of all batches, at least `size` at a time: what is done once per tree and block costs little per row then."""
    held, n = [], 0
    for batch in batches:
        held.append(arrays(batch, d, s))
        n += batch.num_rows
        if n >= size:
            yield {c: np.concatenate([x[c] for x in held]) for c in held[0]}
            held, n = [], 0
    if n:
        yield {c: np.concatenate([x[c] for x in held]) for c in held[0]}


def arrays(batch, d: int, s: int) -> dict[str, np.ndarray]:
    n = batch.num_rows
    column = lambda c: batch.column(c).combine_chunks() if isinstance(batch.column(c), pa.ChunkedArray) else batch.column(c)
    out = {"h": column("h").to_numpy(zero_copy_only=False),
           "y": column("y").to_numpy(zero_copy_only=False),
           "bins": _bytes(column("bins")).reshape(n, d),
           "member": column("member").flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(n, s)}
    if "w" in batch.schema.names:
        out["w"] = _bytes(column("w")).reshape(n, -1) if n else np.zeros((0, 1), np.uint8)
    if "margin" in batch.schema.names:
        out["margin"] = column("margin").to_numpy(zero_copy_only=False)
    return out


def by_column(table: dict[str, np.ndarray]) -> np.ndarray:
    """The bins of rows at hand by feature, made once."""
    if "columns" not in table:
        table["columns"] = np.ascontiguousarray(table["bins"].T)
    return table["columns"]


# ---- growing many -------------------------------------------------------------------------------

def share_out(binned: Binned, items: Sequence, work: Callable[[dict, object], object]) -> list:
    """`work`(arrays, item) of every item, in tasks; the table is small and shipped once. Results come in order."""
    spark = binned.table.sparkSession
    shipped = binned.shipped()
    slots = spark.sparkContext.defaultParallelism
    many = spark.sparkContext.broadcast(list(items))

    def run(batches):
        import pickle
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i]), pa.array([pickle.dumps(work(shipped.value, many.value[i]))], pa.binary())], names=["i", "r"])

    import pickle
    parts = max(1, min(len(items), 4 * slots))
    got = spark.range(0, len(items), 1, parts).toDF("i").mapInArrow(run, "i long, r binary").collect()
    many.unpersist()
    return [pickle.loads(r["r"]) for r in sorted(got, key=lambda r: r["i"])]


def grow(binned: Binned, plans: Sequence[Plan]) -> list[Tree]:
    """Classification trees of all plans. The trees come to the driver: their size is set by plans and depth. Plans that differ
    by their depth only are the upper levels of one tree, which is grown once."""
    def but_depth(p: Plan) -> Plan:
        return p if p.rules.leaves else replace(p, rules=replace(p.rules, depth=-1))

    deepest: dict[Plan, Plan] = {}
    for p in plans:
        at = deepest.setdefault(but_depth(p), p)
        if p.rules.depth > at.rules.depth:
            deepest[but_depth(p)] = p
    grown = dict(zip(deepest, _grow_each(binned, list(deepest.values()))))
    return [grown[but_depth(p)] if p.rules.leaves else grown[but_depth(p)].cut_at(p.rules.depth) for p in plans]


def _grow_each(binned: Binned, plans: Sequence[Plan]) -> list[Tree]:
    if not plans:
        return []
    if binned.local is not None:
        def work(table, group):
            weights = [p.weights(table["h"], table["member"]) for p in group]
            stats = [(w, w * table["y"]) for w in weights]
            if group[0].rules.leaves:
                return [grow_here(p, table["bins"], *x) for p, x in zip(group, stats)]
            return grow_side_by_side(group, table["bins"], stats, by_column(table))
        return [t for g in share_out(binned, _alike(binned, plans), work) for t in g]
    out = []
    for at in range(0, len(plans), TOGETHER):
        out += _grow_drawn(binned, plans[at: at + TOGETHER])
    return out


#: Trees whose row weights are written at a time, a byte for each row and tree.
TOGETHER = 128


def _grow_drawn(binned: Binned, plans: Sequence[Plan]) -> list[Tree]:
    """`grow_apart` with weights that are drawn once, not for every level."""
    s = len(binned.table.select("member").first()[0]) if binned.table.take(1) else 0
    d, column = binned.d, {p: i for i, p in enumerate(plans)}

    def run(batches):
        for batch in batches:
            t = arrays(batch, d, s)
            w = np.empty((batch.num_rows, len(plans)), np.uint8)
            for i, p in enumerate(plans):
                w[:, i] = p.weights(t["h"], t["member"])
            ends = pa.py_buffer(np.arange(batch.num_rows + 1, dtype=np.int32) * len(plans))
            drawn = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, ends, pa.py_buffer(w)])
            yield pa.RecordBatch.from_arrays([*batch.columns, drawn], names=[*batch.schema.names, "w"])

    rows = binned.table.select("h", "y", "bins", "member")
    drawn = materialise(rows.mapInArrow(run, "h long, y double, bins binary, member array<boolean>, w binary"), "drawn")
    try:
        return grow_apart(Binned(drawn, binned.edges, binned.key), plans, lambda p, table: (table["w"][column[p]], None))
    finally:
        discard(drawn)


#: Rows that a task holds at once, counted for each tree.
AT_ONCE = 200_000


def _alike(binned: Binned, plans: Sequence[Plan]) -> list[list[Plan]]:
    """Runs of plans that can grow side by side, in order."""
    slots = binned.table.sparkSession.sparkContext.defaultParallelism
    size = max(1, min(AT_ONCE // max(1, len(binned.local["y"])), -(-len(plans) // slots)))
    out: list[list[Plan]] = []
    for p in plans:
        if out and len(out[-1]) < size and out[-1][0].rules == p.rules and len(out[-1][0].features) == len(p.features) and not p.rules.leaves:
            out[-1].append(p)
        else:
            out.append([p])
    return out


def grow_apart(binned: Binned, plans: Sequence[Plan], stats: Callable[[Plan, dict], tuple[np.ndarray, np.ndarray]],
               cells: int = CELLS) -> list[Tree]:
    """Level by level over a table of any size. `stats`(plan, arrays of a block) gives a and b of its rows; b None is a of class 1.

    Best-first trees look ahead: a pass adds up the children of every leaf that may still be split, so a tree takes about as
    many passes as it is deep, not one for each of its leaves. Which leaves are split follows from the gains alone."""
    s = len(binned.table.select("member").first()[0]) if binned.table.take(1) else 0
    trees = [Tree.root(0.0, 0.0) for _ in plans]
    seen: list[dict[int, Splits]] = [{} for _ in plans]
    best: dict[int, Tree] = {}
    active, at_root = {i: np.zeros(1, np.int64) for i in range(len(plans))}, True
    while active:
        found: dict[int, list] = {}
        for part in _passes(active, plans, cells):
            for i, nodes, split in _splits(binned, plans, trees, part, stats, s):
                found.setdefault(i, []).append((nodes, split))
        active = {}
        for i, parts in sorted(found.items()):
            parts.sort(key=lambda x: x[0][0])
            nodes = np.concatenate([n for n, _ in parts])
            split = Splits(*[np.concatenate([getattr(x, f) for _, x in parts]) for f in Splits.__dataclass_fields__])
            tree, rules = trees[i], plans[i].rules
            if at_root:
                tree.a[0], tree.b[0] = split.sides[0, 0] + split.sides[0, 2], split.sides[0, 1] + split.sides[0, 3]
                split.ok &= len(tree.open(nodes, rules)) > 0
            if rules.leaves:
                seen[i].update((n, split.part(slice(j, j + 1))) for j, n in enumerate(nodes.tolist()))
                best[i], now = _ahead(tree, seen[i], rules)
            else:
                now = tree.open(tree.split(nodes, split), rules)
            if len(now):
                active[i] = now
        at_root = False
    return [best.get(i, t) for i, t in enumerate(trees)]


def _ahead(tree: Tree, seen: dict[int, Splits], rules: Rules) -> tuple[Tree, np.ndarray]:
    """The best-first tree as far as it is known, and the nodes of `tree` to look at next. `tree` holds that tree and nodes
    made ahead; `seen` has the best split of the nodes looked at."""
    out, queue, leaves = Tree.root(tree.a[0], tree.b[0]), [], 1
    if seen[0].ok[0]:
        queue.append((-float(seen[0].gain[0]), 0, 0))
    while queue and leaves < rules.leaves:
        _, place, n = queue[0]
        if tree.feature[n] < 0:  # its children are unknown: so are those of the next in line
            now = []
            for _, _, m in heapq.nsmallest(rules.leaves - leaves, queue):
                if tree.feature[m] < 0:
                    now.append(tree.open(tree.split(np.array([m]), seen[m]), rules))
            now = np.concatenate(now)
            if len(now):
                return out, now
            continue
        heapq.heappop(queue)
        made = out.split(np.array([place]), seen[n])
        for side in (0, 1):
            child = int(tree.left[n]) + side
            if child in seen:
                if seen[child].ok[0]:
                    heapq.heappush(queue, (-float(seen[child].gain[0]), int(made[side]), child))
            elif len(tree.open(np.array([child]), rules)):
                raise AssertionError("a child that wasn't looked at")
        leaves += 1
    return out, np.zeros(0, np.int64)


def _passes(active: dict[int, np.ndarray], plans: Sequence[Plan], cells: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The open nodes in parts whose sums have at most `cells` cells (or are of one node)."""
    part: list[tuple[int, np.ndarray]] = []
    room = cells
    for i, nodes in active.items():
        each = BINS * plans[i].rules.count(len(plans[i].features))
        while len(nodes):
            if part and room < each:
                yield part
                part, room = [], cells
            n = max(1, room // each)
            part.append((i, nodes[:n]))
            room -= each * len(nodes[:n])
            nodes = nodes[n:]
    if part:
        yield part


@dataclass
class _Open:
    """The open nodes of one tree that a pass looks at; their sums begin at cell `first`."""

    plan: Plan
    way: tuple
    nodes: np.ndarray
    heap: np.ndarray
    first: int

    @property
    def each(self) -> int:
        return BINS * self.plan.rules.count(len(self.plan.features))


#: Cells of a piece of the sums: pieces are what tasks exchange.
PIECE = 1 << 14


def _splits(binned: Binned, plans, trees, part, stats, s) -> Iterator[tuple[int, np.ndarray, Splits]]:
    """Best splits of the open nodes of `part`: every task adds up its rows, pieces of the sums are added and looked at by
    other tasks, and only the splits come back. A node without a split has its sums on the left."""
    spark, d = binned.table.sparkSession, binned.d
    jobs, first = [], 0
    for i, nodes in part:
        t = trees[i]
        jobs.append(_Open(plans[i], (t.feature, t.cut, t.missing_left, t.left, t.depth), nodes, t.heap[nodes], first))
        first += len(nodes) * jobs[-1].each
    cuts = _pieces(jobs, first)
    shared = spark.sparkContext.broadcast((jobs, cuts))

    def add(batches):
        jobs, cuts = shared.value
        total = np.zeros((2, cuts[-1]))
        ways, slots, tried = [], [], []
        for job in jobs:
            f, cut, missing_left, left, depth = job.way
            ways.append(Tree(f, cut, missing_left, left, f, depth, f, f, f).way())
            slots.append(np.full(len(f), -1, np.int64))
            slots[-1][job.nodes] = np.arange(len(job.nodes))
            tried.append(job.plan.tried(job.heap))
        some = False
        for table in blocks(batches, d, s):
            some, flat = True, table["bins"].ravel()
            if "w" in table:
                table["w"] = np.ascontiguousarray(table["w"].T)
            for job, way, slot, look in zip(jobs, ways, slots, tried):
                a, b = stats(job.plan, table)
                rows = np.flatnonzero(a > 0)
                at = slot.take(way.walk(flat, rows * d))
                inside = np.flatnonzero(at >= 0)
                rows, at = rows[inside], at[inside]
                a = a[rows].astype(np.float64)
                b = a * table["y"][rows] if b is None else b[rows]
                end = job.first + len(job.nodes) * job.each
                for to, x in zip(total, added(flat, rows * d, at, look, a, b, pack(job.plan.rules, a, b))):
                    to[job.first: end] += x.ravel()
        if some:
            for p, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
                yield pa.RecordBatch.from_arrays([pa.array([p]), *[pa.array([_short(t[x:y])], pa.binary()) for t in total]], names=["p", "a", "b"])

    def look(batches):
        jobs, cuts = shared.value
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, a, b in zip(*[c.to_pylist() for c in batch.columns]):
                now = sums.setdefault(p, np.zeros((2, cuts[p + 1] - cuts[p])))
                now[0] += _long(a)
                now[1] += _long(b)
        for p, total in sums.items():
            for j, job in enumerate(jobs):
                x = max(cuts[p], job.first)
                y = min(cuts[p + 1], job.first + len(job.nodes) * job.each)
                if x >= y:
                    continue
                here = slice((x - job.first) // job.each, (y - job.first) // job.each)
                heap, rules = job.heap[here], job.plan.rules
                tried = job.plan.tried(heap)
                a, b = (t[x - cuts[p]: y - cuts[p]].reshape(*tried.shape, BINS) for t in total)
                at = job.plan.cuts(heap, tried) if rules.splitter == "random" else None
                r = choose(a, b, tried, rules, at)
                r.sides[~r.ok] = np.stack([a[:, 0].sum(1), b[:, 0].sum(1), 0 * r.gain, 0 * r.gain], axis=1)[~r.ok] if (~r.ok).any() else 0.0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(heap), j)), pa.array(np.arange(here.start, here.stop)), pa.array(r.ok), pa.array(r.feature.astype(np.int64)),
                     pa.array(r.cut.astype(np.int64)), pa.array(r.missing_left), pa.array(np.where(r.ok, r.gain, 0.0)), *[pa.array(c) for c in r.sides.T.copy()]],
                    names=["j", "slot", "ok", "f", "cut", "m", "gain", "la", "lb", "ra", "rb"])

    rows = binned.table.select("h", "y", "bins", "member", *[c for c in binned.table.columns if c in ("margin", "w")])
    tasks = max(1, min(len(cuts) - 1, 2 * spark.sparkContext.defaultParallelism))
    got = rows.mapInArrow(add, "p long, a binary, b binary").repartition(tasks, "p").mapInArrow(
        look, "j long, slot long, ok boolean, f long, cut long, m boolean, gain double, la double, lb double, ra double, rb double").toArrow()
    shared.destroy()
    c = {x: got.column(x).to_numpy() for x in got.column_names}
    order = np.lexsort((c["slot"], c["j"]))
    c = {x: v[order] for x, v in c.items()}
    split = Splits(c["ok"].astype(bool), c["f"], c["cut"], c["m"].astype(bool), c["gain"], np.stack([c[x] for x in ("la", "lb", "ra", "rb")], axis=1))
    ends = np.searchsorted(c["j"], np.arange(len(jobs) + 1))
    for j, (i, nodes) in enumerate(part):
        mine = slice(ends[j], ends[j + 1])
        if mine.start < mine.stop:
            yield i, nodes[c["slot"][mine]], split.part(mine)


def _pieces(jobs: Sequence[_Open], cells: int) -> np.ndarray:
    """Bounds of the pieces, about PIECE cells each; a node is never cut."""
    starts = np.concatenate([job.first + job.each * np.arange(len(job.nodes)) for job in jobs])
    new = np.flatnonzero(np.diff(starts // PIECE)) + 1
    return np.concatenate([[0], starts[new], [cells]])


def _short(x: np.ndarray) -> bytes:
    """Sums as bytes, whole numbers in as few as they need; the first byte says which."""
    most = x.max(initial=0.0)
    kind = 0 if (x < 0).any() or (x != np.floor(x)).any() else 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 0
    return bytes([kind]) + x.astype(_KINDS[kind]).tobytes()


def _long(x: bytes) -> np.ndarray:
    return np.frombuffer(x, _KINDS[x[0]], offset=1).astype(np.float64)


_KINDS = {0: "<f8", 1: "<u1", 2: "<u2", 4: "<u4"}


# ---- ensembles ----------------------------------------------------------------------------------

@dataclass
class Forest:
    """Trees and the value of each of their nodes. `link`: the score is the mean of the values, the logistic of `start` and
    `rate` times their sum, or the share of the `votes` (signed weights) for class 1."""

    edges: list[np.ndarray]
    trees: list[Tree]
    values: list[np.ndarray]
    link: str = "mean"
    rate: float = 1.0
    start: float = 0.0

    def scores(self, bins: np.ndarray) -> np.ndarray:
        total = np.zeros(len(bins))
        for t, v in zip(self.trees, self.values):
            total += v[t.leaf(bins)]
        if self.link == "mean":
            return total / max(1, len(self.trees))
        if self.link == "votes":
            return (total / max(sum(abs(v[0]) for v in self.values), 1e-300) + 1.0) / 2.0
        return 1.0 / (1.0 + np.exp(-(self.start + self.rate * total)))

    def importance(self) -> np.ndarray:
        each = sum((t.importance(len(self.edges)) for t in self.trees), np.zeros(len(self.edges)))
        return each / each.sum() if each.sum() > 0 else each


def forest_of(edges: list[np.ndarray], trees: list[Tree]) -> Forest:
    return Forest(edges, trees, [np.where(t.a > 0, t.b / np.maximum(t.a, 1e-300), 0.5) for t in trees])


def forest_plans(n: int, seed: int, rules: Rules, features: Sequence[int], member: int | None = None,
                 bootstrap: bool = True) -> list[Plan]:
    return [Plan(seed, i, rules, tuple(features), member, bootstrap) for i in range(n)]


def grow_forests(binned: Binned, groups: Sequence[Sequence[Plan]]) -> list[Forest]:
    """One forest per group of plans, all grown together."""
    trees = grow(binned, [p for g in groups for p in g])
    out, at = [], 0
    for g in groups:
        out.append(forest_of(binned.edges, trees[at: at + len(g)]))
        at += len(g)
    return out


def score_column(model: Forest, spark) -> Column:
    """Score of a row from its `features` vector."""
    shipped = spark.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shipped.value
        for v in parts:
            yield pd.Series(m.scores(to_bins(np.stack(v.to_numpy()), m.edges)) if len(v) else np.zeros(0))
    return scored(vector_to_array("features"))


def fold_scores(binned: Binned, forests: dict[int, Forest], fold: str) -> DataFrame:
    """The binned table's columns and `score`: each row scored by the forest of its `fold` (a carried column)."""
    shipped = binned.table.sparkSession.sparkContext.broadcast(forests)
    d, kept = binned.d, [c for c in binned.table.columns if c not in ("bins", "member")]

    def run(batches):
        for batch in batches:
            bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, d)
            f = batch.column(fold).to_numpy(zero_copy_only=False)
            score = np.full(batch.num_rows, np.nan)
            for k in np.unique(f):
                score[f == k] = shipped.value[int(k)].scores(bins[f == k])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(score)], names=[*kept, "score"])

    kinds = {x.name: x.dataType.simpleString() for x in binned.table.schema}
    return binned.table.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", score double")


def held_hits(binned: Binned, forests: Sequence[tuple[Forest, int]]) -> list[tuple[int, int]]:
    """(right answers, rows) of each forest over the rows outside its training set."""
    shipped = binned.table.sparkSession.sparkContext.broadcast(list(forests))
    d, s = binned.d, len(binned.table.select("member").first()[0])

    def run(batches):
        total = np.zeros((len(shipped.value), 2), np.int64)
        for batch in batches:
            t = arrays(batch, d, s)
            for i, (forest, member) in enumerate(shipped.value):
                out = ~t["member"][:, member]
                total[i] += [int((predicted(forest.scores(t["bins"][out])) == t["y"][out]).sum()), int(out.sum())]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total[:, 0]), pa.array(total[:, 1])],
                                         names=["i", "hits", "n"])

    got = binned.table.select("h", "y", "bins", "member").mapInArrow(run, "i long, hits long, n long").groupBy("i").agg(
        F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect()
    by = {r["i"]: (r["hits"], r["n"]) for r in got}
    return [by.get(i, (0, 0)) for i in range(len(forests))]


def predicted(score: np.ndarray) -> np.ndarray:
    return (np.round(score, 9) > 0.5).astype(np.int64)


# ---- leaving rows out ---------------------------------------------------------------------------

#: Rows (members of nodes and rows held out) that a batch of nodes holds at once, cells of sums looked at together, and rows
#: that look up their splits together.
HELD_ROWS, HELD_CELLS, LOOK_UP = 1 << 20, 1 << 20, 1 << 18


def left_out_here(plan: Plan, bins: np.ndarray, a: np.ndarray, b: np.ndarray, fold: np.ndarray, block: int | None = None,
                  wanted: np.ndarray | None = None) -> np.ndarray:
    """Value for every row by the tree grown without the rows of its fold; with `wanted`, for those rows at least.

    Such a tree isn't grown whole. A node is named by the splits that lead to it; all folds that come to a node share the
    sums over its rows, and each takes off its own rows. Only the nodes that a fold's rows come to are looked at. Where a fold
    chooses another split than the others it has nodes of its own from there on. What is best without a single row depends on
    its weight, its class and, for each feature, its bin only, so that is worked out once for all rows of a node (`_without`).
    Folds of several rows take off their sums one by one, `block` at a time.
    """
    rules, d, flat = plan.rules, bins.shape[1], bins.ravel()
    out = np.full(len(bins), 0.5)
    size = np.bincount(fold, minlength=int(fold.max(initial=-1)) + 1)
    held = np.arange(len(bins)) if wanted is None else np.flatnonzero(np.isin(fold, fold[wanted]))
    lone = (size[fold] == 1) & (rules.splitter != "random")
    packed = pack(rules, a, b)
    if packed is None:
        kinds, kind = np.unique(np.stack([a, b]), axis=1, return_inverse=True)
        kind = kind.reshape(-1)
    else:
        most = int(b.max(initial=0)) + 1
        kinds, kind = _codes((a * most + b).astype(np.int64), (int(a.max(initial=0)) + 1) * most)
        kinds = np.stack(np.divmod(kinds, most)).astype(np.float64)
    lone_kinds, several = kinds.shape[1], np.cumsum(size > 1) - 1  # numbers of the folds of several rows
    marks = lone_kinds + (len(size) if rules.splitter == "random" else int((size > 1).sum()))
    mark = np.where(lone, kind, lone_kinds + (fold if rules.splitter == "random" else several[fold]))
    rows = np.flatnonzero(a > 0)
    # a batch of nodes: their rows and the node of each, their heap numbers, the held rows and the node of each, the depth
    todo = [(rows, np.zeros(len(rows), np.int64), np.ones(1, np.int64), held, np.zeros(len(held), np.int64), 0)]
    while todo:
        rows, node, heap, row, at, depth = todo.pop()
        if not len(row):
            continue
        k = len(heap)
        total = [np.bincount(node, x.take(rows), k) for x in (a, b)]
        # a state: a node and what is taken off it, a kind of row or a fold
        states, of = _codes(at * marks + mark.take(row), k * marks)
        where, what = np.divmod(states, marks)
        alone = what < lone_kinds
        off = [x[np.where(alone, what, 0)] for x in kinds]
        if not alone.all():
            off = [np.where(alone, x, np.bincount(of, v[row], len(states))) for x, v in zip(off, (a, b))]
        wa, wb = total[0][where] - off[0], total[1][where] - off[1]
        pure = (wb <= 0) | (wb >= wa) if rules.criterion != "newton" else np.zeros(len(wa), bool)
        go = ~pure & (depth < rules.depth) & (wa >= 2 * rules.min_leaf)
        value = np.where(wa > 0, wb / np.maximum(wa, 1e-300), 0.5)
        # nodes in which some state goes on, and the states that do
        open_ = np.zeros(k, bool)
        open_[where[go]] = True
        new_node, new_state = np.cumsum(open_) - 1, np.cumsum(go) - 1
        if not go.all():
            on = go.take(of)
            ends, on = np.flatnonzero(~on), np.flatnonzero(on)
            out[row.take(ends)] = value.take(of.take(ends))
            row, at, of = row.take(on), new_node.take(at.take(on)), new_state.take(of.take(on))
        if not len(row):
            continue
        value, where, alone = value[go], new_node[where[go]], alone[go]
        off = [x[go] for x in off]
        if not open_.all():
            inside = np.flatnonzero(open_.take(node))
            rows, node, heap = rows.take(inside), new_node.take(node.take(inside)), heap[open_]
        tried = plan.tried(heap)
        cuts = plan.cuts(heap, tried) if rules.splitter == "random" else None
        feature, cut = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        missing_left, ok = np.zeros(len(row), bool), np.zeros(len(row), bool)
        m = tried.shape[1]
        span = max(1, HELD_CELLS // (m * BINS))
        short = np.uint16 if len(where) < 1 << 16 else np.int64  # these sort in linear time
        order = np.argsort(of.astype(short), kind="stable")
        ends_of = np.cumsum(np.bincount(of, minlength=len(where)))
        for first in range(0, len(heap), span):  # nodes: their sums are added up a part at a time
            last = min(first + span, len(heap))
            part = np.flatnonzero((node >= first) & (node < last)) if span < len(heap) else slice(None)
            r = rows[part]
            sums_ = added(flat, r * d, node[part] - first, tried[first:last], None if packed is not None else a.take(r),
                          None if packed is not None else b.take(r), None if packed is None else packed.take(r))
            mine = np.flatnonzero((where >= first) & (where < last))
            for some, one in ((mine[alone[mine]], True), (mine[~alone[mine]], False)):
                step = span if one or block is None else max(1, min(span, block))
                for x in range(0, len(some), step):
                    now = some[x: x + step]
                    begin = ends_of[now - 1] * (now > 0)
                    took = order[runs_of(begin, ends_of[now] - begin)]
                    number = np.repeat(np.arange(len(now)), ends_of[now] - begin)
                    n, sa, sb = where[now], sums_[0][where[now] - first], sums_[1][where[now] - first]
                    if one:
                        found = _without(sa, sb, off[0][now], off[1][now], rules)
                        for z in range(0, len(took), LOOK_UP):
                            t = took[z: z + LOOK_UP]
                            feature[t], cut[t], missing_left[t], ok[t] = _look_up(
                                found, number[z: z + LOOK_UP], flat, row.take(t) * d, tried[n], max(rules.min_gain, 1e-12))
                    else:
                        oa, ob = sums(bins[row[took]], number, tried[n], a[row[took]], b[row[took]])
                        split = choose(sa - oa, sb - ob, tried[n], rules, None if cuts is None else cuts[n])
                        feature[took], cut[took] = split.feature[number], split.cut[number]
                        missing_left[took], ok[took] = split.missing_left[number], split.ok[number]
        if not ok.all():
            out[row[~ok]] = value[of[~ok]]
            ok = np.flatnonzero(ok)
            row, at, feature, cut, missing_left = (x.take(ok) for x in (row, at, feature, cut, missing_left))
        if not len(row):
            continue
        seen = flat.take(row * d + feature)
        right = seen > cut
        if missing_left.any():
            right &= ~((seen == MISSING) & missing_left)
        # a way: a node and a split that some fold chose there; its sides are the next nodes
        way = ((at * d + feature) * BINS + cut) * 2 + missing_left
        ways, of = _codes(way, len(heap) * d * BINS * 2)
        of = of * 2 + right
        used = np.zeros(2 * len(ways), bool)
        used[of] = True
        wf, wc, wm, wn = ways // (2 * BINS) % d, ways // 2 % BINS, ways % 2 == 1, ways // (2 * BINS * d)
        sides_rows, sides = [], []
        begin = np.searchsorted(wn, np.arange(len(heap)))
        many = np.bincount(wn, minlength=len(heap))
        turn = 0
        while len(rows):  # the first way of every node, then the second of those that have one, ...
            here = many.take(node) > turn
            if not here.all():
                here = np.flatnonzero(here)
                rows, node = rows.take(here), node.take(here)
            if not len(rows):
                break
            w = begin.take(node) + turn
            x = flat.take(rows * d + wf.take(w))
            right_side = x > wc.take(w)
            if wm.any():
                right_side &= ~((x == MISSING) & wm.take(w))
            side = 2 * w + right_side
            keep = used.take(side)
            if not keep.all():
                keep = np.flatnonzero(keep)
                side = side.take(keep)
                sides_rows.append(rows.take(keep))
            else:
                sides_rows.append(rows)
            sides.append(side)
            turn += 1
        rows, side = np.concatenate(sides_rows), np.concatenate(sides)
        name = np.cumsum(used) - 1
        heap = (2 * heap[wn, None] + np.arange(2)).ravel()[used]
        node, at = name.take(side), name.take(of)
        weight = np.cumsum(np.bincount(node, minlength=len(heap)) + np.bincount(at, minlength=len(heap)))
        group = (weight - 1) // HELD_ROWS
        if group[-1] == 0:
            todo.append((rows, node, heap, row, at, depth + 1))
            continue
        edges = np.flatnonzero(np.append(True, np.diff(group) != 0)).tolist() + [len(heap)]
        for x, y in zip(edges[:-1], edges[1:]):
            i, j = (node >= x) & (node < y), (at >= x) & (at < y)
            todo.append((rows[i], node[i] - x, heap[x:y], row[j], at[j] - x, depth + 1))
    return out


def _codes(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The different values of x (whole numbers below `most`) in order, and the place of each x among them."""
    if most > max(1 << 16, 4 * len(x)):
        return np.unique(x, return_inverse=True)
    some = np.zeros(most, bool)
    some[x] = True
    return np.flatnonzero(some), (np.cumsum(some) - 1).take(x)


def runs_of(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the runs [start, start + length), one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def _without(a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray, rules: Rules) -> list[tuple]:
    """The best cuts of nodes without a row of sums `wa` and `wb`, for each feature and each bin that the row may have.

    A row of bin x stands on the left of the cuts from x on and on the right of those below, so the best cut for it is the best
    of what `choose` would find there with the row taken off the left, or below with it taken off the right. One entry for
    each side that missing values may go to: (gain, cut) of (node, feature, bin) and the worth of the whole node.
    """
    total_a, total_b = a[:, :1].sum(2), b[:, :1].sum(2)
    lone_a, lone_b = a[:, :, MISSING], b[:, :, MISSING]
    left_a, left_b = np.cumsum(a[:, :, :MISSING], 2), np.cumsum(b[:, :, :MISSING], 2)
    whole = _worth(rules, total_a[:, 0] - wa, total_b[:, 0] - wb)
    wa, wb, total_a, total_b = (x.reshape(-1, 1, 1) for x in (wa, wb, total_a, total_b))
    out = []

    def gain(la, lb, ra, rb):
        ok = (la >= rules.min_leaf) & (ra >= rules.min_leaf) & (la > 0) & (ra > 0)
        return np.where(ok, _worth(rules, la, lb) + _worth(rules, ra, rb), -np.inf)

    places = np.arange(MISSING)
    for missing_left in ((False, True) if lone_a.any() else (False,)):
        la = left_a + lone_a[:, :, None] if missing_left else left_a
        lb = left_b + lone_b[:, :, None] if missing_left else left_b
        ra, rb = total_a - la, total_b - lb
        here, there = gain(la - wa, lb - wb, ra, rb), gain(la, lb, ra - wa, rb - wb)
        # the best cut from each place on (of equal ones the first), and up to each place
        on = np.maximum.accumulate(here[:, :, ::-1], 2)[:, :, ::-1]
        on_at = np.minimum.accumulate(np.where(here == on, places, MISSING)[:, :, ::-1], 2)[:, :, ::-1]
        up = np.maximum.accumulate(there, 2)
        first = np.empty(up.shape, bool)
        first[:, :, 0], first[:, :, 1:] = True, up[:, :, 1:] > up[:, :, :-1]
        up_at = np.maximum.accumulate(np.where(first, places, 0), 2)
        best, cut = np.empty(a.shape), np.empty(a.shape, np.int64)
        best[:, :, 0], cut[:, :, 0] = on[:, :, 0], on_at[:, :, 0]
        below = up[:, :, :-1] >= on[:, :, 1:]
        best[:, :, 1:MISSING] = np.where(below, up[:, :, :-1], on[:, :, 1:])
        cut[:, :, 1:MISSING] = np.where(below, up_at[:, :, :-1], on_at[:, :, 1:])
        best[:, :, MISSING], cut[:, :, MISSING] = (on[:, :, 0], on_at[:, :, 0]) if missing_left else (up[:, :, -1], up_at[:, :, -1])
        out.append((best, cut, whole))
    return out


def _look_up(found: list[tuple], number: np.ndarray, flat: np.ndarray, start: np.ndarray, tried: np.ndarray,
             least: float) -> tuple[np.ndarray, ...]:
    """(feature, cut, side of missing values, whether there is a split) of rows in node `number` of `found`, whose bins begin at
    `start` of `flat`; `tried`: the features looked at in each node."""
    m, out = tried.shape[1], None
    base = number * (m * BINS)
    cells = [base + (j * BINS) + flat.take(start + tried[:, j].take(number)) for j in range(m)]
    for missing_left, (best, cut, whole) in enumerate(found):
        best, cut = best.ravel(), cut.ravel()
        top, cell = best.take(cells[0]), cells[0]
        for other in cells[1:]:
            now = best.take(other)
            cell = np.where(now > top, other, cell)
            top = np.maximum(now, top)
        now = [top - whole.take(number), tried.ravel().take(number * m + cell // BINS % m), cut.take(cell),
               np.full(len(number), bool(missing_left))]
        out = now if out is None else [np.where(now[0] > out[0], y, x) for x, y in zip(out, now)]
    return out[1], out[2], out[3], out[0] > least


#: Rows whose scores travel together.
SCORED = 1 << 14


def left_out_scores(binned: Binned, plans: Sequence[Plan], fold: str, also: tuple[str, Column] | None = None) -> DataFrame:
    """(key, score): mean over the trees for every row of the small table, each by trees without its `fold`. `also` names
    another such column and the rows asked for: their scores without that fold come as `also`, null for other rows.

    Folds are columns that `bin_table` carried; nulls are a fold like any other. Rows that are alone in both folds are scored once.
    Tasks share out trees, and rows where trees are few; others add up their scores. A table beyond `LOCAL_BYTES` raises an
    error: use folds as training sets."""
    if binned.local is None:
        raise ValueError("exact leave-out needs a table within LOCAL_BYTES; use folds")
    spark, n, trees = binned.table.sparkSession, len(binned.local["y"]), len(plans)
    key, two = binned.key, also is not None
    other, asked = also or (fold, F.lit(False))
    got = binned.table.select("h", "y", "bins", F.col(fold).alias("_fold"), F.col(other).alias("_other"), F.coalesce(asked, F.lit(False)).alias("_asked"),
                              F.col(key).alias("_key")).orderBy("h", "y", "bins").drop("h", "y", "bins").toArrow()

    def numbered(name: str) -> np.ndarray:
        return pd.factorize(got.column(name).to_pandas(), use_na_sentinel=False)[0].astype(np.int64)

    table = {**binned.local, "fold": numbered("_fold"), "key": got.column("_key").combine_chunks()}
    if two:
        table |= {"other": numbered("_other"), "asked": got.column("_asked").to_numpy().astype(bool)}
    shipped = spark.sparkContext.broadcast(table)
    slots = spark.sparkContext.defaultParallelism
    size = max(1, trees // (4 * slots))
    shares = max(1, min(slots // trees, n // SCORED)) if trees else 1
    items = [(plans[i: i + size], share) for i in range(0, trees, size) for share in range(shares)]
    many = spark.sparkContext.broadcast(items)

    def values(t: dict, plan: Plan, w: np.ndarray, share: int) -> np.ndarray:
        b, fold = w * t["y"], t["fold"]
        mine = fold % shares == share
        out = np.zeros((2, n))
        here = left_out_here(plan, t["bins"], w, b, fold, wanted=mine)
        out[0, mine] = here[mine]
        if two:
            other, asked = t["other"], t["asked"]
            lone = (np.bincount(fold)[fold] == 1) & (np.bincount(other)[other] == 1)
            same = asked & lone & mine
            out[1, same] = here[same]
            rest = asked & ~lone & (other % shares == share)
            if rest.any():
                out[1, rest] = left_out_here(plan, t["bins"], w, b, other, wanted=rest)[rest]
        return out

    def score(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                t, (group, share) = shipped.value, many.value[i]
                total = np.zeros((2, n))
                for p in group:
                    total += values(t, p, p.weights(t["h"], t["member"]), share)
                for at in range(0, n, SCORED):
                    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([i]), pa.array([total[:, at: at + SCORED].tobytes()], pa.binary())],
                                                     names=["at", "i", "sums"])

    def add(batches):
        parts: dict[int, list] = {}
        for batch in batches:
            for at, i, x in zip(*[c.to_pylist() for c in batch.columns]):
                parts.setdefault(at, []).append((i, x))
        for at, some in parts.items():
            total = sum(np.frombuffer(x).reshape(2, -1) for _, x in sorted(some)) / trees
            t = shipped.value
            keys = t["key"].slice(at, total.shape[1])
            second = pa.array(total[1], mask=~t["asked"][at: at + SCORED]) if two else pa.nulls(len(keys), pa.float64())
            yield pa.RecordBatch.from_arrays([keys, pa.array(total[0]), second], names=[key, "score", "also"])

    kind = binned.table.schema[key].dataType.simpleString()
    sums = spark.range(0, len(items), 1, max(1, min(len(items), 4 * slots))).toDF("i").mapInArrow(score, "at long, i long, sums binary")
    out = sums.repartition(max(1, min(slots, -(-n // SCORED))), "at").mapInArrow(add, f"`{key}` {kind}, score double, also double")
    out = materialise(out, "left-out")
    shipped.destroy()
    many.destroy()
    return out if two else out.drop("also")


# ---- boosting -----------------------------------------------------------------------------------

GRADES = 1024  # bins of |gradient| for one-side sampling


@dataclass(frozen=True)
class Boost:
    """Rounds of trees that mend what the ones before left. `loss` log or exponential: Newton trees over gradients and
    Hessians; samme: classification trees over row weights, each with a vote. `top` and `rest`: one-side sampling keeps the
    share `top` of the largest gradients and draws the share `rest` of all rows from the others."""

    rules: Rules
    rounds: int = 100
    rate: float = 0.1
    loss: str = "log"
    top: float = 1.0
    rest: float = 0.0
    member: int | None = None
    seed: int = 42

    def start(self, weight: float, positive: float) -> float:
        if self.loss == "samme":
            return 0.0
        p = min(max(positive / weight, 1e-6), 1 - 1e-6) if weight > 0 else 0.5
        return float(np.log(p / (1 - p)) * (0.5 if self.loss == "exponential" else 1.0))

    def slopes(self, y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a tree adds up, to 2^-30: Hessians and gradients, or weights and weights of class 1."""
        if self.loss == "log":
            p = 1.0 / (1.0 + np.exp(-margin))
            a, b = p * (1 - p), p - y
        elif self.loss == "exponential":
            sign = 2.0 * y - 1.0
            a = np.exp(np.clip(-sign * margin, -30, 30))
            b = -sign * a
        else:
            a = np.exp(np.minimum(margin, 30))
            b = a * y
        return np.maximum(np.rint(a * FIXED), 1.0) / FIXED, np.rint(b * FIXED) / FIXED

    def kept(self, h: np.ndarray, g: np.ndarray, number: int, edge: float | None) -> np.ndarray:
        """Row weights of one-side sampling; `edge` parts the large gradients from the others."""
        if edge is None:
            return np.ones(len(g))
        lift = np.rint((1.0 - self.top) / self.rest * 1024.0) / 1024.0
        drawn = draw(h, self.seed, number, 4) < PRIME * self.rest / (1.0 - self.top)
        return np.where(np.abs(g) >= edge, 1.0, np.where(drawn, lift, 0.0))

    def edge(self, counts: np.ndarray) -> float:
        """Lower edge of the grade in which the share `top` of all rows is reached from above."""
        down = np.cumsum(counts[::-1])[::-1]
        return float(np.flatnonzero(down >= self.top * down[0])[-1]) / GRADES if down[0] > 0 else 0.0

    def plan(self, number: int, d: int) -> Plan:
        return Plan(self.seed, number, self.rules, tuple(range(d)), self.member, False)

    def values(self, tree: Tree) -> np.ndarray | None:
        """Of every node: the step, or the vote of the tree with the sign of the node's class; None ends the rounds."""
        if self.loss != "samme":
            return -tree.b / np.maximum(tree.a + self.rules.l2, 1e-12)
        leaf, side = tree.feature < 0, np.where(tree.b > tree.a / 2, 1.0, -1.0)
        error = np.minimum(tree.b, tree.a - tree.b)[leaf].sum() / tree.a[0] if tree.a[0] > 0 else 0.5
        if error >= 0.5:
            return None
        return side * (self.rate * np.log((1 - error) / error) if error > 1e-12 else np.inf)

    def moved(self, margin: np.ndarray, leaf: np.ndarray, value: np.ndarray, y: np.ndarray) -> np.ndarray:
        if self.loss == "samme":
            return margin + np.where((value[leaf] > 0) == (y > 0.5), 0.0, abs(value[0]))
        return margin + self.rate * value[leaf]

    def forest(self, edges, trees: list[Tree], values: list[np.ndarray], start: float) -> Forest:
        if self.loss == "samme":
            return Forest(edges, trees, values, "votes")
        double = 2.0 if self.loss == "exponential" else 1.0
        return Forest(edges, trees, values, "logistic", self.rate * double, start * double)


def _graded(g: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum((np.abs(g) * GRADES).astype(np.int64), GRADES - 1), w, GRADES)


def _rounds(boost: Boost, grow_one: Callable[[int], Tree], moved: Callable[[Tree, np.ndarray], None]):
    """The rounds of either way: a perfect voter stands alone, a useless one ends the rounds."""
    trees, values = [], []
    for r in range(boost.rounds):
        tree = grow_one(r)
        value = boost.values(tree)
        if value is None:
            if not trees:
                trees, values = [tree], [np.where(tree.b > tree.a / 2, 1.0, -1.0)]
            break
        if np.isinf(value).any():
            trees, values = [tree], [np.sign(value)]
            break
        trees.append(tree)
        values.append(value)
        moved(tree, value)
    return trees, values


def boost_here(boost: Boost, table: dict[str, np.ndarray]) -> tuple[float, list[Tree], list[np.ndarray]]:
    """All rounds over rows at hand."""
    d, y, h, bins = table["bins"].shape[1], table["y"], table["h"], table["bins"]
    base = np.ones(len(y)) if boost.member is None else table["member"][:, boost.member].astype(np.float64)
    start = boost.start(base.sum(), (base * y).sum())
    margin = np.full(len(y), start)

    def grow_one(r: int) -> Tree:
        a, b = boost.slopes(y, margin)
        edge = boost.edge(_graded(b, base)) if boost.top < 1.0 else None
        w = base * boost.kept(h, b, r, edge)
        return grow_here(boost.plan(r, d), bins, w * a, w * b, by_column(table))

    def moved(tree: Tree, value: np.ndarray) -> None:
        margin[:] = boost.moved(margin, tree.leaf(bins), value, y)

    return start, *_rounds(boost, grow_one, moved)


STORED_EVERY = 8


def boost_apart(binned: Binned, boost: Boost) -> tuple[float, list[Tree], list[np.ndarray]]:
    """All rounds over a table of any size: a row's margin is a column, written every `STORED_EVERY` rounds; in between it is
    the stored one and the latest trees."""
    d, s = binned.d, len(binned.table.select("member").first()[0])
    inside = F.lit(True) if boost.member is None else F.get("member", F.lit(boost.member))
    total = binned.table.where(inside).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).first()
    start = boost.start(float(total["n"]), float(total["p"] or 0.0))
    state = {"table": materialise(binned.table.withColumn("margin", F.lit(start)), "margins"), "late": []}

    def margin(t: dict, late) -> np.ndarray:
        m = t["margin"]
        for tree, value in late:
            m = boost.moved(m, tree.leaf(t["bins"]), value, t["y"])
        return m

    def base(t: dict) -> np.ndarray:
        return np.ones(len(t["y"])) if boost.member is None else t["member"][:, boost.member].astype(np.float64)

    def grow_one(r: int) -> Tree:
        late, edge = list(state["late"]), None
        if boost.top < 1.0:
            def grades(batches):
                total = np.zeros(GRADES)
                for batch in batches:
                    t = arrays(batch, d, s)
                    total += _graded(boost.slopes(t["y"], margin(t, late))[1], base(t))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(GRADES)), pa.array(total)], names=["i", "n"])
            counts = state["table"].mapInArrow(grades, "i long, n double").groupBy("i").agg(F.sum("n").alias("n")).orderBy("i")
            edge = boost.edge(np.array([c["n"] for c in counts.collect()]))

        def stats(plan: Plan, t: dict):
            a, b = boost.slopes(t["y"], margin(t, late))
            w = base(t) * boost.kept(t["h"], b, r, edge)
            return w * a, w * b

        return grow_apart(Binned(state["table"], binned.edges, binned.key), [boost.plan(r, d)], stats)[0]

    def moved(tree: Tree, value: np.ndarray) -> None:
        state["late"].append((tree, value))
        if len(state["late"]) == STORED_EVERY:
            late = list(state["late"])

            def write(batches):
                for batch in batches:
                    i = batch.schema.get_field_index("margin")
                    yield batch.set_column(i, "margin", pa.array(margin(arrays(batch, d, s), late)))
            before = state["table"]
            state.update(table=materialise(before.mapInArrow(write, before.schema), "margins"), late=[])
            discard(before)

    out = start, *_rounds(boost, grow_one, moved)
    discard(state["table"])
    return out


def boost_models(binned: Binned, boosts: Sequence[Boost]) -> list[Forest]:
    """Boosted ensembles: side by side on a small table, one after the other on a large one."""
    if binned.local is not None:
        got = share_out(binned, list(boosts), lambda table, b: boost_here(b, table))
    else:
        got = [boost_apart(binned, b) for b in boosts]
    return [b.forest(binned.edges, t, v, s) for b, (s, t, v) in zip(boosts, got)]
