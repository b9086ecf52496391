"""Gradient-boosted trees on small integer features, in numpy: log loss, splits at quantiles, and calibrated thresholds.

Rows may lie in many tasks, and equal rows may be one with a weight: tasks exchange histograms, never rows.
"""

from __future__ import annotations

import hmac
import os
import pickle
import socket
from collections.abc import Callable, Iterator

import numpy as np

#: Most cuts that are tried on a feature; features with fewer distinct values are cut exactly.
CUTS = 255
#: Gradients are whole multiples of 1 / UNIT.
UNIT = float(1 << 20)
#: Seconds that a task waits for the others.
PATIENCE = 1800


class Boosted:
    """A sum of shallow regression trees; ``predict`` gives the probabilities of all rows of a matrix."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, least: int = 4, ridge: float = 1.0) -> None:
        self.n, self.depth, self.rate, self.least, self.ridge = trees, depth, rate, least, ridge
        self.trees: list = []
        self.start = 0.0
        self.threshold = 0.5

    def fit(self, x: np.ndarray, y: np.ndarray, held: np.ndarray | None = None, precision: float = 0.99) -> Boosted:
        """Fit on the rows that aren't held out; on those, take the least threshold whose choice has the precision, else the best by F1."""
        together([self.steps(x, y, np.ones(len(y)), np.arange(len(y)) % 5 == 4 if held is None else held, precision)])
        return self

    def steps(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, held: np.ndarray, precision: float = 0.99) -> Iterator[np.ndarray]:
        """``fit`` on a part of the rows, each of which stands for ``weight`` equal ones: yields sums (or, as int64, sets) over the part
        and goes on with those over all parts, so that every part comes to the same trees."""
        n = yield np.array([weight[held == h][y[held == h] == v].sum() for h in (False, True) for v in (0, 1)], float)
        if not n[0] or not n[1]:
            held, n = np.zeros(len(y), bool), np.array([n[0] + n[2], n[1] + n[3], 0, 0])
        yield from self._boost(x[~held], y[~held], weight[~held], n[:2])
        if n[2] and n[3]:
            p, truth, w = self.predict(x[held]), y[held] == 1, weight[held]
            levels = np.linspace(0.1, 0.9, 33)
            both = yield np.array([*[w[(p >= t) & truth].sum() for t in levels], *[w[p >= t].sum() for t in levels]], float)
            hits, chosen = both[:33], both[33:]
            f1 = 2 * hits / (chosen + n[3])
            good = np.flatnonzero((hits >= precision * chosen) & (f1 >= f1.max() - 0.01))
            good = good if len(good) else np.flatnonzero(f1 == f1.max())
            self.threshold = float(levels[good[len(good) // 2]])

    def _boost(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, n: np.ndarray) -> Iterator[np.ndarray]:
        mean = min(max(float(n[1] / n.sum()) if n.sum() else 0.0, 1e-3), 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        f = np.full(len(y), self.start)
        if not n.all():
            return
        shape = x.shape[1]
        seen = yield np.concatenate([np.unique(x[:, j]).astype(np.int64) + (j << 40) + (1 << 39) for j in range(shape)])
        cuts, bins = {}, {}
        for j in range(shape):
            c = (seen[seen >> 40 == j] & ((1 << 40) - 1))[1:] - (1 << 39)
            if len(c):
                cuts[j] = c[:: -(-len(c) // CUTS)].astype(float)
                bins[j] = np.searchsorted(cuts[j], x[:, j], "right")
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-f))
            # Whole numbers have the same sum in any order.
            tree = yield from self._grow(x, cuts, bins, weight, weight * np.rint((y - p) * UNIT), weight * np.rint(p * (1 - p) * UNIT))
            self.trees.append(tree)
            f += self._leaves(tree, x)

    def _grow(self, x: np.ndarray, cuts: dict, bins: dict, weight: np.ndarray, g: np.ndarray, h: np.ndarray) -> Iterator[np.ndarray]:
        """A tree, level by level: the open nodes of a level are split by one exchange of their histograms."""
        tops = yield np.array([weight.sum(), g.sum(), h.sum()])
        root: list = [None]  # a list of one, or of (feature, cut, left, right), that is filled in
        open_, at = [(root, *tops)], np.zeros(len(g), np.int64)  # at: the open node of each row, or -1
        for depth in range(self.depth, -1, -1):
            split = []
            for k, (node, n, sg, sh) in enumerate(open_):
                node[:] = [float(self.rate * (sg / UNIT) / (sh / UNIT + self.ridge))]
                if depth and n >= 2 * self.least:
                    split.append(k)
            if not split or not cuts:
                break
            new = np.full(len(open_) + 1, -1)
            new[split] = range(len(split))
            at, m = new[at], len(split)
            rows = np.flatnonzero(at >= 0)
            here = at[rows]
            parts = []
            for j, c in cuts.items():
                cell = here * (len(c) + 1) + bins[j][rows]
                parts += [np.bincount(cell, w[rows], m * (len(c) + 1)) for w in (weight, g, h)]
            sums, k, hist = (yield np.concatenate(parts)), 0, {}
            for j, c in cuts.items():
                size = m * (len(c) + 1)
                hist[j] = sums[k : k + 3 * size].reshape(3, m, len(c) + 1)
                k += 3 * size
            below, side = [], np.full(len(g), -1)
            for i, k in enumerate(split):
                node, n, sg, sh = open_[k]
                best, gain, base = None, 1e-6, (sg / UNIT) ** 2 / (sh / UNIT + self.ridge)
                # Of splits that gain the same, the one on the plainest feature counts.
                for j in sorted(hist, key=lambda j: np.count_nonzero(hist[j][0, i])):
                    left = hist[j][:, i].cumsum(axis=1)[:, :-1]
                    gl, hl = left[1] / UNIT, left[2] / UNIT
                    better = gl**2 / (hl + self.ridge) + (sg / UNIT - gl) ** 2 / (sh / UNIT - hl + self.ridge) - base
                    better[(left[0] < self.least) | (n - left[0] < self.least)] = 0
                    q = int(better.argmax())
                    if better[q] > gain + 1e-9:
                        best, gain = (j, float(cuts[j][q]), left[:, q]), float(better[q])
                if best is None:
                    continue
                j, cut, first = best
                node[:] = [j, cut, [None], [None]]
                mine = rows[here == i]
                side[mine] = len(below) + (x[mine, j] >= cut)
                below += [(node[2], *first), (node[3], n - first[0], sg - first[1], sh - first[2])]
            open_, at = below, side

        def closed(node: list):  # noqa: ANN202
            return node[0] if len(node) == 1 else (node[0], node[1], closed(node[2]), closed(node[3]))

        return closed(root)

    def _leaves(self, tree, x: np.ndarray) -> np.ndarray:  # noqa: ANN001
        if isinstance(tree, float):
            return np.full(len(x), tree)
        j, cut, a, b = tree
        return np.where(x[:, j] < cut, self._leaves(a, x), self._leaves(b, x))

    def predict(self, x: np.ndarray) -> np.ndarray:
        s = np.full(len(x), self.start)
        for t in self.trees:
            s += self._leaves(t, x)
        return 1 / (1 + np.exp(-s))


def together(fits: list[Iterator[np.ndarray]], total: Callable[[dict[int, np.ndarray]], dict[int, np.ndarray]] = lambda parts: parts) -> None:
    """Run several fits in step, so that what all of them ask for is added up over the parts by one call."""
    asked: dict[int, np.ndarray] = {}
    answers: dict[int, np.ndarray | None] = dict.fromkeys(range(len(fits)))
    while answers:
        asked = {}
        for k, a in answers.items():
            try:
                asked[k] = fits[k].send(a)
            except StopIteration:
                continue
        answers = total(asked) if asked else {}


class Parts:
    """The sums (of floats) and unions (of int64) over all tasks of a barrier stage; the first task adds up.

    Spark's own exchange, which takes about a second, only tells where that task listens; a fit has hundreds of exchanges.
    """

    def __init__(self) -> None:
        from pyspark import BarrierTaskContext

        ctx = BarrierTaskContext.get()
        hosts = [i.address.rpartition(":")[0] or i.address for i in ctx.getTaskInfos()]
        self.others: list[socket.socket] = []
        if first := ctx.partitionId() == 0:
            hub, secret = socket.create_server((hosts[0], 0)), os.urandom(16).hex()
        port, secret = ctx.allGather(f"{hub.getsockname()[1]} {secret}" if first else "")[0].split()
        if first:
            hub.settimeout(PATIENCE)
            while len(self.others) < len(hosts) - 1:
                s, _ = hub.accept()
                s.settimeout(PATIENCE)
                if hmac.compare_digest(self._exactly(s, 32), secret.encode()):
                    self.others.append(s)
            hub.close()
        else:
            self.hub = socket.create_connection((hosts[0], int(port)), PATIENCE)
            self.hub.sendall(secret.encode())
        for s in self.others if first else [self.hub]:
            s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        self.first = first

    @staticmethod
    def _exactly(s: socket.socket, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if not (more := s.recv(min(1 << 20, n - len(out)))):
                raise ConnectionError("another task of the fit ended")
            out += more
        return out

    def _take(self, s: socket.socket) -> dict[int, np.ndarray]:
        return pickle.loads(self._exactly(s, int.from_bytes(self._exactly(s, 8))))

    def __call__(self, parts: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        def sent(x: dict[int, np.ndarray]) -> bytes:
            data = pickle.dumps(x)
            return len(data).to_bytes(8) + data

        if not self.first:
            self.hub.sendall(sent(parts))
            return self._take(self.hub)
        every = [parts, *(self._take(s) for s in self.others)]
        whole = {k: np.unique(np.concatenate([e[k] for e in every])) if v.dtype == np.int64 else sum(e[k] for e in every) for k, v in parts.items()}
        answer = sent(whole)
        for s in self.others:
            s.sendall(answer)
        return whole
