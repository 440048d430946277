"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np

CODES = 104  # printable ASCII, then classes of other signs
EMBED, HIDDEN = 12, 16


def codes(text: str) -> np.ndarray:
    """Class of every code point: ASCII by itself, others by kind."""
    out = np.empty(len(text), dtype=np.int64)
    for i, c in enumerate(text):
        n = ord(c)
        out[i] = n - 31 if 32 <= n < 127 else 0 if n < 128 else 97 if c.isalpha() else 98 if c.isdigit() else 99 if c.isspace() else 100
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    def __init__(self, tags: int, seed: int = 7):
        rng = np.random.RandomState(seed)
        self.tags = tags
        self.p = {"embed": rng.randn(CODES, EMBED) * 0.3, "out": rng.randn(2 * HIDDEN, tags) * 0.2, "bias": np.zeros(tags), "move": np.zeros((tags, tags)), "start": np.zeros(tags)}
        for d in "fb":
            self.p[f"w{d}"] = rng.randn(EMBED, 4 * HIDDEN) * 0.25
            self.p[f"u{d}"] = rng.randn(HIDDEN, 4 * HIDDEN) * 0.2
            self.p[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])

    # x is (steps, rows); every row has the same length
    def _run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        p, (steps, rows) = self.p, x.shape
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        inputs = p["embed"][x] @ p[f"w{d}"] + p[f"c{d}"]
        h, c = np.zeros((rows, HIDDEN)), np.zeros((rows, HIDDEN))
        out, kept = np.empty((steps, rows, HIDDEN)), []
        for t in order:
            z = inputs[t] + h @ p[f"u{d}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            before, c_before = h, c
            c = f * c + i * g
            s = np.tanh(c)
            h = o * s
            out[t] = h
            kept.append((t, i, f, o, g, c_before, s, before))
        return out, kept

    def emissions(self, x: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, "f")[0], self._run(x, "b")[0]], axis=2)
        return both @ self.p["out"] + self.p["bias"]

    def marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log sum of all paths, tag marginals (steps, rows, tags), expected moves."""
        steps, rows, k = e.shape
        a, b = np.empty_like(e), np.zeros_like(e)
        a[0] = e[0] + self.p["start"]
        for t in range(1, steps):
            a[t] = _logsum(a[t - 1][:, :, None] + self.p["move"], 1) + e[t]
        for t in range(steps - 2, -1, -1):
            b[t] = _logsum(self.p["move"] + (e[t + 1] + b[t + 1])[:, None, :], 2)
        total = _logsum(a[-1], 1)
        moves = np.zeros((k, k))
        for t in range(1, steps):
            moves += np.exp(a[t - 1][:, :, None] + self.p["move"] + (e[t] + b[t])[:, None, :] - total[:, None, None]).sum(0)
        return total, np.exp(a + b - total[None, :, None]), moves

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, (steps, rows) = self.p, x.shape
        runs = {d: self._run(x, d) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        e = both @ p["out"] + p["bias"]
        total, own, moves = self.marginals(e)
        hot = np.eye(self.tags)[y]
        gold = (e * hot).sum((0, 2)) + p["start"][y[0]] + p["move"][y[:-1], y[1:]].sum(0)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        de = (own - hot) / rows
        np.add.at(g["move"], (y[:-1].ravel(), y[1:].ravel()), -1.0)
        g["move"] = (g["move"] + moves) / rows
        g["start"] = (own[0] - hot[0]).sum(0) / rows
        g["out"] = np.einsum("trh,trk->hk", both, de)
        g["bias"] = de.sum((0, 1))
        dboth = de @ p["out"].T
        for n, d in enumerate("fb"):
            dh_out = dboth[:, :, n * HIDDEN : (n + 1) * HIDDEN]
            dh, dc = np.zeros((rows, HIDDEN)), np.zeros((rows, HIDDEN))
            dz_all = np.empty((steps, rows, 4 * HIDDEN))
            for t, i, f, o, s_in, c_before, s, before in reversed(runs[d][1]):
                dh = dh + dh_out[t]
                dc = dc + dh * o * (1 - s * s)
                dz = np.concatenate([dc * s_in * i * (1 - i), dc * c_before * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - s_in * s_in)], axis=1)
                dz_all[t] = dz
                g[f"u{d}"] += before.T @ dz
                dh, dc = dz @ p[f"u{d}"].T, dc * f
            g[f"c{d}"] = dz_all.sum((0, 1))
            g[f"w{d}"] = np.einsum("tre,trz->ez", p["embed"][x], dz_all)
            np.add.at(g["embed"], x, dz_all @ p[f"w{d}"].T)
        return float((total - gold).mean()), g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, rate: float = 0.02, batch: int = 64, seed: int = 11) -> list[float]:
        """Adam over (rows, steps) arrays; the mean loss of each epoch."""
        rng, losses, n = np.random.RandomState(seed), [], 0
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order, sums = rng.permutation(len(x)), []
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                loss, g = self.gradient(x[rows].T, y[rows].T)
                sums.append(loss)
                n += 1
                step = rate * (0.3 if epoch == epochs - 1 else 1.0) * np.sqrt(1 - 0.999**n) / (1 - 0.9**n)
                norm = max(1.0, np.sqrt(sum(float((a * a).sum()) for a in g.values())) / 5)
                for k, a in g.items():
                    a = a / norm
                    m[k] += 0.1 * (a - m[k])
                    v[k] += 0.001 * (a * a - v[k])
                    self.p[k] -= step * m[k] / (np.sqrt(v[k]) + 1e-8)
            losses.append(float(np.mean(sums)))
        return losses

    def decode(self, e: np.ndarray) -> np.ndarray:
        """The best path of (steps, rows, tags) emissions, as (steps, rows)."""
        steps, rows, _ = e.shape
        score, back = e[0] + self.p["start"], np.empty(e.shape, dtype=np.int8)
        for t in range(1, steps):
            all_ = score[:, :, None] + self.p["move"]
            back[t] = all_.argmax(1)
            score = all_.max(1) + e[t]
        path = np.empty((steps, rows), dtype=np.int64)
        path[-1] = score.argmax(1)
        for t in range(steps - 1, 0, -1):
            path[t - 1] = back[t][np.arange(rows), path[t]]
        return path
