"""A gated recurrent language model in numpy: one-hot inputs, class-factored softmax, truncated backpropagation.

Token 0 is both the start and the end of a text: a text starts from a zero state with input 0. Classes have `size` tokens each, token i is
number i % size of class i // size; log p(token) = log p(class) + log p(token | class). The state is carried from window to window,
so the likelihood of a text is that of the whole of it.
"""

from __future__ import annotations

import numpy as np

HIDDEN = 12
WINDOW = 16
LANES = 512
SHAPES = {"x": ("v", "3h"), "u": ("h", "3h"), "wc": ("h", "c"), "bc": ("c",), "ww": ("c", "h", "s"), "bw": ("c", "s")}


def shapes(classes: int, size: int, hidden: int = HIDDEN) -> dict[str, tuple[int, ...]]:
    n = {"v": classes * size, "h": hidden, "3h": 3 * hidden, "c": classes, "s": size}
    return {k: tuple(n[d] for d in dims) for k, dims in SHAPES.items()}


def initial(counts: np.ndarray, size: int, hidden: int = HIDDEN, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters whose output biases are the add-one unigram distribution of counts (a multiple of size of them)."""
    rng, classes = np.random.default_rng(seed), len(counts) // size
    out = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in shapes(classes, size, hidden).items()}
    c = counts.reshape(classes, size) + 1.0
    out["bc"] = np.log(c.sum(axis=1) / c.sum()).astype(np.float32)
    out["bw"] = np.log(c / c.sum(axis=1, keepdims=True)).astype(np.float32)
    out["wc"] *= 0.1
    out["ww"] *= 0.1
    return out


def pack(p: dict[str, np.ndarray]) -> bytes:
    return b"".join(p[k].astype("<f4").tobytes() for k in SHAPES)


def unpack(raw: bytes, classes: int, size: int, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    out, at, flat = {}, 0, np.frombuffer(raw, "<f4")
    for k, s in shapes(classes, size, hidden).items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s).copy()
        at += n
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def step(p: dict, x: np.ndarray, h: np.ndarray) -> tuple:
    """The next state for inputs x, and what the way back needs."""
    k = h.shape[1]
    px, hu = p["x"][x], h @ p["u"]
    zr = _sigmoid(px[:, : 2 * k] + hu[:, : 2 * k])
    z, r, un = zr[:, :k], zr[:, k:], hu[:, 2 * k :]
    n = np.tanh(px[:, 2 * k :] + r * un)
    return n + z * (h - n), z, r, n, un


def _log_softmax(x: np.ndarray) -> np.ndarray:
    """In place. States lie within 1 and weights stay small, so shifting by one logit is enough against overflow."""
    x -= x[:, :1].copy()
    x -= np.log(np.einsum("ij->i", np.exp(x)))[:, None]
    return x


def output(p: dict, h: np.ndarray, y: np.ndarray, back: bool = False):
    """Log-likelihood of y for each state; with back, also the gradients of their sum by parameters and states."""
    size = p["bw"].shape[1]
    c, w = y // size, y % size
    lc = _log_softmax(h @ p["wc"] + p["bc"])
    rows = np.arange(len(y))
    out = lc[rows, c]
    if back:
        dc = -np.exp(lc)
        dc[rows, c] += 1
        dh = dc @ p["wc"].T
        g = {"wc": h.T @ dc, "bc": dc.sum(axis=0), "ww": np.zeros_like(p["ww"]), "bw": np.zeros_like(p["bw"])}
    order = np.argsort(c, kind="stable")
    ends = np.searchsorted(c[order], np.arange(len(p["bc"]) + 1))
    for k in np.flatnonzero(np.diff(ends)):
        at = order[ends[k] : ends[k + 1]]
        hk = h[at]
        lw = _log_softmax(hk @ p["ww"][k] + p["bw"][k])
        i = np.arange(len(at))
        out[at] += lw[i, w[at]]
        if back:
            dw = -np.exp(lw)
            dw[i, w[at]] += 1
            g["ww"][k], g["bw"][k] = hk.T @ dw, dw.sum(axis=0)
            dh[at] += dw @ p["ww"][k].T
    return (out, g, dh) if back else out


class Adam:
    def __init__(self, p: dict, rate: float):
        self.rate, self.t = rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def up(self, p: dict, g: dict) -> None:
        self.t += 1
        a = self.rate * np.sqrt(1 - 0.995**self.t) / (1 - 0.9**self.t)
        for k, x in p.items():
            self.m[k] += 0.1 * (g[k] - self.m[k])
            self.v[k] += 0.005 * (g[k] * g[k] - self.v[k])
            x += a * self.m[k] / (np.sqrt(self.v[k]) + 1e-6)


def window(p: dict[str, np.ndarray], h: np.ndarray, xs: np.ndarray, ys: np.ndarray, ok: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Of a window (steps by lanes) the log-likelihood of ys where ok, its gradients through all of the window's steps, and the state after it. Input 0 starts a text from a zero state."""
    lanes, k = h.shape
    kept, states = [], np.empty((len(xs), lanes, k), h.dtype)
    for t in range(len(xs)):
        h = h * (xs[t] != 0)[:, None]
        states[t], z, r, m, un = step(p, xs[t], h)
        kept.append((h, z, r, m, un))
        h = states[t]
    flat = ok.reshape(-1)
    found, g, dh = output(p, states.reshape(-1, k)[flat], ys.reshape(-1)[flat], back=True)
    dhs = np.zeros((len(xs) * lanes, k), h.dtype)
    dhs[flat] = dh
    dhs = dhs.reshape(len(xs), lanes, k)
    dx = np.empty((len(xs), lanes, 3 * k), h.dtype)
    g["u"], carry = np.zeros_like(p["u"]), np.zeros((lanes, k), h.dtype)
    for t in range(len(xs) - 1, -1, -1):
        hp, z, r, m, un = kept[t]
        d = dhs[t] + carry
        dn = d * (1 - z) * (1 - m * m)
        a = dx[t]
        a[:, :k] = d * (hp - m) * z * (1 - z)
        a[:, k : 2 * k] = dn * un * r * (1 - r)
        a[:, 2 * k :] = dn
        du = a.copy()
        du[:, 2 * k :] *= r
        g["u"] += hp.T @ du
        carry = (d * z + du @ p["u"].T) * (xs[t] != 0)[:, None]
    dx, at = dx.reshape(-1, 3 * k), xs.reshape(-1)
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    g["x"] = np.zeros_like(p["x"])
    g["x"][at[order][first]] = np.add.reduceat(dx[order], first, axis=0)
    return float(found.sum()), g, h


def train(p: dict[str, np.ndarray], ids: np.ndarray, rate: float, lanes: int = LANES) -> int:
    """One pass over ids (texts one after another, each closed by 0), in lanes side by side; the parameters change in place. The windows seen."""
    n = len(ids)
    if not n:
        return 0
    lanes = max(1, min(lanes, n // 64))
    length = -(-n // lanes)
    y = np.zeros(lanes * length, np.int64)
    y[:n] = ids
    y = np.ascontiguousarray(y.reshape(lanes, length).T)
    real = (np.arange(lanes * length) < n).reshape(lanes, length).T
    x = np.zeros_like(y)
    x[1:] = y[:-1]
    h, adam, windows = np.zeros((lanes, p["u"].shape[0]), np.float32), Adam(p, rate), 0
    for low in range(0, length, WINDOW):
        ok = real[low : low + WINDOW]
        _, g, h = window(p, h, x[low : low + WINDOW], y[low : low + WINDOW], ok)
        total = max(1, int(ok.sum()))
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values())) / total
        scale = 1 / total if norm <= 1 else 1 / (total * norm)
        adam.up(p, {key: v * scale for key, v in g.items()})
        windows += 1
    return windows


def score(p: dict[str, np.ndarray], texts: list[np.ndarray], lanes: int = LANES) -> np.ndarray:
    """Natural log-likelihood of each text (ids closed by 0), whole, the state carried from window to window."""
    out = np.zeros(len(texts))
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    k = p["u"].shape[0]
    for low in range(0, len(order), lanes):
        own = order[low : low + lanes]
        sizes = np.array([len(texts[i]) for i in own])
        h, last, sums = np.zeros((len(own), k), np.float32), np.zeros(len(own), np.int64), np.zeros(len(own))
        for start in range(0, int(sizes[0]) if len(sizes) else 0, WINDOW):
            active = int((sizes > start).sum())
            y = np.zeros((active, WINDOW), np.int64)
            for lane in range(active):
                part = texts[own[lane]][start : start + WINDOW]
                y[lane, : len(part)] = part
            states = np.empty((WINDOW, active, k), np.float32)
            h, x = h[:active], last[:active]
            for t in range(WINDOW):
                h = step(p, x, h)[0]
                states[t], x = h, y[:, t]
            last = x
            ok = (np.arange(WINDOW)[:, None] + start) < sizes[None, :active]
            found = np.zeros((WINDOW, active))
            found[ok] = output(p, states[ok], y.T[ok])
            sums[:active] += found.sum(axis=0)
        out[own] = sums
    return out
