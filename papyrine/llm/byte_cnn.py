"""A byte convolutional network for short texts: filters of several widths, max pooling, softmax; trained and applied in numpy.

Bytes are reduced to 64 classes (letters without case, the bytes of other letters, digits, space, punctuation). A filter of width n is a sum of n rows, one
for each place and class. For use, the rows of two neighbouring places are added up in a table over pairs of classes once, so a position costs a
gather for every two places. Windows have at most ``WINDOW`` bytes; their positions lie one after another and are pooled in slices.
"""

from __future__ import annotations

import io
import json

import numpy as np

WINDOW = 64
PAD = 8  # spaces between windows, more than a filter is wide
CLASSES = 64


def _classes() -> np.ndarray:
    c = np.zeros(256, dtype=np.uint8)  # 0: punctuation and everything else
    for i in range(26):
        c[ord("a") + i] = c[ord("A") + i] = 1 + i
    c[ord(" ")] = c[ord("\t")] = c[ord("\n")] = 27
    c[ord("0") : ord("9") + 1] = 28
    for i, b in enumerate(b"'-."):
        c[b] = 29 + i
    # Continuation bytes of the two-byte letters, both cases alike; lead bytes share two classes.
    for b in range(0x80, 0xC0):
        c[b] = 33 + (b & 0x1F) % 31
    c[0xC0:0xE0] = 32
    c[0xE0:] = 0
    return c


CLASS_OF = _classes()


class ByteCnn:
    def __init__(self, labels: list[str], widths=(4, 6), filters: int = 64, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.labels, self.widths, self.filters = labels, tuple(widths), filters
        self.w = [(rng.normal(size=(n, CLASSES, filters)) * 0.3).astype(np.float32) for n in widths]
        self.b = [np.zeros(filters, dtype=np.float32) for _ in widths]
        self.v = (rng.normal(size=(filters * len(widths), len(labels))) * 0.1).astype(np.float32)
        self.c = np.zeros(len(labels), dtype=np.float32)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        head = np.frombuffer(json.dumps({"labels": self.labels, "widths": self.widths, "filters": self.filters}).encode(), dtype=np.uint8)
        np.savez_compressed(out, head=head, v=self.v, c=self.c, **{f"w{i}": w for i, w in enumerate(self.w)}, **{f"b{i}": b for i, b in enumerate(self.b)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> "ByteCnn":
        with np.load(io.BytesIO(data), allow_pickle=False) as f:
            net = cls(**json.loads(f["head"].tobytes()))
            net.v, net.c = f["v"], f["c"]
            net.w, net.b = [f[f"w{i}"] for i in range(len(net.widths))], [f[f"b{i}"] for i in range(len(net.widths))]
        return net

    @staticmethod
    def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Classes of all bytes, each window with spaces around it; where the windows start and end; the text of each window."""
        parts, starts, ends, of, at = [], [], [], [], 0
        for i, t in enumerate(texts):
            for s in range(0, max(1, len(t)), WINDOW):
                w = t[s : s + WINDOW]
                parts.append(b" " + w + b" " * (PAD - 1))
                starts.append(at)
                ends.append(at + len(w) + 1)
                of.append(i)
                at += len(w) + PAD
        x = CLASS_OF[np.frombuffer(b"".join([*parts, b" " * PAD]), dtype=np.uint8)]
        return x, np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64), np.array(of, dtype=np.int64)

    def _forward(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Pooled features before the rectifier, and the positions the maxima come from (training)."""
        feats, where = [], []
        for w, b in zip(self.w, self.b, strict=True):
            n = len(w)
            y = np.zeros((len(x) - n + 1, self.filters), dtype=np.float32)
            for j in range(n):
                y += w[j][x[j : len(x) - n + 1 + j]]
            longest = int((ends - starts).max())
            grid = np.minimum(starts[:, None] + np.arange(longest), ends[:, None] - 1)
            cube = y[grid]
            am = cube.argmax(1)
            feats.append(np.take_along_axis(cube, am[:, None, :], 1)[:, 0] + b)
            where.append(np.take_along_axis(grid, am, 1))
        return feats, where

    def train(self, texts: list[bytes], y: np.ndarray, epochs: int = 4, batch: int = 256, rate: float = 0.004, seed: int = 3, dropout: float = 0.3, least_steps: int = 600) -> None:
        """Adam on the cross entropy, at least ``least_steps`` steps of it. ``texts``: windows of at most WINDOW bytes."""
        rng = np.random.default_rng(seed)
        params = [*self.w, *self.b, self.v, self.c]
        m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        epochs = max(epochs, -(-least_steps * batch // max(1, len(texts))))
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            lr = rate * 0.03 ** max(0.0, 2 * epoch / epochs - 1)  # falls to 3 % over the second half
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                x, starts, ends, _ = self.windows([texts[k][:WINDOW] for k in part])
                feats, where = self._forward(x, starts, ends)
                h = np.concatenate(feats, 1)
                a = np.maximum(h, 0)
                mask = (rng.random(a.shape) >= dropout).astype(np.float32) / (1 - dropout)
                a = a * mask
                z = a @ self.v + self.c
                z -= z.max(1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(1, keepdims=True)
                g = p
                g[np.arange(len(part)), y[part]] -= 1
                g /= len(part)
                gv, gc = a.T @ g, g.sum(0)
                gh = (g @ self.v.T) * mask * (h > 0)
                gw, gb = [], []
                for k, n in enumerate(self.widths):
                    gk = gh[:, k * self.filters : (k + 1) * self.filters]
                    gb.append(gk.sum(0))
                    full = np.zeros((n, CLASSES * self.filters), dtype=np.float32)
                    cols = np.arange(self.filters)[None, :]
                    for j in range(n):
                        at = x[where[k] + j].astype(np.int64) * self.filters + cols
                        full[j] = np.bincount(at.ravel(), gk.ravel(), CLASSES * self.filters)
                    gw.append(full.reshape(n, CLASSES, self.filters))
                step += 1
                for q, gq, mq, sq in zip(params, [*gw, *gb, gv, gc], m, s, strict=True):
                    mq += 0.1 * (gq - mq)
                    sq += 0.001 * (gq * gq - sq)
                    q -= lr * (mq / (1 - 0.9**step)) / (np.sqrt(sq / (1 - 0.999**step)) + 1e-7)

    def tables(self) -> list[tuple[list[np.ndarray], float]]:
        """For each width, tables over pairs of classes (and one over single classes where the width is odd), as 16-bit integers, and their scale."""
        out = []
        for w in self.w:
            t = [(w[j][:, None, :] + w[j + 1][None, :, :]).reshape(CLASSES * CLASSES, -1) for j in range(0, len(w) - 1, 2)]
            if len(w) % 2:
                t.append(w[-1])
            # A position's sum over all tables stays below the largest integer.
            scale = 12000 / max(1e-9, float(sum(np.abs(x).max(0) for x in t).max()))
            out.append(([np.round(x * scale).astype(np.int16) for x in t], scale))
        return out

    def log_probs(self, texts: list[bytes], tables: list | None = None) -> np.ndarray:
        """Log probabilities of each text: those of its windows, added up."""
        x, starts, ends, of = self.windows(texts)
        z = self._windows_log_probs(x, starts, ends, tables or self.tables())
        out = np.zeros((len(texts), len(self.labels)), dtype=np.float32)
        np.add.at(out, of, z)
        return out

    def line_log_probs(self, data: bytes, tables: list) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities and lengths of the lines of ``data`` (one more than it has newlines)."""
        breaks = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10)
        lengths = np.diff(np.concatenate([[-1], breaks, [len(data)]])) - 1
        x = CLASS_OF[np.frombuffer(b" " + data.replace(b"\n", b" " * PAD) + b" " * (2 * PAD), dtype=np.uint8)]
        first = np.cumsum(lengths + PAD) - (lengths + PAD)
        count = np.maximum(1, -(-lengths // WINDOW))
        of = np.repeat(np.arange(len(lengths)), count)
        k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        starts = first[of] + k * WINDOW
        z = self._windows_log_probs(x, starts, np.minimum(starts + WINDOW, (first + lengths)[of]) + 1, tables)
        if len(of) == len(lengths):
            return z, lengths
        return np.add.reduceat(z, np.cumsum(count) - count, axis=0), lengths

    def _windows_log_probs(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray, tables: list, chunk: int = 2048) -> np.ndarray:
        """Some 2,048 positions at a time, so that sums stay in the cache; positions between windows are left out."""
        out = np.empty((len(starts), len(self.labels)), dtype=np.float32)
        size = ends - starts
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = x.astype(np.intp)
        pairs = ids[:-1] * CLASSES + ids[1:]
        first = 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(upto, upto[first] + chunk, "right")) - 1)
            at = upto[first:last] - upto[first]
            pos = np.arange(upto[last] - upto[first]) + np.repeat(starts[first:last] - at, size[first:last])
            feats = []
            for (t, scale), b in zip(tables, self.b, strict=True):
                y = np.take(t[0], pairs[pos], axis=0, mode="clip")
                for j in range(1, len(t)):
                    y += np.take(t[j], (pairs if len(t[j]) > CLASSES else ids)[pos + 2 * j], axis=0, mode="clip")
                feats.append(np.maximum(np.maximum.reduceat(y, at, axis=0) / np.float32(scale) + b, 0))
            z = np.concatenate(feats, 1) @ self.v + self.c
            z -= z.max(1, keepdims=True)
            z -= np.log(np.exp(z).sum(1, keepdims=True))
            out[first:last] = z
            first = last
        return out
