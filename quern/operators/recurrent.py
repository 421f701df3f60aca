"""A recurrent autoencoder over sequences of feature rows, trained by backpropagation through time in numpy.

An LSTM reads the sequence, its last state goes through a narrow latent layer, and a second
LSTM unrolls the latent state back to the sequence. Dropout acts on both crossings of the
latent layer. Training is distributed as for the dense model: partitions take steps over
their own sequences and their parameters are averaged.
"""

from __future__ import annotations

import numpy as np

LENGTH, HIDDEN, LATENT, DROPOUT = 8, 32, 8, 0.2


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def run_lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """States (rows, steps, hidden) over x (rows, steps, inputs), and what going back needs."""
    n, steps, h = len(x), x.shape[1], wh.shape[0]
    state, cell, states, kept = np.zeros((n, h)), np.zeros((n, h)), np.empty((n, steps, h)), []
    for t in range(steps):
        z = x[:, t] @ wx + state @ wh + b
        take, keep, show = squash(z[:, :h]), squash(z[:, h : 2 * h]), squash(z[:, 3 * h :])
        new = np.tanh(z[:, 2 * h : 3 * h])
        before, last = cell, state
        cell = keep * before + take * new
        top = np.tanh(cell)
        state = show * top
        states[:, t] = state
        kept.append((take, keep, new, show, before, top, last))
    return states, kept


def back_lstm(x: np.ndarray, kept: list, wx: np.ndarray, wh: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of x, wx, wh and b, from those of all states (rows, steps, hidden)."""
    dx, dwx, dwh, db = np.empty_like(x), np.zeros_like(wx), np.zeros_like(wh), np.zeros(wx.shape[1])
    dstate, dcell = np.zeros_like(kept[0][0]), np.zeros_like(kept[0][0])
    for t in range(x.shape[1] - 1, -1, -1):
        take, keep, new, show, before, top, last = kept[t]
        dstate = dstate + down[:, t]
        dcell = dcell + dstate * show * (1 - top * top)
        dz = np.concatenate([dcell * new * take * (1 - take), dcell * before * keep * (1 - keep), dcell * take * (1 - new * new), dstate * top * show * (1 - show)], axis=1)
        dwx += x[:, t].T @ dz
        dwh += last.T @ dz
        db += dz.sum(0)
        dx[:, t] = dz @ wx.T
        dstate, dcell = dz @ wh.T, dcell * keep
    return dx, dwx, dwh, db


class RecurrentAutoencoder:
    """Sequences of ``length`` rows of ``features``, flat as one vector of size length * features."""

    def __init__(self, size: int, seed: int = 42, length: int = LENGTH, hidden: int = HIDDEN, latent: int = LATENT, dropout: float = DROPOUT):
        self.rng, self.length, self.features, self.dropout = np.random.default_rng(seed), length, size // length, dropout
        f, h, z = self.features, hidden, latent
        even = lambda a, b, n: self.rng.uniform(-1, 1, (a, b)) / np.sqrt(n)
        self.w = [even(f, 4 * h, h), even(h, 4 * h, h), even(h, z, h), even(z, h, z), even(h, 4 * h, h), even(h, 4 * h, h), even(h, f, h)]
        self.b = [np.zeros(4 * h), np.zeros(z), np.zeros(h), np.zeros(4 * h), np.zeros(f)]

    def forward(self, x: np.ndarray, drop: bool = False) -> tuple[np.ndarray, tuple]:
        wx, wh, wz, wu, vx, vh, wo = self.w
        b, bz, bu, c, bo = self.b
        mask = lambda shape: (self.rng.random(shape) >= self.dropout) / (1 - self.dropout) if drop and self.dropout else np.ones(shape)
        read, kept = run_lstm(x, wx, wh, b)
        first = mask(read[:, -1].shape)
        last = read[:, -1] * first
        latent = last @ wz + bz
        start = latent @ wu + bu
        fed = np.repeat(start[:, None], x.shape[1], axis=1)
        told, kept_out = run_lstm(fed, vx, vh, c)
        second = mask(told.shape)
        shown = told * second
        return shown @ wo + bo, (kept, first, last, latent, fed, kept_out, second, shown)

    def errors(self, x: np.ndarray) -> np.ndarray:
        """Squared errors of the features of the last row of each sequence."""
        x = x.reshape(len(x), self.length, self.features)
        return (self.forward(x)[0][:, -1] - x[:, -1]) ** 2 if len(x) else np.zeros((0, self.features))

    def gradients(self, x: np.ndarray, drop: bool = True) -> tuple[float, list[np.ndarray]]:
        """The mean squared error over whole sequences and its gradients, in the order of (*w, *b)."""
        wx, wh, wz, wu, vx, vh, wo = self.w
        out, (kept, first, last, latent, fed, kept_out, second, shown) = self.forward(x, drop)
        d = 2 * (out - x) / x.size
        dwo, dbo = np.einsum("nth,ntf->hf", shown, d), d.sum((0, 1))
        dfed, dvx, dvh, dc = back_lstm(fed, kept_out, vx, vh, (d @ wo.T) * second)
        dstart = dfed.sum(1)
        dlatent = dstart @ wu.T
        down = np.zeros((len(x), x.shape[1], wh.shape[0]))
        down[:, -1] = (dlatent @ wz.T) * first
        _, dwx, dwh, db = back_lstm(x, kept, wx, wh, down)
        return float(((out - x) ** 2).mean()), [dwx, dwh, last.T @ dlatent, latent.T @ dstart, dvx, dvh, dwo, db, dlatent.sum(0), dstart.sum(0), dc, dbo]

    def parameters(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in (*self.w, *self.b)])

    def set_parameters(self, values: np.ndarray) -> RecurrentAutoencoder:
        at = 0
        for p in (*self.w, *self.b):
            p[...] = values[at : at + p.size].reshape(p.shape)
            at += p.size
        return self

    def learn(self, x: np.ndarray, state: list, step: int, batch: int = 32, rate: float = 1e-3) -> int:
        """Adam steps over the sequences in random order."""
        order = self.rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = x[order[at : at + batch]].reshape(-1, self.length, self.features)
            step += 1
            for p, g, (m, v) in zip((*self.w, *self.b), self.gradients(rows)[1], state, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return step
