"""The collaborative gated recurrent cell, vectorised over a block of sequences.

Per step, with per-user matrices ``G`` ``[H, 2H]`` and ``C`` ``[H, H]`` and per-item
vectors ``Ig`` ``[2H]`` and ``Ic`` ``[H]``::

    [r, u] = sigmoid(h @ G + bg + Ig[i])
    c      = act((r * h if reset_gate else h) @ C + bc + Ic[i])
    h'     = u * h + (1 - u) * c

With ``reset_gate=False`` (the default) the reset half of the gate is computed but
not applied, as in the reference. Logits are ``h' @ O.T`` with one ``O`` row per item.

These functions run inside Spark tasks on blocks of rows the task already holds;
they never see more than one Arrow batch (plus one open window) at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


ACTIVATIONS = {
    "tanh": (np.tanh, lambda y, x: 1.0 - y * y),
    "relu": (lambda x: np.maximum(x, 0.0), lambda y, x: (x > 0).astype(x.dtype)),
    "sigmoid": (sigmoid, lambda y, x: y * (1.0 - y)),
}


@dataclass
class Shared:
    """Weights every task needs whole: item vectors, output rows, biases."""
    gate_in: np.ndarray   # [I+1, 2H]
    cand_in: np.ndarray   # [I+1, H]
    out: np.ndarray       # [I+1, H]
    gate_bias: np.ndarray  # [2H]
    cand_bias: np.ndarray  # [H]

    def arrays(self) -> dict:
        return {"gate_in": self.gate_in, "cand_in": self.cand_in, "out": self.out,
                "gate_bias": self.gate_bias, "cand_bias": self.cand_bias}


def forward(h0, G, C, items, mask, sh: Shared, act="tanh", reset_gate=False, keep=False, xg=None, xc=None):
    """Fold ``S`` sequences of ``T`` steps. ``h0`` [S,H], ``G`` [S,H,2H], ``C`` [S,H,H],
    ``items`` [S,T] int, ``mask`` [S,T] bool (padding keeps the state). The item input
    vectors come from ``sh`` by id, or ready per position as ``xg`` [S,T,2H] / ``xc``
    [S,T,H] (item table too large to hold). Returns states [S,T,H], the final state [S,H]
    (state after the last valid step) and, with ``keep``, the per-step cache for the
    backward pass."""
    f, _ = ACTIVATIONS[act]
    S, T = items.shape
    H = h0.shape[1]
    hs = np.empty((S, T, H))
    cache = [] if keep else None
    h = h0
    for t in range(T):
        it = items[:, t]
        ig = sh.gate_in[it] if xg is None else xg[:, t]
        ic = sh.cand_in[it] if xc is None else xc[:, t]
        a = np.matmul(h[:, None, :], G)[:, 0, :] + sh.gate_bias + ig
        g = sigmoid(a)
        r, u = g[:, :H], g[:, H:]
        hin = r * h if reset_gate else h
        b = np.matmul(hin[:, None, :], C)[:, 0, :] + sh.cand_bias + ic
        c = f(b)
        hn = u * h + (1.0 - u) * c
        m = mask[:, t][:, None]
        if keep:
            cache.append((h, r, u, hin, b, c))
        h = np.where(m, hn, h)
        hs[:, t] = h
    return hs, h, cache


def logits_of(hs, sh: Shared):
    return hs @ sh.out.T


def softmax_stats(logits, targets):
    """Per position: log-sum-exp, target logit, arg-max item, max logit."""
    mx = logits.max(axis=-1)
    lse = np.log(np.exp(logits - mx[..., None]).sum(axis=-1)) + mx
    tl = np.take_along_axis(logits, targets[..., None], axis=-1)[..., 0]
    return lse, tl, logits.argmax(axis=-1), mx


@dataclass
class Grads:
    G: np.ndarray          # [S,H,2H] per sequence (summed per user by the caller)
    C: np.ndarray          # [S,H,H]
    items: np.ndarray      # [K] ids of the items that occur
    item_in: np.ndarray    # [K,3H] their input-vector gradients (gate ++ candidate)
    out: np.ndarray        # [I+1,H]
    gate_bias: np.ndarray  # [2H]
    cand_bias: np.ndarray  # [H]

    @property
    def gate_in(self) -> np.ndarray:
        """[I+1,2H], dense (for inspection; the jobs add the occurring rows only)."""
        return self._dense(slice(0, self.gate_bias.size))

    @property
    def cand_in(self) -> np.ndarray:
        return self._dense(slice(self.gate_bias.size, None))

    def _dense(self, part: slice) -> np.ndarray:
        rows = self.item_in[:, part]
        full = np.zeros((len(self.out), rows.shape[1]))
        full[self.items] = rows
        return full


#: Most logits that are held at once.
POSITIONS_X_ITEMS = 1 << 22


def loss_and_grads(h0, G, C, items, targets, mask, sh: Shared, scale, act="tanh",
                   reset_gate=False, mask_zero=True):
    """Masked softmax cross-entropy of the next item, summed and multiplied by ``scale``,
    and its gradient by back-propagation through the ``T`` steps (no gradient into ``h0``:
    truncated at the block start). Returns (loss_sum, n_valid, hits, per-seq cost, grads,
    final state)."""
    hs, hT, cache = forward(h0, G, C, items, mask, sh, act, reset_gate, keep=True)
    S, T, H = hs.shape
    lw = (mask & (targets > 0) if mask_zero else mask.copy()).ravel()
    flat, tg = hs.reshape(S * T, H), targets.ravel()
    loss, hits = np.zeros(S * T), 0
    gout, dhs = np.zeros_like(sh.out), np.zeros((S * T, H))
    # logits of a block of positions at a time: positions x items never exceeds POSITIONS_X_ITEMS
    step = max(1, POSITIONS_X_ITEMS // len(sh.out))
    live = np.flatnonzero(lw)
    for a in range(0, len(live), step):
        i = live[a:a + step]
        logits = flat[i] @ sh.out.T
        lse, tl, am, _ = softmax_stats(logits, tg[i])
        loss[i] = lse - tl
        hits += int((am == tg[i]).sum())
        logits -= lse[:, None]
        dl = np.exp(logits, out=logits)
        dl[np.arange(len(i)), tg[i]] -= 1.0
        dl *= scale
        gout += dl.T @ flat[i]
        dhs[i] = dl @ sh.out
    loss = loss.reshape(S, T)
    gG, gC, gbg, gbc, DA, DB = backprop(cache, G, C, mask, dhs.reshape(S, T, H), act, reset_gate)
    # input gradients only of the items that occur
    ids, at = np.unique(items, return_inverse=True)
    g_in = np.zeros((len(ids), 3 * H))
    np.add.at(g_in, at.ravel(), np.concatenate([DA, DB], axis=2).reshape(S * T, 3 * H))
    grads = Grads(gG, gC, ids, g_in, gout, gbg, gbc)
    return float(loss.sum()), int(lw.sum()), hits, loss.sum(axis=1), grads, hT


def backprop(cache, G, C, mask, dhs, act="tanh", reset_gate=False):
    """Back-propagate ``dhs`` (dL/dh per position, [S,T,H], from the output layer) through
    the ``T`` steps of :func:`forward` (``keep=True`` cache). Returns the per-sequence matrix
    gradients ``gG`` [S,H,2H] and ``gC`` [S,H,H], the bias gradients, and the gradients of
    the item input vectors per position ``DA`` [S,T,2H] and ``DB`` [S,T,H] (zero at padding)."""
    _, dact = ACTIVATIONS[act]
    S, T, H = dhs.shape
    gG = np.zeros_like(G)
    gC = np.zeros_like(C)
    gbg = np.zeros(2 * H)
    gbc = np.zeros(H)
    DA = np.zeros((S, T, 2 * H))
    DB = np.zeros((S, T, H))
    dnext = np.zeros((S, H))
    for t in range(T - 1, -1, -1):
        h, r, u, hin, b, c = cache[t]
        m = mask[:, t][:, None]
        dh = dhs[:, t] + dnext
        du = dh * (h - c)
        dc = dh * (1.0 - u)
        db = dc * dact(c, b)
        dhin = np.matmul(C, db[:, :, None])[:, :, 0]
        if reset_gate:
            dr = dhin * h
            da_r = dr * r * (1.0 - r)
            dprev = dh * u + dhin * r
        else:
            da_r = np.zeros_like(r)
            dprev = dh * u + dhin
        da = np.concatenate([da_r, du * u * (1.0 - u)], axis=1)
        dprev = dprev + np.matmul(G, da[:, :, None])[:, :, 0]
        da = da * m
        db = db * m
        gG += h[:, :, None] * da[:, None, :]
        gC += hin[:, :, None] * db[:, None, :]
        gbg += da.sum(axis=0)
        gbc += db.sum(axis=0)
        DA[:, t] = da
        DB[:, t] = db
        dnext = np.where(m, dprev, dh)
    return gG, gC, gbg, gbc, DA, DB


def rmsprop(w, g, ms, lr, rho=0.9, eps=1e-8):
    """RMSProp step: ``ms = rho*ms + (1-rho)*g^2``, ``w -= lr*g/sqrt(ms+eps)``."""
    ms = rho * ms + (1.0 - rho) * g * g
    return w - lr * g / np.sqrt(ms + eps), ms
