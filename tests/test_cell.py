"""The numpy cell: gradients against finite differences, chunked folds against full folds."""

import numpy as np
import pytest

from seqwright.model import cell


def _setup(rng, S=3, T=7, H=3, I=6):
    sh = cell.Shared(rng.normal(size=(I + 1, 2 * H)) * 0.5, rng.normal(size=(I + 1, H)) * 0.5,
                     rng.normal(size=(I + 1, H)) * 0.5, rng.normal(size=2 * H) * 0.3 + 1.0,
                     rng.normal(size=H) * 0.3)
    G = rng.normal(size=(S, H, 2 * H)) * 0.5
    C = rng.normal(size=(S, H, H)) * 0.5
    items = rng.integers(1, I + 1, size=(S, T))
    targets = rng.integers(0, I + 1, size=(S, T))
    mask = np.ones((S, T), dtype=bool)
    mask[0, 5:] = False
    h0 = rng.normal(size=(S, H)) * 0.2
    return sh, G, C, items, targets, mask, h0


@pytest.mark.parametrize("reset_gate", [False, True])
@pytest.mark.parametrize("act", ["tanh", "sigmoid"])
def test_gradients_match_finite_differences(reset_gate, act):
    rng = np.random.default_rng(1)
    sh, G, C, items, targets, mask, h0 = _setup(rng)

    def loss_of(G_, C_, sh_):
        return cell.loss_and_grads(h0, G_, C_, items, targets, mask, sh_, 0.1, act, reset_gate)[0] * 0.1

    _, _, _, _, g, _ = cell.loss_and_grads(h0, G, C, items, targets, mask, sh, 0.1, act, reset_gate)
    eps = 1e-6

    def check(arr, grad, f):
        for idx in list(np.ndindex(arr.shape))[::7]:
            old = arr[idx]
            arr[idx] = old + eps
            lp = f()
            arr[idx] = old - eps
            lm = f()
            arr[idx] = old
            assert abs((lp - lm) / (2 * eps) - grad[idx]) < 1e-6, (idx, (lp - lm) / (2 * eps), grad[idx])

    f = lambda: loss_of(G, C, sh)
    check(G, g.G, f)
    check(C, g.C, f)
    check(sh.gate_in, g.gate_in, f)
    check(sh.cand_in, g.cand_in, f)
    check(sh.out, g.out, f)
    check(sh.gate_bias, g.gate_bias, f)
    check(sh.cand_bias, g.cand_bias, f)


def test_padding_keeps_state_and_chunked_fold_equals_full_fold():
    rng = np.random.default_rng(2)
    sh, G, C, items, targets, mask, h0 = _setup(rng, S=2, T=9)
    mask[:] = True
    hs, hT, _ = cell.forward(h0, G, C, items, mask, sh)
    h1s, h1, _ = cell.forward(h0, G, C, items[:, :4], mask[:, :4], sh)
    h2s, h2, _ = cell.forward(h1, G, C, items[:, 4:], mask[:, 4:], sh)
    np.testing.assert_allclose(np.concatenate([h1s, h2s], axis=1), hs, atol=1e-14)
    np.testing.assert_allclose(h2, hT, atol=1e-14)
    m = mask.copy()
    m[:, 6:] = False
    _, hp, _ = cell.forward(h0, G, C, items, m, sh)
    np.testing.assert_allclose(hp, hs[:, 5], atol=1e-14)


def test_rmsprop_step():
    w, g, ms = np.array([1.0, -2.0]), np.array([0.5, 0.0]), np.zeros(2)
    w2, ms2 = cell.rmsprop(w, g, ms, 0.1, 0.9, 1e-8)
    np.testing.assert_allclose(ms2, [0.025, 0.0])
    np.testing.assert_allclose(w2, [1.0 - 0.1 * 0.5 / np.sqrt(0.025 + 1e-8), -2.0])
