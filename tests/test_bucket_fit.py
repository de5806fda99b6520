"""Fits over the bucketed weight store: what a step writes, restarts, and agreement with other ways to train."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqwright.model.bucket_fit import batches_of, bucket_step, fit_buckets
from seqwright.model.store import WeightStore, bucket_of
from seqwright.model.training import StepConfig, train_step

from test_training import _setup

H = 3


@pytest.fixture(scope="module")
def setup(spark):
    rows, t, num_items = _setup(spark, H)
    return rows, t, num_items


def arrays(t):
    u = {r["user"]: np.concatenate([r["gate"], r["cand"], r["gate_ms"], r["cand_ms"]]) for r in t.user_w.collect()}
    i = {r["item"]: np.concatenate([r["gate_in"], r["cand_in"], r["out"], r["out_ms"]]) for r in t.item_w.collect()}
    s = {r["name"]: np.asarray(r["v"]) for r in t.shared_w.collect()}
    return u, i, s


def same(a, b, atol=1e-9):
    for x, y in zip(a, b):
        assert x.keys() == y.keys()
        for k in x:
            np.testing.assert_allclose(x[k], y[k], atol=atol)


def test_a_step_over_the_store_equals_a_plain_step_and_writes_its_buckets_only(spark, setup, tmp_path):
    rows, t, num_items = setup
    cfg = StepConfig(hidden=H, num_items=num_items, lr=0.05)
    written = []
    for n in (1, 4):
        store = WeightStore.create(spark, str(tmp_path / f"w{n}"), t, 16)
        buckets = batches_of(16, n, 7, 1)[0]
        mine = rows.where(bucket_of(16).isin(buckets))
        k = mine.select("user", "seg").distinct().count()
        before = dict(store.manifest["users"])
        bucket_step(spark, mine, store, buckets, cfg, 1.0 / (k * 16))
        plain, _ = train_step(spark, mine, t, cfg, 16)
        same(arrays(store.tables()), arrays(plain))
        touched = {b for b, g in store.manifest["users"].items() if before[b] != g}
        assert touched == {str(b) for b in buckets} & set(before)
        written.append(store.written_bytes())
        # only the buckets asked for are opened
        some = store.users(buckets[:1]).inputFiles()
        assert all(f"bucket={buckets[0]}/" in f for f in some)
    assert written[1] < 0.6 * written[0], written


@pytest.mark.parametrize("carry,every", [(True, "chunk"), (True, "batch"), (False, "batch")])
def test_a_run_that_dies_goes_on_exactly(spark, setup, tmp_path, carry, every):
    rows, t, num_items = setup
    rows = rows.where("seg < 2")
    cfg = StepConfig(hidden=H, num_items=num_items, lr=0.05, carry=carry)
    kw = dict(window_len=16, epochs=1, n_batches=2, update_every=every, n_buckets=6, seed=3)
    whole, log, _ = fit_buckets(spark, rows, None, t, cfg, **kw, log_path=str(tmp_path / "log"))
    steps = [(r.step, r.chunk, r.n) for r in spark.read.parquet(log).orderBy("step").collect()]
    assert len(steps) == (4 if every == "chunk" else 2)
    path = str(tmp_path / "died")
    fit_buckets(spark, rows, None, t, cfg, **kw, log_path=str(tmp_path / "log2"), store_path=path, max_steps=1)
    # what a step leaves behind that died before its manifest
    os.makedirs(f"{path}/gen-00000002-dead/users/bucket=0")
    open(f"{path}/_half", "w").close()
    again, log2, _ = fit_buckets(spark, rows, None, None, cfg, **kw, log_path=str(tmp_path / "log2"), store_path=path)
    same(arrays(whole.tables()), arrays(again.tables()), 1e-12)
    assert [(r.step, r.chunk, r.n) for r in spark.read.parquet(log2).orderBy("step").collect()] == steps
    assert not os.path.exists(f"{path}/gen-00000002-dead")
    gens = {g for g in os.listdir(path) if g.startswith("gen-")}
    assert len(gens) <= 1 + len(steps) and WeightStore.open(spark, path).step == len(steps)


def test_chunk_updates_hand_states_on(spark, setup):
    """Two chunk steps by hand: the second starts from the states that the first left with the old weights."""
    from seqwright.model import cell
    from seqwright.model.weights import shared_arrays

    rows, t, num_items = setup
    rows = rows.where("seg < 2 and user <= 6")
    cfg = StepConfig(hidden=H, num_items=num_items, lr=0.05, carry=True)
    store, log, progress = fit_buckets(spark, rows, rows, t, cfg, window_len=16, epochs=1, n_batches=1, update_every="chunk", n_buckets=4)
    sh = shared_arrays(t.item_w, t.shared_w, num_items, H)
    uw = {r["user"]: [np.asarray(r["gate"]).reshape(H, 2 * H), np.asarray(r["cand"]).reshape(H, H), 0, 0] for r in t.user_w.collect()}
    seq = {}
    for r in rows.orderBy("user", "seg", "pos").collect():
        seq.setdefault((r["user"], r["seg"]), []).append((r["item"], r["target"]))
    users = sorted({u for u, _ in seq})
    ms = {k: 0.0 for k in sh.arrays()}
    h = {u: np.zeros(H) for u in users}
    losses = []
    for seg in (0, 1):
        mine = [u for u in users if (u, seg) in seq]
        items, targets = (np.array([[e[i] for e in seq[u, seg]] for u in mine]) for i in (0, 1))
        loss, n, _, _, g, hT = cell.loss_and_grads(np.stack([h[u] for u in mine]), np.stack([uw[u][0] for u in mine]), np.stack([uw[u][1] for u in mine]),
                                                   items, targets, np.ones_like(items, bool), sh, 1.0 / (len(users) * 16))
        losses.append(loss / (len(users) * 16))
        for j, u in enumerate(mine):
            h[u] = hT[j]
            uw[u][0], uw[u][2] = cell.rmsprop(uw[u][0], g.G[j], uw[u][2], 0.05)
            uw[u][1], uw[u][3] = cell.rmsprop(uw[u][1], g.C[j], uw[u][3], 0.05)
        new = {}
        for k, w in sh.arrays().items():
            new[k], ms[k] = cell.rmsprop(w, getattr(g, k), ms[k], 0.05)
        sh = cell.Shared(**new)
    got = spark.read.parquet(log).orderBy("step").collect()
    np.testing.assert_allclose([r["log_loss"] for r in got if r["split"] == "train"], losses, atol=1e-10)
    assert [r["split"] for r in got].count("valid") == 1
    after = {r["user"]: np.asarray(r["gate"]).reshape(H, 2 * H) for r in store.users().collect()}
    for u in users:
        np.testing.assert_allclose(after[u], uw[u][0], atol=1e-9)
    reports = spark.read.parquet(progress).orderBy("tenth").collect()
    assert [r["tenth"] for r in reports] == list(range(1, 11)) and all(r["seconds"] > 0 for r in reports)


def test_chunk_updates_need_state_carry(spark, setup):
    rows, t, num_items = setup
    with pytest.raises(ValueError):
        fit_buckets(spark, rows, None, t, StepConfig(hidden=H, num_items=num_items), window_len=16, epochs=1, n_batches=1, update_every="chunk")
