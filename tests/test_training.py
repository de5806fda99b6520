"""Training: distributed gradient equals the single-process one; loss falls."""

import numpy as np
from pyspark.sql import functions as F

from seqwright.model import cell
from seqwright.model import weights as Wt
from seqwright.model.training import StepConfig, Tables, fit, step_frame, sum_arrays
from seqwright.operators import sequences as S
from seqwright.sources.tables import events_interactions

from conftest import SF001


def _setup(spark, hidden=3):
    seq = S.next_item(events_interactions(spark, SF001))
    num_items = int(seq.agg(F.max("item")).first()[0])
    rows = S.tumbling_windows(seq, 16).select("user", F.col("chunk").alias("seg"), "pos", "item", "target")
    t = Tables(Wt.user_weights(seq, hidden, "normal", seed=3), Wt.item_weights(spark, num_items, hidden, "normal", 3),
               Wt.shared_weights(spark, hidden))
    return rows, t, num_items


def test_distributed_gradient_equals_local(spark):
    H = 3
    rows, t, num_items = _setup(spark, H)
    cfg = StepConfig(hidden=H, num_items=num_items, update=False)
    n = rows.select("user", "seg").distinct().count()
    res = step_frame(spark, rows, t.user_w, t.item_w, t.shared_w, cfg, 1.0 / (n * 16)).cache()
    ug = {r["id"]: np.asarray(r["v1"]) for r in res.where(F.col("kind") == "user_grad").collect()}
    gi = {r["id"]: np.asarray(r["v1"]) for r in sum_arrays(res.where(F.col("kind") == "item").select("id", "v1"),
                                                           "id").collect()}
    # single process: every window at once
    sh = Wt.shared_arrays(t.item_w, t.shared_w, num_items, H)
    uw = {r["user"]: (np.asarray(r["gate"]).reshape(H, 2 * H), np.asarray(r["cand"]).reshape(H, H))
          for r in t.user_w.collect()}
    win = rows.groupBy("user", "seg").agg(F.sort_array(F.collect_list(F.struct("pos", "item", "target"))).alias("s"))
    win = sorted(win.collect(), key=lambda r: (r["user"], r["seg"]))
    items = np.array([[e["item"] for e in r["s"]] for r in win])
    targets = np.array([[e["target"] for e in r["s"]] for r in win])
    G = np.stack([uw[r["user"]][0] for r in win])
    C = np.stack([uw[r["user"]][1] for r in win])
    _, _, _, _, g, _ = cell.loss_and_grads(np.zeros((len(win), H)), G, C, items, targets,
                                           np.ones_like(items, dtype=bool), sh, 1.0 / (n * 16))
    for u in uw:
        idx = [k for k, r in enumerate(win) if r["user"] == u]
        if idx:
            np.testing.assert_allclose(ug[u][:2 * H * H], g.G[idx].sum(axis=0).ravel(), atol=1e-12)
    full = np.concatenate([g.gate_in, g.cand_in, g.out], axis=1)
    for i, v in gi.items():
        np.testing.assert_allclose(v, full[i], atol=1e-12)


def test_training_loss_falls(spark):
    H = 4
    rows, t, num_items = _setup(spark, H)
    cfg = StepConfig(hidden=H, num_items=num_items, lr=0.05)
    _, log = fit(spark, rows, None, t, cfg, window_len=16, epochs=6, n_batches=1, steps_per_epoch=1, seed=1)
    losses = [r["log_loss"] for r in spark.read.parquet(log).orderBy("epoch").collect()]
    assert len(losses) == 6
    assert losses[-1] < losses[0] * 0.97, losses


def test_split_users_step_equals_whole_user_step(spark):
    """Spreading users' windows over tasks (pieces of 2 windows, or one piece per user) gives
    the same update as one task per user; users outside the batch keep their weights."""
    from seqwright.model.training import train_step
    H = 3
    rows, t, num_items = _setup(spark, H)
    rows = rows.where(F.col("user") % 2 == 0)
    cfgs = [StepConfig(hidden=H, num_items=num_items, lr=0.05, split_users=False),
            StepConfig(hidden=H, num_items=num_items, lr=0.05, split_users=True, piece_windows=2),
            StepConfig(hidden=H, num_items=num_items, lr=0.05, split_users=True)]
    res = [train_step(spark, rows, t, c, 16) for c in cfgs]
    base = {r["user"]: np.asarray(r["gate"] + r["cand"]) for r in t.user_w.collect()}
    tabs = [{r["user"]: np.asarray(r["gate"] + r["cand"]) for r in n.user_w.collect()} for n, _ in res]
    for (n, st), tab in zip(res[1:], tabs[1:]):
        assert abs(st["loss"] - res[0][1]["loss"]) < 1e-9 and st["n"] == res[0][1]["n"]
        assert tab.keys() == tabs[0].keys() == base.keys()
        for u in tab:
            np.testing.assert_allclose(tab[u], tabs[0][u], atol=1e-10)
        ia = {r["item"]: np.asarray(r["out"]) for r in res[0][0].item_w.collect()}
        ib = {r["item"]: np.asarray(r["out"]) for r in n.item_w.collect()}
        for i in ia:
            np.testing.assert_allclose(ia[i], ib[i], atol=1e-10)
    for u in base:
        changed = not np.allclose(tabs[0][u], base[u])
        assert changed == (u % 2 == 0)


def test_split_users_scoring_equals_whole_user(spark):
    from seqwright.model.scoring import score
    H = 3
    rows, t, num_items = _setup(spark, H)
    kw = dict(num_items=num_items, hidden=H, carry=False)
    a = score(spark, rows, t.user_w, t.item_w, t.shared_w, split_users=False, **kw).select(
        "user", "seg", "pos", "h", "lse")
    b = score(spark, rows, t.user_w, t.item_w, t.shared_w, split_users=True, piece_windows=1, **kw).select(
        "user", "seg", "pos", "h", "lse")
    ra = sorted((r["user"], r["seg"], r["pos"], tuple(r["h"]), r["lse"]) for r in a.collect())
    rb = sorted((r["user"], r["seg"], r["pos"], tuple(r["h"]), r["lse"]) for r in b.collect())
    assert ra == rb


def test_blocked_item_path_equals_in_memory_path(spark):
    """Above the size bound: input vectors joined per row, softmax in broadcast item blocks."""
    from seqwright.model.scoring import score
    H = 3
    rows, t, num_items = _setup(spark, H)
    seq_rows = rows.select("user", "seg", "pos", "item", "target")
    kw = dict(num_items=num_items, hidden=H, carry=True)
    a = score(spark, seq_rows, t.user_w, t.item_w, t.shared_w, **kw)
    b = score(spark, seq_rows, t.user_w, t.item_w, t.shared_w, shared_bytes=8 * H * 17, **kw)
    cols = ["user", "seg", "pos", "target", "h", "lse", "tlogit", "argmax", "maxlogit"]
    ra = sorted(tuple(r) for r in a.select(*cols).collect())
    rb = sorted(tuple(r) for r in b.select(*cols).collect())
    assert len(ra) == len(rb) > 0
    for x, y in zip(ra, rb):
        assert x[:4] == y[:4] and x[7] == y[7]
        np.testing.assert_allclose(x[4], y[4], atol=1e-12)
        np.testing.assert_allclose([x[5], x[6], x[8]], [y[5], y[6], y[8]], atol=1e-10)


def test_scheduled_lr_matches_column_rule(spark):
    from seqwright.functions.math import lr_schedule
    from seqwright.model.training import scheduled_lr
    df = spark.range(0, 25).select(F.col("id").alias("s"), lr_schedule("s", 0.1, 20, 5).alias("lr"))
    for r in df.collect():
        assert abs(r["lr"] - scheduled_lr(r["s"], 0.1, 20, 5)) < 1e-15


def test_blocked_training_step_equals_in_memory_step(spark):
    """Above the item-table bound (blocks of 7 items): same loss, user, item and bias updates."""
    from seqwright.model.training import train_step
    H = 3
    rows, t, num_items = _setup(spark, H)
    rows = rows.where(F.col("user") % 3 == 0)
    base = dict(hidden=H, num_items=num_items, lr=0.05)
    a, sa = train_step(spark, rows, t, StepConfig(**base), 16)
    b, sb = train_step(spark, rows, t, StepConfig(**base, shared_bytes=8 * H * 7), 16)
    assert abs(sa["loss"] - sb["loss"]) < 1e-8 and sa["n"] == sb["n"] and sa["hits"] == sb["hits"]
    ua = {r["user"]: np.asarray(r["gate"] + r["cand"] + r["gate_ms"]) for r in a.user_w.collect()}
    ub = {r["user"]: np.asarray(r["gate"] + r["cand"] + r["gate_ms"]) for r in b.user_w.collect()}
    assert ua.keys() == ub.keys()
    for u in ua:
        np.testing.assert_allclose(ua[u], ub[u], atol=1e-9)
    cols = ("gate_in", "cand_in", "out", "gate_in_ms", "out_ms")
    ia = {r["item"]: np.concatenate([r[c] for c in cols]) for r in a.item_w.collect()}
    ib = {r["item"]: np.concatenate([r[c] for c in cols]) for r in b.item_w.collect()}
    assert ia.keys() == ib.keys()
    for i in ia:
        np.testing.assert_allclose(ia[i], ib[i], atol=1e-9)
    sa_ = {r["name"]: np.asarray(r["v"]) for r in a.shared_w.collect()}
    sb_ = {r["name"]: np.asarray(r["v"]) for r in b.shared_w.collect()}
    for k in sa_:
        np.testing.assert_allclose(sa_[k], sb_[k], atol=1e-9)


def test_tiny_arrow_batches_give_the_same_fold_and_step(spark):
    """Users and windows spanning many Arrow batches (7 rows each): state carried across
    batches, finished users evicted, open windows held back; results unchanged."""
    from seqwright.model.scoring import score
    from seqwright.model.training import train_step
    H = 3
    rows, t, num_items = _setup(spark, H)
    for carry in (True, False):
        kw = dict(num_items=num_items, hidden=H, carry=carry)
        a = score(spark, rows, t.user_w, t.item_w, t.shared_w, **kw).select("user", "seg", "pos", "h", "lse")
        b = score(spark, rows, t.user_w, t.item_w, t.shared_w, batch_rows=7, **kw).select(
            "user", "seg", "pos", "h", "lse")
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    for carry in (False, True):
        base = dict(hidden=H, num_items=num_items, lr=0.05, carry=carry)
        x, sx = train_step(spark, rows, t, StepConfig(**base), 16)
        y, sy = train_step(spark, rows, t, StepConfig(**base, batch_rows=7), 16)
        assert abs(sx["loss"] - sy["loss"]) < 1e-9
        ux = {r["user"]: np.asarray(r["gate"] + r["cand"]) for r in x.user_w.collect()}
        uy = {r["user"]: np.asarray(r["gate"] + r["cand"]) for r in y.user_w.collect()}
        for u in ux:
            np.testing.assert_allclose(ux[u], uy[u], atol=1e-10)


def test_fit_limits_steps_and_validation_batches(spark):
    """steps_per_epoch and validation_steps (the reference's step-limited epochs)."""
    H = 3
    rows, t, num_items = _setup(spark, H)
    cfg = StepConfig(hidden=H, num_items=num_items, lr=0.01)
    _, log = fit(spark, rows, rows, t, cfg, window_len=16, epochs=1, n_batches=4, steps_per_epoch=2,
                 validation_steps=1, seed=5)
    recs = spark.read.parquet(log).collect()
    train = [r for r in recs if r["split"] == "train"]
    valid = [r for r in recs if r["split"] == "valid"]
    assert len(train) == 2 and len(valid) == 1
    total = rows.where(F.col("target") > 0).count()
    assert 0 < valid[0]["n"] < total


def test_fit_keeps_one_generation_of_step_tables(spark):
    """Superseded step folders are removed; the returned tables stay readable."""
    import os
    from seqwright.session import checkpoint_dir
    H = 3
    rows, t, num_items = _setup(spark, H)
    cfg = StepConfig(hidden=H, num_items=num_items, lr=0.01)
    base = checkpoint_dir(spark).replace("file:", "")
    before = {d for d in os.listdir(base) if d.startswith("step0")}
    t2, _ = fit(spark, rows, None, t, cfg, window_len=16, epochs=2, n_batches=2, steps_per_epoch=None, seed=3)
    steps = {d for d in os.listdir(base) if d.startswith("step0")} - before
    assert len(steps) == 1
    assert t2.user_w.count() == t.user_w.count() and t2.item_w.count() == num_items + 1


def test_item_logits_agree_with_fold_statistics(spark):
    from seqwright.model.scoring import item_logits, score
    H = 3
    rows, t, num_items = _setup(spark, H)
    sc = score(spark, rows, t.user_w, t.item_w, t.shared_w, num_items=num_items, hidden=H, carry=True)
    lg = item_logits(spark, sc, t.item_w, num_items, H)
    j = {(r["user"], r["seg"], r["pos"]): r for r in sc.collect()}
    for r in lg.collect():
        s = j[(r["user"], r["seg"], r["pos"])]
        v = np.asarray(r["logits"])
        assert len(v) == num_items + 1 and int(v.argmax()) == s["argmax"]
        assert abs(np.log(np.exp(v - v.max()).sum()) + v.max() - s["lse"]) < 1e-10
        assert abs(v[s["target"]] - s["tlogit"]) < 1e-10


def test_carry_fit_batches_hold_whole_users(spark):
    """With state carry, a step's batch holds all chunks of its users: the objective of a
    one-batch fit equals the objective of one step over all windows."""
    from seqwright.model.training import train_step
    H = 3
    rows, t, num_items = _setup(spark, H)
    cfg = StepConfig(hidden=H, num_items=num_items, lr=0.01, carry=True)
    _, log = fit(spark, rows, None, t, cfg, window_len=16, epochs=1, n_batches=3, steps_per_epoch=None, seed=9)
    recs = spark.read.parquet(log).collect()
    n_total = sum(r["n"] for r in recs)
    _, st = train_step(spark, rows, t, cfg, 16)
    assert n_total == st["n"]
    from seqwright.operators.batching import batch_ids
    b = batch_ids(rows, 3, 9, 1, ("user",)).groupBy("user").agg(F.countDistinct("batch_id").alias("k"))
    assert b.where(F.col("k") > 1).count() == 0
