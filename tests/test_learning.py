"""Training loop: losses fall, same seed -> same weights, weight table round trip."""

import numpy as np
import pytest

from tests.conftest import SF001
from txguard.learning import autoencoder as ae
from txguard.learning import jobs
from txguard.operators import scoring as sc
from txguard.sources import fixtures
from txguard.sources.tables import read_table


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(0)
    ws = ae.init_weights(1)
    X = rng.normal(size=(5, 29))
    loss, gs = ae.grads(ws, X)
    W, b = ws[3]
    eps = 1e-6
    Wp = W.copy()
    Wp[2, 3] += eps
    lp, _ = ae.grads(ws[:3] + [(Wp, b)], X)
    assert abs((lp - loss) / eps - gs[3][0][2, 3]) < 1e-4


def test_training_reduces_loss_and_is_repeatable(spark):
    cards = fixtures.card_tx(read_table(spark, SF001, "events"))
    _, r1 = jobs.training_job(cards, epochs=4)
    _, r2 = jobs.training_job(cards, epochs=4)
    losses = [h[2] for h in r1.history]
    assert losses[-1] < losses[0]
    for (W1, b1), (W2, b2) in zip(r1.weights, r2.weights):
        assert np.allclose(W1, W2) and np.allclose(b1, b2)


def test_weight_table_round_trip(spark):
    ws = ae.init_weights(3)
    back = ae.weights_from_frame(ae.weights_frame(spark, ws))
    for (W1, b1), (W2, b2) in zip(ws, back):
        assert np.array_equal(W1, W2) and np.array_equal(b1, b2)


def test_jvm_forward_matches_numpy(spark):
    ws = ae.init_weights(5)
    rng = np.random.default_rng(1)
    X = rng.normal(size=(20, 29))
    df = spark.createDataFrame([tuple(map(float, r)) for r in X], ",".join(f"x{i} double" for i in range(29)))
    out = sc.recon_mse(sc.reconstruct(df, ae.as_lists(ws), [f"x{i}" for i in range(29)]))
    got = np.array([r["mse"] for r in out.collect()])
    exp = ((ae.forward(ws, X)[-1] - X) ** 2).mean(axis=1)
    assert np.allclose(got, exp, rtol=1e-10)


def test_scaler_round_trip(spark, tmp_path):
    s = sc.Scaler.reference()
    jobs.save_scaler(s.to_frame(spark), str(tmp_path / "scaler"))
    back = jobs.load_scaler(spark, str(tmp_path / "scaler"))
    assert back.mean == s.mean and back.scale == s.scale


def plain_training(X, keys, epochs, batch_size, lr, seed):
    """One process, one optimiser state, the same mini-batches."""
    ws = ae.init_weights(seed)
    opt = ae.Adam(ws, lr)
    batches = -(-len(X) // batch_size)
    losses = []
    for epoch in range(epochs):
        mine = ae.batch_of(keys, seed, epoch, batches)
        total = 0.0
        for k in range(batches):
            xb = X[mine == k]
            if len(xb):
                loss, gs = ae.grads(ws, xb)
                ws = opt.step(ws, gs)
                total += loss * len(xb)
        losses.append(total / len(X))
    return ws, losses


def test_synchronous_training_does_not_depend_on_the_tasks(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(700, 29))
    X[5] = X[6] = X[7]
    cols = [f"x{i}" for i in range(29)]
    rows = [(k, *map(float, r)) for k, r in enumerate(X)] + [(700, *([None] + [0.0] * 28))]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in cols))
    keys = np.array([r[0] for r in df.filter("id < 700").orderBy("id").selectExpr("xxhash64(id)").collect()])
    ws, losses = plain_training(X, keys, 2, 256, 1e-3, 7)
    for tasks in (1, min(8, spark.sparkContext.defaultParallelism)):
        got = ae.fit_autoencoder(df.repartition(5), cols, epochs=2, batch_size=256, seed=7, key="id", tasks=tasks)
        assert got.dropped == 1
        assert np.abs(ae.flatten(got.weights) - ae.flatten(ws)).max() < 1e-9
        assert np.allclose([h[1] for h in got.history], losses, rtol=1e-9)
    with pytest.raises(ValueError, match="at once"):
        ae.fit_autoencoder(df, cols, key="id", tasks=100_000)
    # a mini-batch holds about as many rows as asked for, and another epoch deals them out anew
    one, two = (np.bincount(ae.batch_of(keys, 7, e, 11)) for e in (0, 1))
    assert one.max() < 110 and (ae.batch_of(keys, 7, 0, 11) != ae.batch_of(keys, 7, 1, 11)).mean() > 0.8


def test_training_in_turns_takes_the_same_steps(spark, monkeypatch):
    """More rows than a task holds: several turns, no exchange of messages per mini-batch, the weights of one process."""
    rng = np.random.default_rng(5)
    X = rng.normal(size=(1500, 29))
    cols = [f"x{i}" for i in range(29)]
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(X)], "id long, " + ", ".join(f"{c} double" for c in cols))
    keys = np.array([r[0] for r in df.orderBy("id").selectExpr("xxhash64(id)").collect()])
    ws, losses = plain_training(X, keys, 2, 100, 1e-3, 7)
    monkeypatch.setattr(ae, "ROWS_PER_TASK", 600)
    monkeypatch.setattr(ae, "ROWS_PER_TURN", 700)
    monkeypatch.setattr(ae, "_sync_epochs", None)
    got = ae.fit_autoencoder(df.repartition(5), cols, df.limit(300), epochs=2, batch_size=100, seed=7, key="id")
    assert np.abs(ae.flatten(got.weights) - ae.flatten(ws)).max() < 1e-9
    assert np.allclose([h[1] for h in got.history], losses, rtol=1e-9)
    assert np.isclose(got.history[-1][2], ((ae.forward(ws, X[:300])[-1] - X[:300]) ** 2).mean())


def test_averaging_keeps_the_moments(spark):
    """With one partition that holds one Arrow batch, averaging is plain training with this mode's own batches."""
    rng = np.random.default_rng(3)
    X = rng.normal(size=(300, 29))
    cols = [f"x{i}" for i in range(29)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in X], ", ".join(f"{c} double" for c in cols)).coalesce(1)
    got = ae.fit_autoencoder(df, cols, epochs=3, batch_size=64, seed=7, mode="average")
    ws = ae.init_weights(7)
    opt = ae.Adam(ws, 1e-3)
    for epoch in range(3):
        shuffled = X[np.random.default_rng([7, epoch, 0]).permutation(len(X))]
        for i in range(0, len(X), 64):
            ws = opt.step(ws, ae.grads(ws, shuffled[i:i + 64])[1])
    assert np.abs(ae.flatten(got.weights) - ae.flatten(ws)).max() < 1e-9


def test_models_from_files(spark, tmp_path):
    ws = ae.init_weights(4)
    ae.save_weights(spark, ws, str(tmp_path / "weights"))
    back = ae.load_weights(spark, str(tmp_path / "weights"))
    assert back == ae.as_lists(ws)
    cards = fixtures.card_tx(read_table(spark, SF001, "events"))
    from txguard.operators.features import engineer_features
    feats = engineer_features(cards)
    model = jobs.fit_supervised(feats, max_iter=2)
    jobs.save_supervised(model, str(tmp_path / "gbt"))
    again = jobs.load_supervised(str(tmp_path / "gbt"))
    a, b = (sc.supervised_probability(feats, m, "p").orderBy("event_id").select("p").collect() for m in (model, again))
    assert a == b


def test_supervised_query_computes_the_features_once(spark, monkeypatch):
    from txguard.plans import q_stream
    rows = spark.sparkContext.accumulator(0)
    plain = q_stream.engineer_features

    def counted(df):
        out = plain(df)

        def count(batches):
            for b in batches:
                rows.add(b.num_rows)
                yield b
        return out.mapInArrow(count, out.schema)
    monkeypatch.setattr(q_stream, "engineer_features", counted)
    out = q_stream.q_supervised(spark, SF001).collect()
    assert [tuple(r) for r in out] == [(rows.value, True, True)]
