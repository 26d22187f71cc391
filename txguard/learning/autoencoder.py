"""Autoencoder training as Spark jobs.

``mode="sync"`` trains as one process would: a barrier stage whose tasks each
hold a share of the rows in memory.  Every mini-batch is the same set of rows
whatever the partitioning (a hash of the row's key, the seed and the epoch says
which), its gradient sums are gathered by all tasks in task order, and all of
them take the same step of one Adam state, which lives through all epochs.  So
the weights do not depend on the number of tasks.  A task holds at most
``ROWS_PER_TASK`` rows; several (``tasks``) exchange a round of messages a
mini-batch, about a second by Spark's barrier.

Without ``tasks``, more rows than that are trained on *in turns*: the same
mini-batches and the same steps, but no messages.  Per epoch all cores deal the rows to
their mini-batches and write these, ``ROWS_PER_TURN`` rows a piece; then one
task a piece streams it and hands the weights and moments on to the next one.
Steps follow each other, as in any such training, so their time grows with
rows times epochs; no task holds more than an Arrow batch of rows while it trains.

``mode="average"`` is for data with too many mini-batches for that: per epoch, one job in which every partition runs Adam
over its own rows, streamed as Arrow batches, from the broadcast weights and
moments.  These are averaged by row count in the JVM, one sum per number, so
3,761 numbers reach the driver whatever the partition count.

Validation loss is one aggregate over the validation rows.  The training frame
is written once to the session's checkpoint folder (lineage cut; survives
executor loss) and deleted after the fit.  Rows with a missing feature cannot
be trained on; they are left out and counted.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txguard.schemas import AE_LAYERS
from txguard.session import ensure_checkpoint_dir


def hash_split(df: DataFrame, key: str, seed: int = 42, train_pct: int = 80) -> tuple[DataFrame, DataFrame]:
    """Seeded split by key hash: stable under any repartitioning or retry, and the same in other engines."""
    text = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    b = F.conv(F.substring(text, 1, 8), 16, 10).cast("bigint") % 100
    return df.filter(b < train_pct), df.filter(b >= train_pct)


def init_weights(seed: int, layers=AE_LAYERS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Uniform(-1/sqrt(fan_in), 1/sqrt(fan_in)) for weights and biases."""
    rng = np.random.default_rng(seed)
    out = []
    for n_in, n_out in layers:
        k = 1.0 / np.sqrt(n_in)
        out.append((rng.uniform(-k, k, (n_in, n_out)), rng.uniform(-k, k, n_out)))
    return out


def flatten(ws) -> np.ndarray:
    return np.concatenate([np.concatenate([W.ravel(), b]) for W, b in ws])


def unflatten(v: np.ndarray, layers=AE_LAYERS):
    out, i = [], 0
    for n_in, n_out in layers:
        W = v[i:i + n_in * n_out].reshape(n_in, n_out)
        i += n_in * n_out
        b = v[i:i + n_out]
        i += n_out
        out.append((W, b))
    return out


def forward(ws, X):
    acts = [X]
    h = X
    for l, (W, b) in enumerate(ws):
        z = h @ W + b
        h = np.maximum(z, 0.0) if l < len(ws) - 1 else z
        acts.append(h)
    return acts


def grads(ws, X):
    """Loss = mean over batch and outputs of (recon - x)^2, and its gradients."""
    acts = forward(ws, X)
    out = acts[-1]
    n = X.shape[0] * X.shape[1]
    delta = 2.0 * (out - X) / n
    loss = float(np.mean((out - X) ** 2))
    gs = [None] * len(ws)
    for l in range(len(ws) - 1, -1, -1):
        W, _ = ws[l]
        gs[l] = (acts[l].T @ delta, delta.sum(axis=0))
        if l > 0:
            delta = (delta @ W.T) * (acts[l] > 0)
    return loss, gs


class Adam:
    """Adam over a list of parameter arrays (W1, b1, W2, b2, ...)."""

    def __init__(self, ws, lr, b1=0.9, b2=0.999, eps=1e-8):
        self.lr, self.b1, self.b2, self.eps, self.t = lr, b1, b2, eps, 0
        params = [p for Wb in ws for p in Wb]
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, ws, gs):
        self.t += 1
        params = [p for Wb in ws for p in Wb]
        grads_ = [g for gWb in gs for g in gWb]
        new = []
        for k, (p, g) in enumerate(zip(params, grads_)):
            self.m[k] = self.b1 * self.m[k] + (1 - self.b1) * g
            self.v[k] = self.b2 * self.v[k] + (1 - self.b2) * g * g
            mh = self.m[k] / (1 - self.b1 ** self.t)
            vh = self.v[k] / (1 - self.b2 ** self.t)
            new.append(p - self.lr * mh / (np.sqrt(vh) + self.eps))
        return [(new[2 * i], new[2 * i + 1]) for i in range(len(ws))]

    def state(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (*self.m, *self.v)])

    def resume(self, state: np.ndarray, steps: int) -> None:
        """Go on from the moments that ``state`` returned."""
        at = 0
        for arrays in (self.m, self.v):
            for k, x in enumerate(arrays):
                arrays[k] = state[at:at + x.size].reshape(x.shape)
                at += x.size
        self.t = steps


def batch_of(keys: np.ndarray, seed: int, epoch: int, batches: int) -> np.ndarray:
    """The mini-batch of each row in an epoch, from the hash of its key."""
    x = keys.astype(np.int64).view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + epoch * 0xD6E8FEB86659FD93) % 2**64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(batches)).astype(np.int64)


class Steps:
    """Adam steps on one flat vector of parameters, in place; the arithmetic of ``grads`` and ``Adam``."""

    def __init__(self, flat: np.ndarray, moments: np.ndarray, steps: int, lr: float, layers=AE_LAYERS, b1=0.9, b2=0.999, eps=1e-8):
        self.flat, self.t = np.array(flat, float), steps
        self.m, self.v = np.array(moments, float).reshape(2, -1)
        self.lr, self.b1, self.b2, self.eps = lr, b1, b2, eps
        self.g = np.empty_like(self.flat)
        self.ws, self.gs = unflatten(self.flat, layers), unflatten(self.g, layers)      # views

    def step(self, X: np.ndarray) -> float:
        """One step on a mini-batch; its loss sum, as in ``batch_sums``."""
        acts, last = [X], len(self.ws) - 1
        for l, (W, b) in enumerate(self.ws):
            z = acts[-1] @ W
            z += b
            if l < last:
                np.maximum(z, 0.0, out=z)
            acts.append(z)
        delta = acts[-1]
        delta -= X
        loss_sum = float(np.vdot(delta, delta)) / X.shape[1]
        delta *= 2.0 / X.size
        for l in range(last, -1, -1):
            gW, gb = self.gs[l]
            np.dot(acts[l].T, delta, out=gW)
            np.add.reduce(delta, axis=0, out=gb)
            if l > 0:
                delta = delta @ self.ws[l][0].T
                delta *= acts[l] > 0
        self.t += 1
        g, m, v = self.g, self.m, self.v
        m *= self.b1
        m += (1 - self.b1) * g
        np.square(g, out=g)
        g *= 1 - self.b2
        v *= self.b2
        v += g
        np.divide(v, 1 - self.b2 ** self.t, out=g)
        np.sqrt(g, out=g)
        g += self.eps
        np.divide(m, g, out=g)
        g *= self.lr / (1 - self.b1 ** self.t)
        self.flat -= g
        return loss_sum


def batch_sums(ws, X: np.ndarray) -> np.ndarray:
    """Gradient sums over rows, then the loss sum and the rows: what adds up over the parts of a mini-batch."""
    if not len(X):
        return np.zeros(len(flatten(ws)) + 2)
    loss, gs = grads(ws, X)
    return np.concatenate([flatten(gs) * len(X), [loss * len(X), len(X)]])


#: Rows that a task of synchronous training holds (29 numbers and a key each, 120 MB).
ROWS_PER_TASK = 500_000


def _sync_fn(flat_bc, cols: list[str], batches: int, epochs: int, lr: float, seed: int, layers, tasks: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext
        task = BarrierTaskContext.get()
        parts = [b for b in it if b.num_rows]
        X = np.concatenate([np.column_stack([b.column(k).to_numpy() for k in range(len(cols))]) for b in parts]) if parts \
            else np.empty((0, len(cols)))
        keys = np.concatenate([b.column(len(cols)).to_numpy() for b in parts]) if parts else np.empty(0, np.int64)
        ws = unflatten(np.asarray(flat_bc.value), layers)
        opt = Adam(ws, lr)
        for epoch in range(epochs):
            mine = batch_of(keys, seed, epoch, batches)
            order = np.lexsort((keys, mine))
            border = np.searchsorted(mine[order], np.arange(batches + 1))
            loss_sum, rows = 0.0, 0.0
            for k in range(batches):
                sums = batch_sums(ws, X[order[border[k]:border[k + 1]]])
                total = sums
                if tasks > 1:
                    gathered = task.allGather(base64.b64encode(sums.tobytes()).decode())
                    total = np.sum([np.frombuffer(base64.b64decode(m)) for m in gathered], axis=0)
                if total[-1]:
                    ws = opt.step(ws, unflatten(total[:-2] / total[-1], layers))
                    loss_sum, rows = loss_sum + total[-2], rows + total[-1]
            if task.partitionId() == 0:
                yield pa.record_batch([pa.array([epoch], pa.int32()), pa.array([flatten(ws).tolist()], pa.list_(pa.float64())),
                                       pa.array([loss_sum / rows if rows else None], pa.float64())], names=["epoch", "flat", "loss"])
    return run


#: Rows that a turn trains on, and rows in one stored value (so that an Arrow batch of 10,000 values holds 74 MB).
ROWS_PER_TURN = 2_000_000
ROWS_PER_VALUE = 32


def _packed_fn(n_cols: int):
    """Rows of numbers and a key as one value and the key."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            X = np.column_stack([b.column(k).to_numpy() for k in range(n_cols)])
            x = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * n_cols), len(X), [None, pa.py_buffer(X.tobytes())])
            yield pa.record_batch([b.column(n_cols), x.cast(pa.binary())], names=["_key", "x"])
    return run


def _dealt_fn(batches: int, per_turn: int, seed: int, epoch: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            mine = batch_of(b.column(0).to_numpy(), seed, epoch, batches)
            yield pa.record_batch([pa.array((mine // per_turn).astype(np.int32)), pa.array(mine), *b.columns],
                                  names=["turn", "batch", "_key", "x"])
    return run


def _values_fn(width: int):
    """Rows (turn, batch, key, x) in order of batch and key as values of up to ``ROWS_PER_VALUE`` rows of one mini-batch."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in it:
            turn, batch = b.column(0).to_numpy(), b.column(1).to_numpy()
            data = b"".join(b.column(3).to_pylist())
            new = np.concatenate([[0], np.flatnonzero(np.diff(batch)) + 1, [len(batch)]])
            cuts = np.concatenate([np.arange(i, j, ROWS_PER_VALUE) for i, j in zip(new[:-1], new[1:])])
            ends = np.append(cuts[1:], len(batch))
            yield pa.record_batch([pa.array(turn[cuts]), pa.array(batch[cuts]), pa.array(np.arange(at, at + len(cuts))),
                                   pa.array([data[i * width:j * width] for i, j in zip(cuts.tolist(), ends.tolist())], pa.binary())],
                                  names=["turn", "batch", "part", "x"])
            at += len(cuts)
    return run


def _turn_fn(state_bc, n_cols: int, lr: float, layers):
    """All steps of one turn, from the values in order; one row with the weights, moments, steps, loss sum and rows after it."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, moments, steps = state_bc.value
        model = Steps(flat, moments, steps, lr, layers)
        loss_sum, rows, current, held = 0.0, 0, None, []

        def train():
            nonlocal loss_sum, rows
            X = np.frombuffer(b"".join(held)).reshape(-1, n_cols)
            loss_sum, rows = loss_sum + model.step(X), rows + len(X)

        for b in it:
            for batch, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if batch != current and held:
                    train()
                    held = []
                current = batch
                held.append(x)
        if held:
            train()
        yield pa.record_batch([pa.array([x.tolist()], pa.list_(pa.float64())) for x in (model.flat, np.concatenate([model.m, model.v]))]
                              + [pa.array([model.t], pa.int64()), pa.array([loss_sum], pa.float64()), pa.array([rows], pa.int64())],
                              names=["flat", "moments", "steps", "loss_sum", "rows"])
    return run


def _turn_epochs(data: DataFrame, rows: int, cols, epochs, batch_size, lr, seed, layers):
    """(weights, train loss) of every epoch: the steps of ``_sync_epochs``, a piece of the mini-batches after the other."""
    spark = data.sparkSession
    batches = max(1, -(-rows // batch_size))
    turns = -(-rows // ROWS_PER_TURN)
    per_turn = -(-batches // turns)
    packed, packed_path = materialize(data.mapInArrow(_packed_fn(len(cols)), "_key long, x binary"), "ae-rows")
    flat = flatten(init_weights(seed, layers))
    moments, steps = np.zeros(2 * len(flat)), 0
    pieces = max(turns, int(spark.conf.get("spark.sql.shuffle.partitions")))
    per_piece = -(-batches // pieces)
    for epoch in range(epochs):
        # a piece has all rows of its mini-batches, in order; pieces of one turn go to one folder
        dealt = (packed.mapInArrow(_dealt_fn(batches, per_turn, seed, epoch), "turn int, batch long, _key long, x binary")
                 .repartitionById(pieces, F.floor(F.col("batch") / per_piece).cast("int"))
                 .sortWithinPartitions("batch", "_key", "x")
                 .mapInArrow(_values_fn(8 * len(cols)), "turn int, batch long, part long, x binary"))
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ae-epoch-{uuid.uuid4().hex}"
        dealt.write.partitionBy("turn").parquet(path)
        written = spark.read.schema("batch long, part long, x binary, turn int").parquet(path)
        loss_sum, seen = 0.0, 0
        for turn in range(turns):
            bc = spark.sparkContext.broadcast((flat, moments, steps))
            r = (written.filter(F.col("turn") == turn).select("batch", "part", "x").coalesce(1).sortWithinPartitions("batch", "part")
                 .select("batch", "x").mapInArrow(_turn_fn(bc, len(cols), lr, layers),
                                                  "flat array<double>, moments array<double>, steps long, loss_sum double, rows long")
                 .collect())          # the weights and moments
            bc.unpersist()
            if r:
                flat, moments, steps = np.asarray(r[0]["flat"]), np.asarray(r[0]["moments"]), r[0]["steps"]
                loss_sum, seen = loss_sum + r[0]["loss_sum"], seen + r[0]["rows"]
        discard(spark, path)
        yield unflatten(flat, layers), loss_sum / seen
    discard(spark, packed_path)


def _epoch_fn(state_bc, cols, batch_size, lr, seed, epoch, layers):
    def run(it):
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId() if TaskContext.get() else 0
        flat, moments, steps = state_bc.value
        ws = unflatten(np.asarray(flat), layers)
        opt = Adam(ws, lr)
        opt.resume(np.asarray(moments), steps)
        rng = np.random.default_rng([seed, epoch, pid])
        n, loss_sum = 0, 0.0
        for pdf in it:
            if pdf.empty:
                continue
            X = pdf[cols].to_numpy(dtype="float64")
            X = X[rng.permutation(len(X))]
            for i in range(0, len(X), batch_size):
                xb = X[i:i + batch_size]
                loss, gs = grads(ws, xb)
                ws = opt.step(ws, gs)
                loss_sum += loss * len(xb)
            n += len(X)
        if n == 0:
            return
        # weights and moments times rows, then steps, rows and the loss sum: adding these up gives all an epoch needs
        yield pd.DataFrame({"sums": [[*(flatten(ws) * n).tolist(), *(opt.state() * n).tolist(), float((opt.t - steps) * n), float(n), loss_sum]]})
    return run


@dataclass
class FitResult:
    weights: list
    history: list = field(default_factory=list)     # (epoch, train_loss, val_loss)
    dropped: int = 0                                # rows left out for a missing feature

    def losses_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.history, "epoch int, train_loss double, val_loss double")


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` under the session checkpoint folder and read it back; also the path, for ``discard``."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), path


def discard(spark, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _sse_fn(flats_bc, layers):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [unflatten(np.asarray(flat), layers) for flat in flats_bc.value]
        n, sse = 0, np.zeros(len(models))
        for b in it:
            if not b.num_rows:
                continue
            X = np.column_stack([c.to_numpy() for c in b.columns])
            sse += [float(((forward(ws, X)[-1] - X) ** 2).sum()) for ws in models]
            n += X.size
        yield pa.record_batch([pa.array(range(len(models)), pa.int32()), pa.array([n] * len(models), pa.int64()), pa.array(sse)],
                              names=["model", "n", "sse"])
    return run


def val_losses(val: DataFrame, models: list, cols, layers=AE_LAYERS) -> list[float]:
    """Mean squared reconstruction error of each model over all validation cells, from one read of them."""
    spark = val.sparkSession
    bc = spark.sparkContext.broadcast([flatten(ws) for ws in models])
    found = {r["model"]: r for r in val.select(*cols).mapInArrow(_sse_fn(bc, layers), "model int, n long, sse double")
             .groupBy("model").agg(F.sum("n").alias("n"), F.sum("sse").alias("sse")).collect()}      # a row per model
    bc.unpersist()
    return [found[k]["sse"] / found[k]["n"] if k in found and found[k]["n"] else float("nan") for k in range(len(models))]


def val_loss(val: DataFrame, weights, cols, layers=AE_LAYERS) -> float:
    """Mean squared reconstruction error over all validation cells."""
    return val_losses(val.na.drop(subset=cols), [weights], cols, layers)[0]


def _sync_epochs(data: DataFrame, rows: int, cols, epochs, batch_size, lr, seed, layers, tasks: int):
    """(weights, train loss) of every epoch, from one barrier stage."""
    sc = data.sparkSession.sparkContext
    if tasks > sc.defaultParallelism:
        raise ValueError(f"synchronous training of {rows} rows needs {tasks} tasks at once, there is room for "
                         f"{sc.defaultParallelism}: use mode='average'")
    bc = sc.broadcast(flatten(init_weights(seed, layers)).tolist())
    fn = _sync_fn(bc, cols, max(1, -(-rows // batch_size)), epochs, lr, seed, layers, tasks)
    out = data.repartition(tasks).mapInArrow(fn, "epoch int, flat array<double>, loss double", barrier=True)
    found = sorted(out.collect())              # one row of weights per epoch
    bc.unpersist()
    for r in found:
        yield unflatten(np.asarray(r["flat"]), layers), r["loss"]


def _averaged_epochs(data: DataFrame, cols, epochs, batch_size, lr, seed, layers):
    """(weights, train loss) of every epoch, one job each."""
    sc = data.sparkSession.sparkContext
    flat = flatten(init_weights(seed, layers))
    size, steps = len(flat), 0
    moments = np.zeros(2 * size)
    for epoch in range(epochs):
        bc = sc.broadcast((flat.tolist(), moments.tolist(), steps))
        sums = (data.select(*cols).mapInPandas(_epoch_fn(bc, cols, batch_size, lr, seed, epoch, layers), "sums array<double>")
                .select(F.posexplode("sums").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x")))
        found = dict(sums.collect())           # one number per weight and moment
        bc.unpersist()
        *numbers, taken, total, loss_sum = (found[k] for k in range(len(found)))
        numbers = np.asarray(numbers) / total
        flat, moments, steps = numbers[:size], numbers[size:], steps + round(taken / total)
        yield unflatten(flat, layers), loss_sum / total


def fit_autoencoder(train: DataFrame, cols: list[str], val: DataFrame | None = None, epochs: int = 15,
                    batch_size: int = 256, lr: float = 1e-3, seed: int = 42, keep: str = "last",
                    layers=AE_LAYERS, mode: str = "sync", key: str | None = None, tasks: int | None = None) -> FitResult:
    """Train on scaled feature columns ``cols``; keep='last' (parity) or 'best'.

    ``key`` names a column that tells rows apart and so deals them out to
    mini-batches (without one the features do, and equal rows share theirs).
    ``tasks`` of mode "sync" must all run at once; by default one holds the
    rows, and more than ``ROWS_PER_TASK`` are trained on in turns.
    """
    if mode not in ("sync", "average"):
        raise ValueError(f"mode is sync or average, not {mode}")
    spark = train.sparkSession
    numbers = [F.col(c).cast("double").alias(c) for c in cols]
    data, path = materialize(train.select(*numbers, F.xxhash64(*([key] if key else cols)).alias("_key")), "ae-train")
    paths = [path]
    if val is not None:
        val, path = materialize(val.select(*numbers), "ae-val")
        paths.append(path)
        val = val.na.drop()
    missing = F.greatest(*[(F.col(c).isNull() | F.isnan(c)).cast("int") for c in cols])
    counts = data.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(missing), F.lit(0)).alias("missing")).first()
    rows = counts["n"] - counts["missing"]
    if not rows:
        raise ValueError("no row to train on")
    data = data.na.drop()
    if mode == "sync" and not tasks and rows > ROWS_PER_TASK:
        fitted = _turn_epochs(data, rows, cols, epochs, batch_size, lr, seed, layers)
    elif mode == "sync":
        fitted = _sync_epochs(data, rows, cols, epochs, batch_size, lr, seed, layers, tasks or 1)
    else:
        fitted = _averaged_epochs(data, cols, epochs, batch_size, lr, seed, layers)
    ws = best = init_weights(seed, layers)
    best_loss = float("inf")
    res = FitResult(ws, dropped=counts["missing"])
    fitted = list(fitted)                      # one set of weights per epoch
    losses = val_losses(val, [ws for ws, _ in fitted], cols, layers) if val is not None else [float("nan")] * len(fitted)
    for epoch, ((ws, loss), vl) in enumerate(zip(fitted, losses)):
        res.history.append((epoch + 1, loss, vl))
        if val is not None and vl < best_loss:
            best, best_loss = ws, vl
    for path in paths:
        discard(spark, path)
    res.weights = best if keep == "best" and val is not None else ws
    return res


def as_lists(weights) -> list:
    return [(np.asarray(W).tolist(), np.asarray(b).tolist()) for W, b in weights]


def weights_frame(spark, weights) -> DataFrame:
    """Weight table: one row per (layer, kind) with values as array<double>."""
    rows = []
    for l, (W, b) in enumerate(weights):
        W = np.asarray(W)
        rows.append((l, "W", W.shape[0], W.shape[1], W.ravel().tolist()))
        rows.append((l, "b", 1, len(b), np.asarray(b).tolist()))
    return spark.createDataFrame(rows, "layer int, kind string, n_in int, n_out int, values array<double>")


def weights_from_frame(df: DataFrame) -> list:
    rows = sorted(df.collect(), key=lambda r: (r["layer"], r["kind"]))
    out = {}
    for r in rows:
        v = np.asarray(r["values"])
        out.setdefault(r["layer"], {})[r["kind"]] = v.reshape(r["n_in"], r["n_out"]) if r["kind"] == "W" else v
    return [(out[l]["W"], out[l]["b"]) for l in sorted(out)]


def save_weights(spark, weights, path: str) -> None:
    """The model as a table, one row per layer and kind."""
    weights_frame(spark, weights).coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark, path: str) -> list:
    return as_lists(weights_from_frame(spark.read.parquet(path)))
