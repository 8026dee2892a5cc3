"""Small dense networks: exact sequential training inside a task, many models side by side, batch scoring."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmill.functions.labels import CLASSES
from driftmill.operators import audit, metrics
from driftmill.operators.schema_diff import WIDTHS
from driftmill.runtime import cut

#: Rows of one training set; training is sequential by its definition, so one model's rows lie in one task.
MAX_TRAINING_ROWS = 2_000_000
NORMAL, PAIRED = "normal-family-split", "same-mutation-different-policy"
#: Changes that are only held out by structural variant; without them nothing of their kind is left in training.
BY_VARIANT = ("enum_value_added", "optional_field_added")


@dataclass
class Network:
    weights: list[np.ndarray]  # (outputs, inputs) of each layer
    biases: list[np.ndarray]
    activations: list[str]

    def __post_init__(self) -> None:
        for i, (w, b) in enumerate(zip(self.weights, self.biases)):
            if w.ndim != 2 or b.shape != (w.shape[0],) or (i and w.shape[1] != self.weights[i - 1].shape[0]):
                raise ValueError("layer dimensions do not fit")

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """Outputs of all layers, the input first."""
        outs = [x]
        for w, b, a in zip(self.weights, self.biases, self.activations):
            z = outs[-1] @ w.T + b
            outs.append(activate(a, z))
        return outs

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[-1]


def activate(kind: str, z: np.ndarray) -> np.ndarray:
    if kind == "relu":
        return np.maximum(z, 0)
    if kind == "tanh":
        return np.tanh(z)
    if kind == "sigmoid":
        e = np.exp(-np.abs(z))
        return np.where(z >= 0, 1 / (1 + e), e / (1 + e))
    if kind == "softmax":
        e = np.exp(z - z.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)
    return z


def _slope(kind: str, y: np.ndarray) -> np.ndarray:
    return {"relu": (y > 0).astype(float), "tanh": 1 - y * y, "sigmoid": y * (1 - y)}.get(kind, np.ones_like(y))


def initial(sizes: list[int], head: str) -> Network:
    """Weights by a fixed rule of layer, neuron and input number; hidden layers are relu."""
    weights, biases = [], []
    for layer, (n_in, n_out) in enumerate(zip(sizes, sizes[1:])):
        n, i = np.arange(n_out)[:, None], np.arange(n_in)[None, :]
        weights.append(((layer + 1) * (n + 2) * (i + 3) % 11) / 100 - 0.05)
        biases.append(((layer + np.arange(n_out)) % 5) / 100 - 0.02)
    return Network(weights, biases, ["relu"] * (len(sizes) - 2) + [head])


@dataclass
class Optimizer:
    """sgd, momentum (v = m v + g) or adam with bias correction."""

    kind: str = "sgd"
    rate: float = 0.05
    momentum: float = 0.9
    beta1: float = 0.9
    beta2: float = 0.999
    epsilon: float = 1e-8
    state: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    steps: int = 0

    def update(self, parameters: list[np.ndarray], gradients: list[np.ndarray]) -> None:
        self.steps += 1
        for i, (p, g) in enumerate(zip(parameters, gradients)):
            if self.kind == "sgd":
                p -= self.rate * g
                continue
            m, v = self.state.setdefault(i, (np.zeros_like(p), np.zeros_like(p)))
            if self.kind == "momentum":
                m *= self.momentum
                m += g
                p -= self.rate * m
            else:
                m *= self.beta1
                m += (1 - self.beta1) * g
                v *= self.beta2
                v += (1 - self.beta2) * g * g
                p -= self.rate * (m / (1 - self.beta1**self.steps)) / (np.sqrt(v / (1 - self.beta2**self.steps)) + self.epsilon)


def _row_losses(net: Network, y: np.ndarray, t: np.ndarray) -> np.ndarray:
    if net.activations[-1] == "softmax":
        return -(t * np.log(np.clip(y, 1e-15, 1 - 1e-15))).sum(1)
    return ((y - t) ** 2).mean(1)


def loss(net: Network, x: np.ndarray, t: np.ndarray) -> float:
    return float(_row_losses(net, net.predict(x), t).mean())


def gradients(net: Network, x: np.ndarray, t: np.ndarray) -> list[np.ndarray]:
    """Mean gradients of a batch: softmax with cross-entropy (p - t), else squared error."""
    _distributions(net, t)
    return _backward(net, net.forward(x), t)


def _distributions(net: Network, t: np.ndarray) -> None:
    if net.activations[-1] == "softmax" and np.abs(t.sum(1) - 1).max(initial=0) > 1e-9:
        raise ValueError("targets are no distribution")


def _backward(net: Network, outs: list[np.ndarray], t: np.ndarray) -> list[np.ndarray]:
    """Mean gradients from the outputs of all layers."""
    y, n = outs[-1], len(t)
    delta = y - t
    if net.activations[-1] != "softmax":
        delta *= 2 / y.shape[1]
        delta *= _slope(net.activations[-1], y)
    out: list[np.ndarray] = []
    for i in range(len(net.weights) - 1, -1, -1):
        out[:0] = (delta.T @ outs[i]) / n, delta.sum(0) / n
        if i:
            delta = delta @ net.weights[i]
            delta *= outs[i] > 0 if net.activations[i - 1] == "relu" else _slope(net.activations[i - 1], outs[i])
    return out


class Descent:
    """Plain gradient descent over relu layers and a softmax or sigmoid head, as few array operations a batch as can be:
    a bias is the weight of an input that is always 1, and the step's rate goes in with the head's error."""

    def __init__(self, net: Network, x: np.ndarray, t: np.ndarray, batch: int, rate: float):
        self.net, self.rate = net, rate
        one = lambda a: np.concatenate([a, np.ones((len(a), 1))], 1)
        self.weights = [np.concatenate([w, b[:, None]], 1) for w, b in zip(net.weights, net.biases)]
        inputs = one(x)
        self.batches = [(at, inputs[at : at + batch], t[at : at + batch]) for at in range(0, len(x), batch)]
        self.hidden = [np.ones((batch, w.shape[0] + 1)) for w in self.weights[:-1]]
        self.softmax = net.activations[-1] == "softmax"

    def epoch(self, said: np.ndarray) -> None:
        """One pass; ``said`` takes every batch's answer before its update. The network's parameters follow."""
        weights, last = self.weights, len(self.weights) - 1
        for at, a, t in self.batches:
            m = len(a)
            seen = [a]
            for w, h in zip(weights, self.hidden):
                h = h[:m]
                np.maximum(seen[-1] @ w.T, 0, out=h[:, :-1])
                seen.append(h)
            y = seen[-1] @ weights[-1].T
            if self.softmax:
                y -= y.max(1, keepdims=True)
                np.exp(y, out=y)
                y /= y.sum(1, keepdims=True)
                delta = y - t
                delta *= self.rate / m
            else:
                y = activate("sigmoid", y)
                delta = (y - t) * y * (1 - y)
                delta *= 2 * self.rate / (y.shape[1] * m)
            said[at : at + m] = y
            for i in range(last, -1, -1):
                w, h = weights[i], seen[i]
                step = delta.T @ h
                if i:
                    delta = delta @ w[:, :-1]
                    delta *= h[:, :-1] > 0
                w -= step
        for own, b, w in zip(self.net.weights, self.net.biases, weights):
            own[:], b[:] = w[:, :-1], w[:, -1]


def train(net: Network, x: np.ndarray, t: np.ndarray, epochs: int, batch: int, optimizer: Optimizer, validation: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[float, float | None]]:
    """Batches in row order, no shuffling; (mean loss before the updates, validation loss after) of each epoch."""
    if not len(x):
        raise ValueError("no training rows")
    _distributions(net, t)
    parameters = [p for pair in zip(net.weights, net.biases) for p in pair]
    starts = np.arange(0, len(x), batch)
    sizes = np.diff(np.append(starts, len(x)))
    batches = [(x[a : a + batch], t[a : a + batch]) for a in starts]
    said = np.empty(t.shape)  # every batch as it was answered before its update
    history = []
    plain = optimizer.kind == "sgd" and net.activations[-1] in ("softmax", "sigmoid") and set(net.activations[:-1]) <= {"relu"}
    descent = Descent(net, x, t, batch, optimizer.rate) if plain else None
    for _ in range(epochs):
        if descent is not None:
            descent.epoch(said)
        for a, (bx, bt) in zip(starts, batches) if descent is None else ():
            outs = net.forward(bx)
            said[a : a + batch] = outs[-1]
            optimizer.update(parameters, _backward(net, outs, bt))
        per_row = _row_losses(net, said, t)
        history.append((float((np.add.reduceat(per_row, starts) / sizes).mean()), loss(net, *validation) if validation else None))
    return history


def artifact(net: Network, means: np.ndarray, deviations: np.ndarray, feature_version: str, kind: str, threshold: float | None = None) -> str:
    """A model as JSON text."""
    layers = [{"activation": a, "weights": w.tolist(), "biases": b.tolist()} for w, b, a in zip(net.weights, net.biases, net.activations)]
    return json.dumps({"feature_version": feature_version, "kind": kind, "threshold": threshold, "class_order": list(CLASSES) if kind == "three-way" else None, "network": layers, "scaler": {"means": list(map(float, means)), "standard_deviations": list(map(float, deviations))}})


def from_artifact(text: str) -> tuple[Network, np.ndarray, np.ndarray, dict]:
    """The network, its scaler and the rest; dimensions and class order are checked."""
    d = json.loads(text)
    layers = d["network"]["layers"] if isinstance(d["network"], dict) else d["network"]
    net = Network([np.array(x["weights"], float) for x in layers], [np.array(x["biases"], float) for x in layers], [str(x["activation"]).lower() for x in layers])
    means, dev = np.array(d["scaler"]["means"], float), np.array(d["scaler"]["standard_deviations"], float)
    if means.shape != dev.shape or means.shape[0] != net.weights[0].shape[1] or (dev == 0).any():
        raise ValueError("the scaler does not fit the network")
    order = d.get("class_order")
    if order is not None and [str(c).lower() for c in order] != list(CLASSES):
        raise ValueError("unknown class order")
    outputs, head = net.weights[-1].shape[0], net.activations[-1]
    if d.get("kind") == "three-way" and (outputs != len(CLASSES) or head != "softmax"):
        raise ValueError("a three-way model needs a softmax head of three outputs")
    if outputs == 1 and head == "softmax":
        raise ValueError("one output needs another head than softmax")
    width = WIDTHS.get(str(d.get("feature_version", "")).rsplit("-", 1)[-1])
    if width is not None and width != len(means):
        raise ValueError("the scaler does not fit the feature version")
    threshold = d.get("threshold")
    if threshold is not None and not 0 <= float(threshold) <= 1:
        raise ValueError("the threshold is no probability")
    if not all(np.isfinite(v).all() for v in (*net.weights, *net.biases, means, dev)):
        raise ValueError("parameters must be finite")
    return net, means, dev, d


def train_models(rows: DataFrame, job: list[str], order: str, hidden: tuple[int, ...] = (12, 6), epochs: int = 100, batch: int = 16, rate: float = 0.05, optimizer: str = "sgd", threshold: float = 0.5) -> DataFrame:
    """(job, model, train_loss, validation_loss, n_train): a model for every job, in parallel across jobs, exact in each.

    rows: job columns, ``order``, partition, features, target: arrays of 3 make three-way models with a softmax head, arrays
    of 1 binary ones with a sigmoid head and ``threshold``. The scaler is fitted on training rows; validation rows, where
    there are any, are only looked at.
    """
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in job)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_TRAINING_ROWS:
            raise ValueError("too many rows for one sequential training")
        kept = pdf[pdf["partition"] == "validation"].sort_values(order)
        pdf = pdf[pdf["partition"] == "train"].sort_values(order)
        head = {c: [pdf[c].iloc[0] if len(pdf) else None] for c in job}
        if not len(pdf):
            return pd.DataFrame({**head, "model": [None], "train_loss": [None], "validation_loss": [None], "n_train": [0]})
        x, t = np.stack(pdf["features"].to_numpy()).astype(float), np.stack(pdf["target"].to_numpy()).astype(float)
        means, dev = x.mean(0), x.std(0)
        dev[dev == 0] = 1.0
        binary = t.shape[1] == 1
        net = initial([x.shape[1], *hidden, t.shape[1]], "sigmoid" if binary else "softmax")
        seen = ((np.stack(kept["features"].to_numpy()).astype(float) - means) / dev, np.stack(kept["target"].to_numpy()).astype(float)) if len(kept) else None
        history = train(net, (x - means) / dev, t, epochs, batch, Optimizer(optimizer, rate), seen)
        text = artifact(net, means, dev, f"width-{x.shape[1]}", "binary" if binary else "three-way", threshold if binary else None)
        last = history[-1] if history else (None, None)
        return pd.DataFrame({**head, "model": [text], "train_loss": [last[0]], "validation_loss": [last[1]], "n_train": [len(x)]})

    return rows.select(*job, order, "partition", "features", "target").groupBy(*job).applyInPandas(fit, f"{kinds}, model string, train_loss double, validation_loss double, n_train long")


def score(rows: DataFrame, keep: list[str], features: str, models: list[tuple[str, str]], each: str | None = None) -> DataFrame:
    """``keep`` plus (seed, probabilities, predicted) for every row and model (name, artifact JSON); models are few.
    With ``each`` (one of ``keep``) a row is scored by the model its column names only."""
    loaded = [(name, from_artifact(text)) for name, text in models]
    held = rows.sparkSession.sparkContext.broadcast(loaded)  # the models, not the data
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column("_x").flatten(), float).reshape(b.num_rows, -1)
            if not np.isfinite(x).all():
                raise ValueError("features must be finite")
            whole, every = b, x
            for name, (net, means, dev, d) in held.value:
                if each is not None:
                    own = np.flatnonzero(np.array(whole.column(each).to_pylist(), object) == name)
                    if not len(own):
                        continue
                    b, x = whole.take(pa.array(own)), every[own]
                if x.shape[1] != len(means):
                    raise ValueError("features of another version")
                y = net.predict((x - means) / dev)
                if not np.isfinite(y).all() or (y.shape[1] == 1 and ((y < 0) | (y > 1)).any()):
                    raise ValueError("a prediction is no probability")
                if y.shape[1] == 1:
                    threshold = 0.5 if d.get("threshold") is None else float(d["threshold"])
                    label = [str(int(v >= threshold)) for v in y[:, 0]]
                else:
                    last = y.shape[1] - 1 - np.argmax(y[:, ::-1], 1)  # among equals the last class
                    label = [CLASSES[i] for i in last]
                p = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array([name] * len(y)), p, pa.array(label)], names=[*keep, "model_seed", "probabilities", "predicted"])

    return rows.select(*keep, F.col(features).alias("_x")).mapInArrow(run, f"{kinds}, model_seed string, probabilities array<double>, predicted string")


def paired(records: DataFrame, group: str) -> DataFrame:
    """(group, mutation) of challenge records that stand under two policies or more."""
    ch = records.filter((F.col("role") == "challenge") & F.col(group).isNotNull() & F.col("mutation").isNotNull())
    return ch.groupBy(group, "mutation").agg(F.countDistinct("policy_pack").alias("n")).filter("n >= 2").select(group, "mutation", F.lit(True).alias("paired"))


def selected(records: DataFrame, group: str) -> DataFrame:
    """``records`` with the protocols that select them (``own``); challenge records of a pair are in the paired one too."""
    own = records.withColumn("own", audit.held_out_by(records)).join(paired(records, group), [group, "mutation"], "left")
    return own.withColumn("own", F.when((F.col("role") == "challenge") & F.col("paired"), F.concat("own", F.array(F.lit(PAIRED)))).otherwise(F.col("own"))).drop("paired")


def protocol_rows(records: DataFrame, protocols: list[str], split: DataFrame, group: str) -> DataFrame:
    """Training and test rows of every protocol. Held-out ones train on the standard records of the training split without
    what they hold out and test on the challenge records of it; the normal one keeps the three parts of its split; the
    paired one has test rows only. records: role, policy_pack, mutation (mutation_variant, root_object_profile) and
    ``group``; split: (group, partition)."""
    unknown = [p for p in protocols if p not in (NORMAL, PAIRED) and p.partition(":")[0] not in ("held-out-policy", "held-out-mutation", "held-out-mutation-variant")]
    if unknown:
        raise ValueError(f"unknown protocols: {unknown}")
    rows = selected(records, group).join(split, group, "left")
    fitted = F.array(*[F.lit(p) for p in sorted({NORMAL if p == PAIRED else p for p in protocols})])
    kept = rows.filter("role = 'standard' and partition is not null").withColumn("protocol", F.explode(F.array_except(fitted, "own"))).filter((F.col("protocol") == NORMAL) | (F.col("partition") == "train"))
    held = rows.filter("role = 'challenge'").withColumn("protocol", F.explode(F.array_intersect(F.array(*[F.lit(p) for p in protocols]), "own"))).withColumn("partition", F.lit("test"))
    return kept.unionByName(held).drop("own")


def protocol_plan(records: DataFrame, group: str) -> list[tuple[str, str, int]]:
    """(protocol, status, challenge records) of every protocol the records allow: normal, each policy, change and variant
    held out, and paired. Not scored are policies with a rule's action that no other policy's training records have,
    changes and variants without a like in training (``structurally_unidentifiable``), and challenges without two labels
    (``traceability_only``). records as for ``experiment``, with label and features."""
    rows = selected(records, group)
    each = rows.select("role", "label", F.explode("own").alias("protocol")).groupBy("protocol").agg(
        F.sum((F.col("role") == "standard").cast("int")).alias("standard"), F.sum((F.col("role") == "challenge").cast("int")).alias("challenge"), F.countDistinct(F.when(F.col("role") == "challenge", F.col("label"))).alias("labels")
    )
    n = {r["protocol"]: r for r in each.collect()}  # bounded by policies, changes and variants
    slots = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("features", 25 + 3 * i, 3))
    whole = (F.size("features") >= 48) & F.forall(slots, lambda a: F.size(F.filter(a, lambda v: v == 1)) == 1)
    parts = rows.filter(F.col("policy_pack").isNotNull()).filter(whole).select("role", "policy_pack", F.explode(F.transform(slots, lambda a, i: i * 3 + F.array_position(a, F.lit(1.0)).cast("int"))).alias("action")).distinct().collect()
    out = [(NORMAL, "scored", 0)]
    for p in sorted(n):
        kind, _, value = p.partition(":")
        r, status = n[p], "scored"
        if kind == "held-out-policy":
            learnt = {x["action"] for x in parts if x["role"] == "standard" and x["policy_pack"] != value}
            wanted = {x["action"] for x in parts if x["role"] == "challenge" and x["policy_pack"] == value}
            if learnt and wanted - learnt:
                status = "structurally_unidentifiable"
            elif not r["challenge"]:
                status = "traceability_only"
        elif kind == "held-out-mutation":
            if value in BY_VARIANT:
                status = "structurally_unidentifiable"
            elif r["labels"] < 2:
                status = "traceability_only"
        elif kind == "held-out-mutation-variant":
            change = value.partition(":")[0]
            if change not in BY_VARIANT or not r["challenge"]:
                continue
            if n[f"held-out-mutation:{change}"]["standard"] <= r["standard"]:
                status = "structurally_unidentifiable"
            elif r["labels"] < 2:
                status = "traceability_only"
        else:
            continue
        if kind == "held-out-mutation-variant" or r["standard"]:
            out.append((p, status, r["challenge"]))
    pair = n.get(PAIRED)
    return [*out, (PAIRED, "scored" if pair and pair["labels"] >= 2 else "traceability_only", pair["challenge"] if pair else 0)]


def protocol_scores(records: DataFrame, protocols: list[str], split: DataFrame, group: str, order: str, epochs: int = 100, **how) -> DataFrame:
    """(protocol, label, predicted) of the test rows of each protocol under its own model; the paired protocol is scored by
    the normal model. Targets of 3 are three-way, of 1 binary (predicted is then 0 or 1)."""
    rows = cut(protocol_rows(records, protocols, split, group), "experiment")
    made = train_models(rows, ["protocol"], order, epochs=epochs, **how).filter("model is not null").select("protocol", "model").collect()  # a model each
    by = {m["protocol"]: m["model"] for m in made}
    if PAIRED in protocols and NORMAL in by:
        by[PAIRED] = by[NORMAL]
    if not by:
        raise ValueError("no protocol has training rows")
    tests = rows.filter(F.col("protocol").isin(list(protocols)) & (F.col("partition") == "test"))
    return score(tests, ["protocol", "label"], "features", sorted(by.items()), "protocol").select("protocol", "label", "predicted")


def experiment(records: DataFrame, protocols: list[str], split: DataFrame, group: str, order: str, epochs: int = 100, **how) -> DataFrame:
    """(protocol, n_test, accuracy) of one seed, three-way."""
    scored = protocol_scores(records, protocols, split, group, order, epochs, **how)
    return scored.groupBy("protocol").agg(F.count(F.lit(1)).alias("n_test"), F.round(F.avg((F.col("label") == F.col("predicted")).cast("int")), 6).alias("accuracy"))


def class_metrics(scored: DataFrame, by: str) -> DataFrame:
    """(by, class, precision, recall, f1, support) of three-way scores (label, predicted)."""
    cells = scored.select(by, F.explode(F.array(*[F.struct(F.lit(c).alias("class"), (F.col("predicted") == c).cast("int").alias("p"), (F.col("label") == c).cast("int").alias("t")) for c in CLASSES])).alias("x")).select(by, "x.*")
    told = metrics.classification(metrics.confusion(cells, F.col("p"), F.col("t"), by, "class"))
    return told.select(by, "class", "precision", "recall", "f1", (F.col("tp") + F.col("fn")).alias("support"))


def binary_protocols(records: DataFrame, protocols: list[str], split: DataFrame, group: str, order: str, epochs: int = 100, **how) -> DataFrame:
    """(protocol, tp, fp, tn, fn, accuracy, precision, recall, f1) of one seed, breaking against the rest."""
    rows = records.withColumn("target", F.array((F.col("label") == "breaking").cast("double")))
    scored = protocol_scores(rows, protocols, split, group, order, epochs, **how)
    return metrics.classification(metrics.confusion(scored, F.col("predicted").cast("int"), (F.col("label") == "breaking").cast("int"), "protocol"))


def pipeline(records: DataFrame, split: DataFrame, group: str, order: str, thresholds: tuple[float, ...] = (), **how) -> dict[str, DataFrame]:
    """One training run over whole groups: ``model`` (a row), ``scored`` rows of validation and test, ``metrics`` by
    partition, and for binary models the ``thresholds`` over the validation rows and the ``baselines`` on the test rows.

    records: role, label, features, target (array of 3 or 1), ``group``, ``order``; only standard records with a place in
    ``split`` (group, partition) take part.
    """
    rows = cut(records.filter("role = 'standard'").join(split, group).withColumn("job", F.lit("run")), "pipeline")
    made = cut(train_models(rows, ["job"], order, **how), "model")
    got = made.filter("model is not null").select("model").first()
    if got is None:
        raise ValueError("no training rows")
    kept = rows.filter("partition <> 'train'")
    scored = cut(score(kept, ["partition", "label", order], "features", [("run", got["model"])]), "scored")
    if json.loads(got["model"])["kind"] != "binary":
        hits = scored.groupBy("partition").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("predicted")).cast("int")).alias("accuracy"))
        return {"model": made, "scored": scored, "metrics": hits, "confusion": metrics.confusion_cells(scored.filter("partition = 'test'"), "label", "predicted")}
    told = scored.withColumns({"p": F.col("predicted").cast("int"), "t": (F.col("label") == "breaking").cast("int"), "score": F.get("probabilities", F.lit(0))})
    common = rows.filter("partition = 'train'").agg((2 * F.sum((F.col("label") == "breaking").cast("int")) > F.count(F.lit(1))).cast("int").alias("majority")).first()["majority"] or 0
    test = told.filter("partition = 'test'")
    return {
        "model": made, "scored": told, "metrics": metrics.classification(metrics.confusion(told, F.col("p"), F.col("t"), "partition")),
        "thresholds": metrics.threshold_sweep(told.filter("partition = 'validation'"), F.col("score"), F.col("t"), list(thresholds)),
        "baselines": metrics.baseline_comparison(test, F.col("t"), {"model": F.col("p"), "majority": F.lit(common)}),
    }


def binary_experiment(records: DataFrame, splits: DataFrame, group: str, order: str, **how) -> DataFrame:
    """(seed, part, tp, fp, tn, fn, accuracy, precision, recall, f1): a binary model for each seed on the standard records
    of its own split (splits: seed, group, partition), judged on its test rows and on all challenge records.

    All seeds train side by side and are scored in one pass. records as for ``pipeline``, target an array of 1.
    """
    seeds = splits.select("seed").distinct()
    placed = records.filter("role = 'standard'").join(splits, group).select(*records.columns, "seed", "partition")
    challenge = records.filter("role = 'challenge'").join(F.broadcast(seeds)).withColumn("partition", F.lit("challenge")).select(*records.columns, "seed", "partition")
    rows = cut(placed.unionByName(challenge).withColumn("seed", F.col("seed").cast("string")), "binary")
    made = train_models(rows, ["seed"], order, **how).filter("model is not null").select("seed", "model").collect()  # a model each
    if not made:
        raise ValueError("no training rows")
    scored = score(rows.filter("partition in ('test', 'challenge')"), ["seed", "partition", "label"], "features", sorted((m["seed"], m["model"]) for m in made), "seed")
    told = metrics.confusion(scored, F.col("predicted").cast("int"), (F.col("label") == "breaking").cast("int"), "seed", "partition")
    return metrics.classification(told).withColumnRenamed("partition", "part")
