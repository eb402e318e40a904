"""Forecasts of topic counts: last value, drift, and a small recurrent network.

The network sees each topic's window on its own (an encoder of two layers, a GRU, a head), as
one shared model. Its data are topics times years, a few thousand numbers, so training runs on the
driver in NumPy; prediction is a pandas function over the samples.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ForecastConfig


def _counts(samples: DataFrame):
    """The counts of the window's years, undone from the features: log1p(prev) + growth = log1p(count)."""
    return F.transform("features", lambda x: F.expm1(x["f1"] + x["f2"]))


def naive(samples: DataFrame) -> DataFrame:
    """target_year, topic, prediction (the last count), ground_truth."""
    return samples.select("target_year", "topic", F.element_at(_counts(samples), -1).alias("prediction"), F.col("truth").cast("double").alias("ground_truth"))


def drift(samples: DataFrame) -> DataFrame:
    """The last count carried on by the mean step of the window, 0 at least."""
    c = _counts(samples)
    n = F.size("features")
    step = F.when(n > 1, (F.element_at(c, -1) - F.element_at(c, 1)) / (n - 1)).otherwise(0.0)
    return samples.select("target_year", "topic", F.greatest(F.element_at(c, -1) + step, F.lit(0.0)).alias("prediction"), F.col("truth").cast("double").alias("ground_truth"))


# ---- the network


def _relu(x):
    return np.maximum(x, 0)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def init_params(p: ForecastConfig, n_in: int = 3) -> dict[str, np.ndarray]:
    rng, h = np.random.default_rng(p.seed), p.hidden_dim
    shapes = {"w1": (n_in, h), "w2": (h, h), "wx": (h, 3 * h), "wh": (h, 3 * h), "w3": (h, h), "w4": (h, 1)}
    out = {k: rng.uniform(-1, 1, s) / np.sqrt(s[0]) for k, s in shapes.items()}
    return out | {"b1": np.zeros(h), "b2": np.zeros(h), "bx": np.zeros(3 * h), "bh": np.zeros(3 * h), "b3": np.zeros(h), "b4": np.zeros(1)}


def forward(w: dict[str, np.ndarray], x: np.ndarray, mixer: np.ndarray | None = None, drop: tuple[np.ndarray, np.ndarray] | None = None):
    """x [topics, years, features] to outputs [topics] and what the backward pass needs. mixer: the topics'
    normalised incidence products [years, topics, topics], or None for the identity."""
    mix = (lambda a: a) if mixer is None else (lambda a: np.einsum("tij,jtk->itk", mixer, a))
    a1 = mix(x @ w["w1"] + w["b1"])
    h1 = _relu(a1)
    d1 = h1 if drop is None else h1 * drop[0]
    a2 = mix(d1 @ w["w2"] + w["b2"])
    e = _relu(a2)
    n, years, h = e.shape
    s, steps = np.zeros((n, h)), []
    for t in range(years):
        gx, gh = e[:, t] @ w["wx"] + w["bx"], s @ w["wh"] + w["bh"]
        r, z = _sigmoid(gx[:, :h] + gh[:, :h]), _sigmoid(gx[:, h : 2 * h] + gh[:, h : 2 * h])
        c = np.tanh(gx[:, 2 * h :] + r * gh[:, 2 * h :])
        new = (1 - z) * c + z * s
        steps.append((s, r, z, c, gh[:, 2 * h :]))
        s = new
    a3 = s @ w["w3"] + w["b3"]
    h3 = _relu(a3)
    d3 = h3 if drop is None else h3 * drop[1]
    return (d3 @ w["w4"] + w["b4"])[:, 0], (x, a1, d1, a2, e, steps, s, a3, d3, mix, drop)


def backward(w: dict[str, np.ndarray], cache, dy: np.ndarray) -> dict[str, np.ndarray]:
    x, a1, d1, a2, e, steps, s, a3, d3, mix, drop = cache
    h = s.shape[1]
    g = {"w4": d3.T @ dy[:, None], "b4": dy.sum(keepdims=True)}
    da3 = (dy[:, None] * w["w4"][:, 0]) * (1 if drop is None else drop[1]) * (a3 > 0)
    g |= {"w3": s.T @ da3, "b3": da3.sum(0)}
    ds, de = da3 @ w["w3"].T, np.zeros_like(e)
    g |= {k: np.zeros_like(w[k]) for k in ("wx", "wh", "bx", "bh")}
    for t in range(len(steps) - 1, -1, -1):
        s0, r, z, c, ghc = steps[t]
        dc = ds * (1 - z) * (1 - c * c)
        dz = ds * (s0 - c) * z * (1 - z)
        dr = dc * ghc * r * (1 - r)
        dgx = np.concatenate([dr, dz, dc], axis=1)
        dgh = np.concatenate([dr, dz, dc * r], axis=1)
        g["wx"] += e[:, t].T @ dgx
        g["bx"] += dgx.sum(0)
        g["wh"] += s0.T @ dgh
        g["bh"] += dgh.sum(0)
        de[:, t] = dgx @ w["wx"].T
        ds = ds * z + dgh @ w["wh"].T
    da2 = mix(de * (a2 > 0))  # the mixer is symmetric
    g |= {"w2": np.einsum("ntk,ntl->kl", d1, da2), "b2": da2.sum((0, 1))}
    da1 = mix((da2 @ w["w2"].T) * (1 if drop is None else drop[0]) * (a1 > 0))
    return g | {"w1": np.einsum("ntk,ntl->kl", x, da1), "b1": da1.sum((0, 1))}


def loss(out: np.ndarray, y: np.ndarray, mode: str) -> tuple[float, np.ndarray]:
    """The mean loss and its derivative: squares of log counts, or logits against 0 and 1."""
    if mode == "count":
        return float(np.mean((out - y) ** 2)), 2 * (out - y) / len(y)
    q = _sigmoid(out)
    return float(np.mean(np.logaddexp(0, out) - y * out)), (q - y) / len(y)


@dataclass
class Model:
    weights: dict[str, np.ndarray]
    config: ForecastConfig
    topics: list[str]
    history: list[tuple[float, float]]

    def to_json(self) -> str:
        return json.dumps({"weights": {k: v.tolist() for k, v in self.weights.items()}, "config": asdict(self.config), "topics": self.topics, "history": self.history})

    @staticmethod
    def from_json(text: str) -> Model:
        d = json.loads(text)
        return Model({k: np.array(v) for k, v in d["weights"].items()}, ForecastConfig(**d["config"]), d["topics"], [tuple(x) for x in d["history"]])


def _arrays(rows) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(year, x, y) by target year, topics in order."""
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["target_year"], []).append(r)
    out = []
    for year in sorted(by):
        group = sorted(by[year], key=lambda r: r["topic"])
        out.append((year, np.array([[(f["f1"], f["f2"], f["f3"]) for f in r["features"]] for r in group]), np.array([r["y"] for r in group], dtype=float)))
    return out


def mixer_of(projection: dict[int, dict[tuple[str, str], float]], years: list[int], topics: list[str]) -> np.ndarray:
    """The topics' incidence products of some years; a topic without papers in a year passes through."""
    at = {t: i for i, t in enumerate(topics)}
    out = np.zeros((len(years), len(topics), len(topics)))
    for k, year in enumerate(years):
        for (a, b), v in projection.get(year, {}).items():
            if a in at and b in at:
                out[k, at[a], at[b]] = v
        lone = out[k].sum(axis=1) == 0
        out[k][lone, lone] = 1.0
    return out


def gather_projection(projection: DataFrame) -> dict[int, dict[tuple[str, str], float]]:
    """By year; topics squared times years numbers."""
    out: dict[int, dict[tuple[str, str], float]] = {}
    for r in projection.collect():
        out.setdefault(r["year"], {})[r["topic"], r["other"]] = r["a"]
    return out


def train(samples: DataFrame, p: ForecastConfig, projection: dict | None = None) -> Model:
    """Adam, one step for each window, best validation weights kept. samples: topics times years rows,
    which the driver gathers; the split is by time. projection: needed where structure is incidence."""
    rows = samples.filter((F.col("target_year") < p.predict_year) & F.col("y").isNotNull()).collect()  # topics times years
    windows = _arrays(rows)
    if len(windows) < 2:
        raise ValueError("two windows or more are needed before predict_year")
    if p.structure == "incidence" and projection is None:
        raise ValueError("structure incidence needs the topics' projection")
    topics = {y: sorted(r["topic"] for r in rows if r["target_year"] == y) for y, _, _ in windows}
    mixers = {y: mixer_of(projection, list(range(y - p.window_size, y)), topics[y]) if p.structure == "incidence" else None for y in topics}
    known, (last, vx, vy) = windows[:-1], windows[-1]
    w, rng = init_params(p), np.random.default_rng(p.seed + 1)
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    best, best_w, history, step = np.inf, {k: a.copy() for k, a in w.items()}, [], 0
    for _ in range(p.epochs):
        total = 0.0
        for year, x, y in known:
            keep = 1 - p.dropout
            drop = tuple((rng.random(s) < keep) / keep for s in ((*x.shape[:2], p.hidden_dim), (len(x), p.hidden_dim))) if p.dropout else None
            out, cache = forward(w, x, mixers[year], drop)
            value, dy = loss(out, y, p.target_mode)
            grads, step, total = backward(w, cache, dy), step + 1, total + value
            for k, g in grads.items():
                g = g + p.weight_decay * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - p.lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        value = loss(forward(w, vx, mixers[last])[0], vy, p.target_mode)[0]
        history.append((total / len(known), value))
        if value < best:
            best, best_w = value, {k: a.copy() for k, a in w.items()}
    return Model(best_w, p, sorted({r["topic"] for r in rows}), history)


def predict(model: Model, samples: DataFrame, projection: dict | None = None) -> DataFrame:
    """target_year, topic, prediction (a count, or a probability), ground_truth (null for a future year)."""
    w, mode, p = model.weights, model.config.target_mode, model.config

    def outputs(f: pd.DataFrame, mixer: np.ndarray | None) -> pd.DataFrame:
        x = np.array([[(s["f1"], s["f2"], s["f3"]) for s in row] for row in f["features"]], dtype=float)
        out = forward(w, x, mixer)[0]
        return pd.DataFrame({"target_year": f["target_year"], "topic": f["topic"], "prediction": np.expm1(out) if mode == "count" else _sigmoid(out), "ground_truth": f["truth"].astype("float64")})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield outputs(f, None)

    def by_year(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("topic")
        year = int(f["target_year"].iloc[0])
        return outputs(f, mixer_of(projection, list(range(year - p.window_size, year)), list(f["topic"])))

    rows = samples.select("target_year", "topic", "features", F.col("truth").cast("double").alias("truth"))
    schema = "target_year int, topic string, prediction double, ground_truth double"
    if p.structure == "incidence":
        if projection is None:
            raise ValueError("structure incidence needs the topics' projection")
        return rows.groupBy("target_year").applyInPandas(by_year, schema)  # topics rows a group
    return rows.mapInPandas(run, schema)
