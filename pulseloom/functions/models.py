"""Scorers of trained profiles: a registry of model types, each with a forward pass in NumPy (O-ML-8..11, O-UDF-*).

A scorer is built from a profile's ``model``; ``plain`` ones take ``(n, features)`` normalised vectors, sequence ones
``(n, length, features)``. Weights are lists by the names that the training library gives them. Training sequence
models needs that library, which is an optional dependency (``require_torch``); scoring does not.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Scorer = Callable[[np.ndarray], np.ndarray]
_REGISTRY: dict[str, Callable[[dict], Scorer]] = {}
SEQUENCE = ("cnn", "tcn", "transformer")


def scorer(name: str) -> Callable:
    """Registers ``build(model) -> scorer`` for a model type; users may add their own."""

    def put(build: Callable[[dict], Scorer]) -> Callable[[dict], Scorer]:
        _REGISTRY[name] = build
        return build

    return put


def build(model_type: str, model: dict) -> Scorer:
    if model_type not in _REGISTRY:
        raise ValueError(f"unknown model type {model_type!r}")
    return _REGISTRY[model_type](model)


def require_torch():
    """The training library, or an error that says what is missing."""
    try:
        import torch
    except ImportError as e:
        raise RuntimeError("training sequence models needs torch, which is not installed") from e
    return torch


def sigmoid(x: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1 / (1 + e), e / (1 + e))


def sequence_length(model: dict) -> int:
    return int(model.get("config", {}).get("seq_len", model.get("seq_len", 16)))


@scorer("logreg")
def logreg(model: dict) -> Scorer:
    weights, bias = np.array(model.get("weights", []), float), float(model.get("bias", 0.0))

    def score(x: np.ndarray) -> np.ndarray:
        n = min(x.shape[1], len(weights))
        return sigmoid(x[:, :n] @ weights[:n] + bias)

    return score


def _state(model: dict) -> dict[str, np.ndarray]:
    return {k: np.array(v, np.float32) for k, v in model.get("state_dict", {}).items()}


def _conv(x: np.ndarray, s: dict, name: str, pad: int, step: int = 1) -> np.ndarray:
    """One-dimensional convolution over ``(n, channels, time)``; time keeps its length where ``pad`` allows it."""
    w, b = s[f"{name}.weight"], s[f"{name}.bias"]
    wide = np.pad(x, ((0, 0), (0, 0), (pad, pad)))
    n = wide.shape[2] - step * (w.shape[2] - 1)
    out = sum(np.einsum("oc,nct->not", w[:, :, k], wide[:, :, k * step : k * step + n]) for k in range(w.shape[2]))
    return out + b[:, None]


def _linear(x: np.ndarray, s: dict, name: str) -> np.ndarray:
    return x @ s[f"{name}.weight"].T + s[f"{name}.bias"]


def _relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


@scorer("cnn")
def cnn(model: dict) -> Scorer:
    """Two convolutions, mean over time, one output."""
    s = _state(model)

    def score(x: np.ndarray) -> np.ndarray:
        h = _relu(_conv(_relu(_conv(x.astype(np.float32).transpose(0, 2, 1), s, "1", 2)), s, "3", 1))
        return sigmoid(_linear(h.mean(2), s, "7")[:, 0])

    return score


@scorer("tcn")
def tcn(model: dict) -> Scorer:
    """A projection, two dilated convolutions centred on their place (padding equals dilation), mean over time."""
    s = _state(model)

    def score(x: np.ndarray) -> np.ndarray:
        h = _relu(_conv(x.astype(np.float32).transpose(0, 2, 1), s, "in_proj", 0))
        for name, step in (("conv1", 2), ("conv2", 4)):
            h = _relu(_conv(h, s, name, step, step))
        return sigmoid(_linear(h.mean(2), s, "out")[:, 0])

    return score


def _norm(x: np.ndarray, s: dict, name: str) -> np.ndarray:
    centred = x - x.mean(-1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(-1, keepdims=True) + 1e-5) * s[f"{name}.weight"] + s[f"{name}.bias"]


@scorer("transformer")
def transformer(model: dict) -> Scorer:
    """Projection with learned places, encoder layers (attention and a feed-forward part, each added and normalised),
    mean over time."""
    s, config = _state(model), model.get("config", {})
    heads, layers = max(1, int(config.get("heads", 2))), max(1, int(config.get("layers", 1)))

    def score(x: np.ndarray) -> np.ndarray:
        h = _linear(x.astype(np.float32), s, "proj")
        h = h + s["pos"][:, : h.shape[1]]
        n, t, width = h.shape
        split = lambda z: z.reshape(n, t, heads, width // heads).transpose(0, 2, 1, 3)
        for i in range(layers):
            at = f"encoder.layers.{i}."
            q, k, v = map(split, np.split(h @ s[at + "self_attn.in_proj_weight"].T + s[at + "self_attn.in_proj_bias"], 3, axis=2))
            near = q @ k.transpose(0, 1, 3, 2) / np.sqrt(width // heads)
            near = np.exp(near - near.max(-1, keepdims=True))
            met = (near / near.sum(-1, keepdims=True) @ v).transpose(0, 2, 1, 3).reshape(n, t, width)
            h = _norm(h + _linear(met, s, at + "self_attn.out_proj"), s, at + "norm1")
            h = _norm(h + _linear(_relu(_linear(h, s, at + "linear1")), s, at + "linear2"), s, at + "norm2")
        return sigmoid(_linear(h.mean(1), s, "out")[:, 0])

    return score
