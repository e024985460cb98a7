"""Probabilities of frames under a profile, in batch and one frame at a time (O-PRJ-10/11, O-FRM-11, O-ML-11, O-UDF-1)."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import models
from ..functions.columns import logreg_score, normalise, threshold_score
from ..sources.profiles import Profile
from .frames import sequences


def _normalised(profile: Profile) -> list[Column]:
    parts = [profile.normalization.get(k, {}) for k in ("center", "scale", "floor")]
    number = lambda x: F.lit(None if x is None else float(x)).cast("double")
    return [normalise(F.col(f).cast("double"), *[number(p.get(f)) for p in parts]) for f in profile.feature_order]


def score_frames(frames: DataFrame, profile: Profile) -> DataFrame:
    """``frames`` with ``p``. Threshold and logistic models are column expressions. Sequence models see the last frames
    of a session, over clock resets too; until there are enough of them ``p`` is zero."""
    m = profile.model
    if profile.model_type == "threshold":
        value = F.col(m.get("feature", "waveform_length")).cast("double")
        return frames.withColumn("p", threshold_score(value, float(m.get("threshold", 0.0)), float(m.get("softness", 1.0))))
    vector = _normalised(profile)
    if profile.model_type == "logreg":
        return frames.withColumn("p", logreg_score(vector, m.get("weights", []), float(m.get("bias", 0.0))))
    names = [f"__x{i}" for i in range(len(vector))]
    given = sequences(frames.withColumns(dict(zip(names, vector))), names, models.sequence_length(m))

    @F.pandas_udf("double")
    def forward(steps: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = models.build(profile.model_type, m)
        for s in steps:
            out, full = np.zeros(len(s)), s.notna().to_numpy()
            if full.any():
                out[full] = score(np.array([np.stack(x) for x in s[full]]))
            yield pd.Series(out)

    return given.withColumn("p", forward("steps")).drop("steps", *names)


class FrameModel:
    """A profile's model for one frame at a time: ``model(frame, memory)``, where ``memory`` is the list of the vectors
    that a session has seen last and is kept with its state."""

    def __init__(self, profile: Profile) -> None:
        self.profile, self.score = profile, None
        self.length = models.sequence_length(profile.model) if profile.model_type in models.SEQUENCE else 1

    def __getstate__(self) -> dict:
        return {**self.__dict__, "score": None}

    def __call__(self, frame: dict, memory: list) -> float:
        p = self.profile
        if p.model_type == "threshold":
            m = p.model
            x = (frame[m.get("feature", "waveform_length")] - float(m.get("threshold", 0.0))) / max(float(m.get("softness", 1.0)), 1e-6)
            return 1.0 / (1.0 + exp(-x)) if x >= 0 else exp(x) / (1.0 + exp(x))
        self.score = self.score or models.build(p.model_type, p.model)
        center, scale, floor = (p.normalization.get(k, {}) for k in ("center", "scale", "floor"))
        vector = [(frame[f] - center.get(f, 0.0)) / max(scale.get(f, 1.0), floor.get(f, 1.0)) for f in p.feature_order]
        memory.append(vector)
        del memory[: -self.length]
        if len(memory) < self.length:
            return 0.0
        x = np.array([memory] if p.model_type in models.SEQUENCE else [vector])
        return float(self.score(x)[0])
