"""Model profiles as JSON (O-SRC-11, O-SNK-4/5, D-14)."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from ..operators.decide import Gate


def feature_hash(order: list[str]) -> str:
    return hashlib.sha256("|".join(order).encode()).hexdigest()


@dataclass
class Profile:
    model_type: str
    feature_order: list[str]
    normalization: dict = field(default_factory=lambda: {"center": {}, "scale": {}, "floor": {}})
    model: dict = field(default_factory=dict)
    decision: dict = field(default_factory=dict)
    feature_config: dict = field(default_factory=lambda: {"window_ms": 120, "hop_ms": 30})
    metadata: dict = field(default_factory=dict)
    feature_hash: str = ""
    detector_mode: str = "binary"
    schema_version: int = 1

    def gate(self) -> Gate:
        """The defaults overlaid by the profile's decision; an unknown key is an error (O-DEC-8)."""
        names = {"enter_threshold": "enter", "exit_threshold": "exit", "enter_dwell_frames": "enter_dwell", "release_dwell_frames": "release_dwell"}
        if self.detector_mode != "binary":
            raise ValueError("detector_mode must be 'binary'")
        return Gate(**{names.get(k, k): v for k, v in self.decision.items()})


def load(path: str) -> Profile:
    """A profile from its file; keys that profiles do not have are nothing to it. A wrong hash is an error."""
    data = json.loads(Path(path).read_text())
    known = {f.name for f in fields(Profile)}
    profile = Profile(**{k: v for k, v in data.items() if k in known})
    expected = feature_hash(profile.feature_order)
    if profile.feature_hash and profile.feature_hash != expected:
        raise ValueError("feature_hash does not fit feature_order")
    profile.feature_hash = expected
    return profile


def save(profile: Profile, path: str, metrics: dict | None = None, metrics_path: str | None = None) -> None:
    """The profile, and with ``metrics`` a second file that names it and holds them (O-SNK-4/5)."""
    profile.feature_hash = feature_hash(profile.feature_order)
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(asdict(profile), indent=2))
    if metrics is not None:
        beside = Path(metrics_path) if metrics_path else target.with_suffix(".metrics.json")
        beside.parent.mkdir(parents=True, exist_ok=True)
        beside.write_text(json.dumps({"profile": str(path), "metrics": metrics}, indent=2))
