"""Closed configuration: unknown and missing fields are errors, and so are values without a meaning."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import get_type_hints

from tessera.operators.sampling import Sampling


class ConfigError(ValueError):
    pass


def build(kind, values: dict):
    """A dataclass from a mapping, nested ones included; types are checked."""
    if not isinstance(values, dict):
        raise ConfigError(f"{kind.__name__} needs a mapping")
    hints, known = get_type_hints(kind), {f.name for f in dataclasses.fields(kind)}
    if extra := set(values) - known:
        raise ConfigError(f"{kind.__name__} has no fields {sorted(extra)}")
    made = {}
    for name, value in values.items():
        hint = hints[name]
        made[name] = build(hint, value) if dataclasses.is_dataclass(hint) else tuple(value) if isinstance(value, list) else value
    try:
        return kind(**made)
    except (TypeError, ValueError) as e:
        raise ConfigError(str(e)) from None


@dataclass(frozen=True)
class DatasetConfig:
    name: str
    split: str
    path: str
    where: dict = field(default_factory=dict)
    filter_id: str = "all"
    template: str = "reasoning_boxed_v1"


@dataclass(frozen=True)
class SchedulerConfig:
    batch_size: int = 8
    strategy: str = "contiguous"
    window_size: int | None = None

    def __post_init__(self):
        if self.batch_size <= 0:
            raise ConfigError("the batch size must be positive")
        if self.strategy not in ("contiguous", "token_count_bucketed"):
            raise ConfigError(f"unknown strategy {self.strategy!r}")
        if self.strategy == "token_count_bucketed" and (self.window_size is None or self.window_size < self.batch_size):
            raise ConfigError("the window must hold at least one batch")


@dataclass(frozen=True)
class HardwareConfig:
    max_rows: int


@dataclass(frozen=True)
class GroupConfig:
    """An experiment: datasets x strategies, rollouts of each example, and how work is cut."""

    id: str
    datasets: tuple
    strategies: dict
    rollouts: int
    base_seed: int
    microbatch: int
    scheduler: SchedulerConfig
    hardware: HardwareConfig

    def __post_init__(self):
        object.__setattr__(self, "datasets", tuple(d if isinstance(d, DatasetConfig) else build(DatasetConfig, d) for d in self.datasets))
        object.__setattr__(self, "strategies", {k: s if isinstance(s, Sampling) else build(Sampling, s) for k, s in self.strategies.items()})
        if not self.datasets or not self.strategies:
            raise ConfigError("a group needs datasets and strategies")
        if len({(d.name, d.split, d.filter_id) for d in self.datasets}) != len(self.datasets):
            raise ConfigError("datasets must differ")
        if not 0 < self.microbatch <= self.rollouts:
            raise ConfigError("the microbatch must be positive and at most the number of rollouts")
        if self.scheduler.batch_size * self.microbatch > self.hardware.max_rows:
            raise ConfigError("a batch has more rows than the hardware takes")
        if not 0 <= self.base_seed < 1 << 64:
            raise ConfigError("the base seed must be an unsigned 64-bit number")

    @property
    def hash(self) -> str:
        """SHA-256 of the configuration's canonical JSON."""
        text = json.dumps(dataclasses.asdict(self), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        return hashlib.sha256(text.encode()).hexdigest()


def load(path: str) -> GroupConfig:
    """A group from a YAML or JSON file; a value ``{include: name}`` is the mapping in that file beside it, whose ``name`` must agree."""
    return build(GroupConfig, _read(Path(path)))


def _read(path: Path) -> dict:
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        values = json.loads(text)
    else:
        import yaml

        values = yaml.safe_load(text)
    return _included(values, path.parent)


def _included(value, base: Path):
    if isinstance(value, dict):
        if set(value) == {"include"}:
            found = _read(base / value["include"])
            stem = Path(value["include"]).stem
            if found.get("name", stem) != stem:
                raise ConfigError(f"{value['include']} is named {found['name']!r}")
            return found
        return {k: _included(v, base) for k, v in value.items()}
    return [_included(v, base) for v in value] if isinstance(value, list) else value
