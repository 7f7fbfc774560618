"""Experiment files (YAML) and the settings file of a project. Driver only."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path

import yaml


@dataclass
class Run:
    name: str = "rankforge_run"
    output_dir: str = "results"


@dataclass
class Dataset:
    documents_path: str
    questions_path: str
    qrels_path: str | None = None


@dataclass
class SystemSpec:
    type: str
    name: str | None = None
    chunker: dict = field(default_factory=dict)
    retrieval: dict = field(default_factory=dict)
    models: dict = field(default_factory=dict)
    llm_features: dict = field(default_factory=dict)
    extra: dict = field(default_factory=dict)

    @property
    def resolved_name(self) -> str:
        return self.name or self.type


@dataclass
class Evaluation:
    k_values: list[int] = field(default_factory=lambda: [1, 3, 5, 10])
    judge_enabled: bool = True
    judge_model: str = "gpt-5.4-nano"
    max_questions: int | None = None
    max_workers: int = 4


@dataclass
class Experiment:
    run: Run
    dataset: Dataset
    systems: list[SystemSpec]
    evaluation: Evaluation = field(default_factory=Evaluation)


def _part(kind: type, given: object, where: str):
    if not isinstance(given, dict):
        raise ValueError(f"{where}: expected a mapping")
    known = {k: v for k, v in given.items() if k in kind.__dataclass_fields__ and k != "extra"}
    rest = {k: v for k, v in given.items() if k not in known}
    if kind is SystemSpec:
        known = {k: v for k, v in known.items() if v is not None} | {"extra": rest}
    try:
        return kind(**known)
    except TypeError as wrong:
        raise ValueError(f"{where}: {wrong}") from None


def load_experiment_dict(path: str | Path) -> dict:
    """The file as it stands; an empty one is an empty mapping."""
    if not Path(path).is_file():
        raise FileNotFoundError(path)
    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def load_experiment(path: str | Path) -> Experiment:
    """Missing settings are filled; a missing section, or two systems of one name, raise ValueError."""
    raw = load_experiment_dict(path)
    for section in ("run", "dataset", "systems"):
        if section not in raw:
            raise ValueError(f"{path}: no section {section}")
    if not isinstance(raw["systems"], list):
        raise ValueError("systems: expected a list")
    systems = [_part(SystemSpec, s, f"systems[{n}]") for n, s in enumerate(raw["systems"])]
    names = [s.resolved_name for s in systems]
    if len(set(names)) < len(names):
        raise ValueError(f"two systems of one name: {', '.join(sorted(n for n in set(names) if names.count(n) > 1))}")
    return Experiment(_part(Run, raw["run"] or {}, "run"), _part(Dataset, raw["dataset"], "dataset"), systems, _part(Evaluation, raw.get("evaluation") or {}, "evaluation"))


def find_settings(start: str | Path = ".") -> Path | None:
    """The nearest ``.env`` in the folder or above it."""
    at = Path(start).resolve()
    for folder in ([] if at.is_file() else [at]) + list(at.parents):
        if (folder / ".env").is_file():
            return folder / ".env"
    return None


def load_settings(start: str | Path = ".") -> dict[str, str]:
    """``NAME=value`` lines of :func:`find_settings` (comments, ``export`` and quotes go) put into the environment, where they replace
    nothing; returns those that were put."""
    found, new = find_settings(start), {}
    for line in found.read_text(encoding="utf-8").splitlines() if found else []:
        name, sign, value = line.strip().removeprefix("export ").partition("=")
        name = name.strip()
        if sign and name and not name.startswith("#") and name not in os.environ:
            new[name] = os.environ[name] = value.strip().strip("\"'")
    return new
