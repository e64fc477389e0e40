"""Configuration and paths, on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path

from corpusloom.operators.evaluation import K_VALUES, TARGET_K, TARGET_RECALL


@dataclass
class Config:
    chunk_mode: str = "paragraph"
    chunk_fields: tuple[str, ...] = ("text", "gloss")
    enrich_fields: tuple[str, ...] = ()
    enrich_separator: str = " "
    window_size: int = 200
    window_overlap: int = 50
    retriever: str = "vector"
    evaluator: str = "retrieval"
    retrieve_k: int = 100
    k_values: tuple[int, ...] = K_VALUES
    target_k: int = TARGET_K
    target_recall: float = TARGET_RECALL
    max_questions: int | None = None
    score_threshold: float | None = None
    paths: dict = field(default_factory=dict)

    @classmethod
    def of(cls, values: dict) -> Config:
        known = {f.name for f in fields(cls)}
        if unknown := set(values) - known:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def load(path: str) -> Config:
    """A YAML file, if PyYAML is there; JSON otherwise."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml
    except ImportError:
        import json

        return Config.of(json.loads(text))
    return Config.of(yaml.safe_load(text) or {})


def resolve_paths(config: Config, mode: str) -> dict[str, str]:
    """The paths of a mode: nested under its name, or flat for all modes."""
    if mode in config.paths and isinstance(config.paths[mode], dict):
        return dict(config.paths[mode])
    if config.paths and all(isinstance(v, str) for v in config.paths.values()):
        return dict(config.paths)
    raise ValueError(f"unknown mode {mode!r}; there are {sorted(config.paths)}")


def resolve_path(name: str, base: str, output: bool = False) -> Path:
    """Absolute as it is; an existing one (or, for output, one with a folder) from here; a bare name from base."""
    path = Path(name)
    here = path.parent != Path(".") if output else path.exists()
    return path if path.is_absolute() or here else Path(base) / path


def limit_of(command_line, configured) -> int | None:
    """How many questions: the command line before the file; nothing, all, none and numbers below 1 mean no limit."""
    for value in (command_line, configured):
        if value is None:
            continue
        try:
            n = int(str(value).strip())
        except ValueError:
            return None
        return n if n > 0 else None
    return None
