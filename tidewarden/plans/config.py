"""Settings of a run, from a mapping such as a parsed YAML file."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from pyspark.sql import types as T

from tidewarden.operators.relevance import Rules


@dataclass(frozen=True)
class SourceSettings:
    timeout_seconds: float = 20.0
    delay_seconds: float = 0.2
    limit: int = 300


@dataclass(frozen=True)
class Settings:
    data_dir: str = "data"
    workers: int = 20
    sources: dict[str, SourceSettings] = field(default_factory=dict)
    rules: Rules = field(default_factory=Rules)


def positive(name: str, value: object) -> int:
    """A whole number above 0, or an error that names the setting."""
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise ValueError(f"{name} must be a whole number above 0, not {value!r}")
    return value


def settings(raw: Mapping) -> Settings:
    """Settings of a mapping; what it lacks keeps its default, unknown names raise."""
    unknown = set(raw) - {f.name for f in fields(Settings)}
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    sources = {}
    for name, s in (raw.get("sources") or {}).items():
        limit = s.get("limit", 300)
        sources[name] = SourceSettings(
            float(s.get("timeout_seconds", 20.0)),
            float(s.get("delay_seconds", 0.2)),
            limit if limit == 0 else positive(f"sources.{name}.limit", limit),
        )
    rules = Rules(**(raw.get("rules") or {}))
    positive("rules.radius", rules.radius)
    positive("rules.max_snippets", rules.max_snippets)
    return Settings(
        raw.get("data_dir", "data"), positive("workers", raw.get("workers", 20)), sources, rules
    )


#: Types of prompt fields, longest name first; fixed values.
PROMPT_TYPES: tuple[tuple[str, T.DataType], ...] = (
    ("list of strings", T.ArrayType(T.StringType())),
    ("list of objects", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    ("boolean", T.BooleanType()),
    ("integer", T.IntegerType()),
    ("string", T.StringType()),
    ("number", T.DoubleType()),
    ("float", T.DoubleType()),
    ("list", T.ArrayType(T.StringType())),
    ("bool", T.BooleanType()),
    ("int", T.IntegerType()),
    ("str", T.StringType()),
)


def prompt_schema(prompt: str) -> T.StructType:
    """Fields of a prompt's ``# Output schema`` section: lines ``- name (type): text``.

    The section ends at the next heading or at the end of the prompt.
    """
    import re

    found = re.search(r"(?ms)^# Output schema\s*\n(.*?)(?=^# |\Z)", prompt)
    if not found:
        raise ValueError("the prompt has no output schema")
    out = []
    for name, kind in re.findall(r"(?m)^\s*- `?(\w+)`? \(([^)]*)\)", found[1]):
        low = kind.strip().lower()
        out.append(T.StructField(name, next((t for k, t in PROMPT_TYPES if low.startswith(k)), T.StringType())))
    return T.StructType(out)
