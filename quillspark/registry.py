"""Named components (chunkers, query transforms) built from validated configurations with stable ids."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Callable
from typing import Any


def canonical_json(value: Any) -> str:
    """Sorted keys, whole floats as integers, no spaces: equal configurations give equal text."""

    def plain(x: Any) -> Any:
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        return int(x) if isinstance(x, float) and x.is_integer() else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), default=str)


def config_hash(value: Any, length: int = 16) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()[:length]


@dataclasses.dataclass(frozen=True)
class Component:
    kind: str
    name: str
    version: int
    config: type
    build: Callable[..., Any]

    def config_id(self, **settings: Any) -> str:
        """name.vN@ and eight digits of the hash of the validated configuration, version included."""
        valid = dataclasses.asdict(self.config(**settings)) | {"version": self.version}
        return f"{self.name}.v{self.version}@{config_hash(valid, 8)}"


class Registry:
    """Components by kind and name; an unknown one is an error that lists what there is."""

    def __init__(self) -> None:
        self._by: dict[str, dict[str, Component]] = {}

    def add(self, component: Component) -> None:
        if component.name in self._by.setdefault(component.kind, {}):
            raise ValueError(f"{component.kind} {component.name} is registered already")
        self._by[component.kind][component.name] = component

    def kinds(self) -> list[str]:
        return sorted(self._by)

    def names(self, kind: str) -> list[str]:
        if kind not in self._by:
            raise KeyError(f"no kind {kind}; there are {', '.join(self.kinds())}")
        return sorted(self._by[kind])

    def get(self, kind: str, name: str) -> Component:
        if name not in self.names(kind):
            raise KeyError(f"no {kind} {name}; there are {', '.join(self.names(kind))}")
        return self._by[kind][name]

    def build(self, kind: str, name: str, **settings: Any) -> Any:
        c = self.get(kind, name)
        return c.build(c.config(**settings))
