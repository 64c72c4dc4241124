"""A registry of named, described operations: the surface that outside callers invoke by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    parameters: dict[str, Any]
    call: Callable[..., Any]

    def signature(self) -> dict[str, Any]:
        """The tool's name, description and JSON schema."""
        return {"name": self.name, "description": self.description, "inputSchema": {"type": "object", "properties": self.parameters, "required": sorted(self.parameters)}}


@dataclass
class Registry:
    tools: dict[str, Tool] = field(default_factory=dict)

    def add(self, tool: Tool) -> None:
        self.tools[tool.name] = tool

    def invoke(self, name: str, arguments: dict[str, Any]) -> Any:
        """Call a tool by name; an unknown name raises KeyError."""
        return self.tools[name].call(**arguments)

    def signatures(self) -> list[dict[str, Any]]:
        return [self.tools[n].signature() for n in sorted(self.tools)]


def guarded(stages: list[str], write: Callable[[str], str], guard: Callable[[str], dict[str, Any]]) -> list[dict[str, Any]]:
    """Have each stage written by a given function and guarded; a failing writer gives an unavailable row."""
    rows = []
    for stage in stages:
        try:
            rows.append({"stage": stage, **guard(write(stage))})
        except Exception as error:  # noqa: BLE001  any writer may fail in any way
            rows.append({"stage": stage, "status": "unavailable", "text": "", "error": str(error)})
    return rows
