"""Named channels: a source and a sink put together by name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from millrace.operators.records import RECORD_TYPES, RecordSchema


@dataclass(frozen=True)
class Source:
    record_type: str
    directory: str
    delete_policy: str
    name_rule: str
    separator: str
    columns: tuple[str, ...] = ()

    def schema(self, registry: Mapping[str, RecordSchema] = RECORD_TYPES) -> RecordSchema:
        if self.record_type not in registry:
            raise ValueError(f"unknown record type {self.record_type!r}")
        schema = registry[self.record_type]
        return schema.only(self.columns) if self.columns else schema


@dataclass(frozen=True)
class Sink:
    topic: str = ""
    servers: str = ""
    table: str = ""
    skip_path: str = ""
    fail_path: str = ""


@dataclass(frozen=True)
class Channel:
    name: str
    source: Source
    sink: Sink


# What a source must have to count.
REQUIRED = ("record_type", "directory", "delete_policy", "name_rule", "separator")


def _columns(value: str | Sequence[str]) -> tuple[str, ...]:
    parts = value.split(",") if isinstance(value, str) else value
    return tuple(p.strip() for p in parts if p.strip())


def resolve(spec: Mapping[str, Mapping[str, Mapping]]) -> dict[str, Channel]:
    """Build channels from ``{"sources": …, "sinks": …, "channels": …}``.

    A source that lacks a required setting is dropped.  No source, sink or channel at all, or a
    channel that names one which does not exist, is an error.
    """
    sources = {
        name: Source(**{**given, "columns": _columns(given.get("columns", ()))})
        for name, given in spec.get("sources", {}).items()
        if all(given.get(setting) for setting in REQUIRED)
    }
    sinks = {name: Sink(**given) for name, given in spec.get("sinks", {}).items()}
    wanted = spec.get("channels", {})
    for what, found in (("source", sources), ("sink", sinks), ("channel", wanted)):
        if not found:
            raise ValueError(f"no {what} is configured")
    channels = {}
    for name, ends in wanted.items():
        for what, known in (("source", sources), ("sink", sinks)):
            if ends.get(what) not in known:
                raise ValueError(f"channel {name}: unknown {what} {ends.get(what)!r}")
        channels[name] = Channel(name, sources[ends["source"]], sinks[ends["sink"]])
    return channels
