"""Options of a run, checked as a whole before any work starts."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from datetime import UTC, datetime
from typing import Any


class RunError(Exception):
    """A run that did not end well; ``batch_id`` names it."""

    def __init__(self, message: str, batch_id: str | None = None):
        super().__init__(message)
        self.batch_id = batch_id


class ConfigurationError(RunError, ValueError):
    """Options that cannot be run; ``problems`` has them all."""

    def __init__(self, problems: list[str], batch_id: str | None = None):
        super().__init__("; ".join(problems), batch_id)
        self.problems = problems


class ExecutionError(RunError):
    """A task that failed; ``task`` names it."""

    def __init__(self, message: str, task: str, batch_id: str | None = None):
        super().__init__(message, batch_id)
        self.task = task


def batch_name(now: datetime | None = None) -> str:
    """A name for a run from the time, as one path component."""
    return (now or datetime.now(UTC)).strftime("%Y%m%dT%H%M%SZ")


def between(default: Any, low: float, high: float = float("inf")) -> Any:
    return field(default=default, metadata={"low": low, "high": high})


@dataclass(frozen=True)
class Options:
    """``low`` and ``high`` of a field's metadata are the bounds of its values, both included."""

    pages: str | list[int] | None = None
    batch_id: str | None = None
    model: str = ""
    thinking: str = "medium"
    detection_dpi: int = between(96, 1)
    contact_sheet_size: int = between(8, 1)
    agent_concurrency: int = between(5, 1, 5)
    find_concurrency: int = between(5, 1, 5)
    table_concurrency: int = between(5, 1)
    image_concurrency: int = between(5, 1)
    agent_timeout_seconds: float = between(1800.0, 1e-9)
    pages_per_call: int = between(8, 1)
    confidence_threshold: float = between(0.35, 0, 1)
    layout_options: dict = field(default_factory=dict)
    layout_provider: Any = None
    layout_cache_key: str | None = None
    retain_layout_tables: bool = True
    analyze_images: bool = True
    image_model: str | None = None
    image_thinking: str | None = "medium"
    image_render_dpi: int = between(240, 1)
    image_max_patches: int = between(10_000, 1)
    table_image_max_patches: int = between(30_000, 1)
    renderer: Callable | None = None
    agent: Callable | None = None
    image_agent: Callable | None = None
    table_agent: Callable | None = None
    keep_sessions: bool = False
    keep_work: bool = False
    show_progress: bool = False
    force: bool = False

    def page_list(self) -> list[int] | None:
        """The selected pages, sorted and unique; None for all."""
        if self.pages is None:
            return None
        if isinstance(self.pages, str):
            out: set[int] = set()
            for part in self.pages.split(","):
                ends = re.fullmatch(r"\s*([1-9]\d{0,8})(?:-([1-9]\d{0,8}))?\s*", part)
                if not ends or int(ends[2] or ends[1]) < int(ends[1]):
                    raise ValueError("pages must be a list like 1,3,8-12")
                out.update(range(int(ends[1]), int(ends[2] or ends[1]) + 1))
            return sorted(out)
        if not self.pages or any(isinstance(p, bool) or not isinstance(p, int) or p < 1 for p in self.pages):
            raise ValueError("pages must be whole numbers from 1 on")
        return sorted(set(self.pages))

    def problems(self) -> list[str]:
        out = []
        for f in (f for f in fields(self) if f.metadata):
            value, low, high = getattr(self, f.name), f.metadata["low"], f.metadata["high"]
            if isinstance(value, bool) or not isinstance(value, (int, float)) or not low <= value <= high:
                out.append(f"{f.name} must be from {low} to {high}" if high < float("inf") else f"{f.name} must be at least {low}")
        for f in fields(self):
            if f.type == "bool" and not isinstance(getattr(self, f.name), bool):
                out.append(f"{f.name} must be true or false")
        if self.batch_id is not None and (self.batch_id in ("", ".", "..") or set(self.batch_id) & set("/\\")):
            out.append("batch_id must be one path component")
        try:
            self.page_list()
        except ValueError as e:
            out.append(str(e))
        if not isinstance(self.layout_options, dict):
            out.append("layout_options must be a dictionary")
        else:
            try:
                json.dumps(self.layout_options)
            except (TypeError, ValueError):
                out.append("layout_options must be plain JSON values")
        if self.layout_provider is not None and self.layout_options:
            out.append("layout_provider and layout_options exclude each other")
        if self.layout_provider is not None and not callable(getattr(self.layout_provider, "convert", None)):
            out.append("layout_provider must have a callable convert")
        if self.layout_cache_key and self.layout_provider is None:
            out.append("layout_cache_key needs layout_provider")
        out += [f"{n} must be callable" for n in ("renderer", "agent", "image_agent", "table_agent") if getattr(self, n) is not None and not callable(getattr(self, n))]
        return out

    def checked(self) -> Options:
        if problems := self.problems():
            raise ConfigurationError(problems, self.batch_id if isinstance(self.batch_id, str) else None)
        return self

    def signature(self) -> dict:
        """What results depend on: not how many workers there are, what is shown or kept."""
        idle = {"batch_id", "agent_concurrency", "find_concurrency", "table_concurrency", "image_concurrency", "keep_sessions", "keep_work", "show_progress", "force", "layout_provider", "renderer", "agent", "image_agent", "table_agent"}
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name not in idle}
