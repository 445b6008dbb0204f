"""Plugins: rules and language adapters, checked and never run at registration."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.rules import DEFAULT_RULES, Rule
from ..sources import python_modules, typescript_modules

# Limits and the form of identifiers.
MAX_PLUGINS, MAX_RULES, MAX_ADAPTERS, MAX_ALL_RULES, MAX_ALL_ADAPTERS, MAX_WEIGHT = 32, 100, 16, 1_000, 100, 10_000
IDENTIFIER = re.compile(r"[a-z][a-z0-9]*(?:-[a-z0-9]+)*")


@dataclass(frozen=True)
class LanguageAdapter:
    """``imports`` and ``schema`` parse one file; ``resolve`` works on tables."""

    id: str
    imports: Callable[[str, str], list[tuple]]
    schema: str
    resolve: Callable[..., object]


@dataclass(frozen=True)
class Plugin:
    id: str
    rules: tuple[Rule, ...] = ()
    adapters: tuple[LanguageAdapter, ...] = ()
    api_version: int = 1


def _python(modules: DataFrame, references: DataFrame) -> DataFrame:
    return python_modules.resolve(modules, references)[0]


BUILT_IN = (
    LanguageAdapter("typescript", typescript_modules.imports, typescript_modules.IMPORTS, typescript_modules.resolve),
    LanguageAdapter("python", python_modules.imports, python_modules.IMPORTS, _python),
)


@dataclass(frozen=True)
class Registry:
    rules: tuple[Rule, ...]
    adapters: tuple[LanguageAdapter, ...]


def _ids(items: list, what: str) -> None:
    names = [x.id for x in items]
    if not all(len(n) <= 100 and IDENTIFIER.fullmatch(n) for n in names):
        raise ValueError(f"a {what} has an invalid id")
    if len(set(names)) != len(names):
        raise ValueError(f"{what} ids must be unique")


def create(plugins: list[Plugin]) -> Registry:
    """Built-in and plugin rules and adapters, sorted by id."""
    if len(plugins) > MAX_PLUGINS or any(len(p.rules) > MAX_RULES or len(p.adapters) > MAX_ADAPTERS for p in plugins):
        raise ValueError("plugin limits exceeded")
    if any(p.api_version != 1 for p in plugins):
        raise ValueError("unsupported plugin api version")
    _ids(plugins, "plugin")
    rules = [*DEFAULT_RULES, *(r for p in plugins for r in p.rules)]
    adapters = [*BUILT_IN, *(a for p in plugins for a in p.adapters)]
    if len(rules) > MAX_ALL_RULES or len(adapters) > MAX_ALL_ADAPTERS:
        raise ValueError("plugin limits exceeded")
    if any(not callable(r.evaluate or r.shaped) or not abs(r.weight) <= MAX_WEIGHT for r in rules) or any(not callable(a.imports) or not callable(a.resolve) for a in adapters):
        raise ValueError("a plugin rule or adapter is invalid")
    _ids(rules, "rule")
    _ids(adapters, "adapter")
    return Registry(tuple(sorted(rules, key=lambda r: r.id)), tuple(sorted(adapters, key=lambda a: a.id)))
