"""Validated configuration, policy packs and their merge."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import dataclass, field

from ..operators.rules import Setting

LANGUAGES = ("typescript", "python")
# Analysis limits as (default, maximum), and the policy packs.
LIMITS = {"maxEntries": (100_000, 1_000_000), "maxFileBytes": (1_000_000, 100_000_000), "maxFiles": (10_000, 100_000), "maxGraphEdges": (1_000_000, 1_000_000), "maxTraversalDepth": (20, 100)}
THRESHOLDS = {"moderate": 20, "high": 50, "critical": 80}
AREA_NAMES = {
    "authentication": ("auth", "authentication"),
    "authorization": ("authorization", "permissions", "rbac"),
    "cryptography": ("crypto", "cryptography"),
    "credentials-and-secrets": ("credentials", "secrets"),
}
STRICT_THRESHOLDS = {"moderate": 15, "high": 40, "critical": 70}
STRICT_OPTIONS = {
    "high-fan-in": {"minFanIn": 3},
    "insufficient-coverage": {"maxLinePercentDrop": 0, "minChangedLinePercent": 90, "minLinePercent": 90},
    "large-change": {"maxFiles": 10, "maxLines": 250},
    "multi-area-change": {"minAreas": 2},
}


@dataclass(frozen=True)
class Pack:
    thresholds: Mapping[str, float] | None = None
    areas: Mapping[str, list[str]] = field(default_factory=dict)
    rules: Mapping[str, Setting] = field(default_factory=dict)


def _patterns(names: tuple[str, ...]) -> list[str]:
    """A file or folder of each name, at the top or anywhere below."""
    return sorted(f"{place}{name}{end}" for name in names for place in ("", "**/") for end in (".*", "/**"))


PACKS = {
    "security-sensitive": Pack(areas={area: _patterns(names) for area, names in AREA_NAMES.items()}),
    "strict-review": Pack(STRICT_THRESHOLDS, rules={rule: Setting(options=o) for rule, o in STRICT_OPTIONS.items()}),
}


@dataclass(frozen=True)
class Config:
    language: str = "typescript"
    packs: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    analysis: Mapping[str, int] = field(default_factory=lambda: {k: v[0] for k, v in LIMITS.items()})
    thresholds: tuple[float, float, float] = (20, 50, 80)
    areas: Mapping[str, list[str]] = field(default_factory=dict)
    rules: Mapping[str, Setting] = field(default_factory=dict)


def merge(before: Mapping[str, Setting], after: Mapping[str, dict]) -> dict[str, Setting]:
    """Later keys win one by one; options merge."""
    out = dict(before)
    for rule, new in after.items():
        old = before.get(rule, Setting())
        out[rule] = Setting(new.get("enabled", old.enabled), new.get("weight", old.weight), {**old.options, **new.get("options", {})})
    return dict(sorted(out.items()))


def compose(packs: tuple[str, ...]) -> Pack:
    """Packs in order; thresholds replace, areas go by id, rule options merge."""
    thresholds, areas, rules = None, {}, {}
    for name in packs:
        pack = PACKS[name]
        thresholds = pack.thresholds or thresholds
        areas |= pack.areas
        rules = merge(rules, {r: {"enabled": s.enabled, "options": s.options} | ({} if s.weight is None else {"weight": s.weight}) for r, s in pack.rules.items()})
    return Pack(thresholds, dict(sorted(areas.items())), rules)


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(f"invalid configuration: {message}")


def _keys(value: object, allowed: set[str], where: str) -> dict:
    _need(isinstance(value, dict), f"{where} is an object")
    _need(set(value) <= allowed, f"{where} has unknown keys")
    return value


def _number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def parse(raw: object) -> Config:
    """A configuration object (schema version 1); unknown keys are errors."""
    top = _keys(raw, {"schemaVersion", "language", "policyPacks", "ignorePatterns", "analysis", "thresholds", "sensitiveAreas", "rules"}, "the configuration")
    _need(top.get("schemaVersion") == 1, "schemaVersion is 1")
    language = top.get("language", "typescript")
    _need(language in LANGUAGES, "language")
    packs = top.get("policyPacks", [])
    _need(isinstance(packs, list) and all(p in PACKS for p in packs) and len(set(packs)) == len(packs), "policyPacks are known and unique")
    ignore = top.get("ignorePatterns", [])
    _need(isinstance(ignore, list) and len(ignore) <= 1_000 and all(isinstance(p, str) and 1 <= len(p) <= 1_000 for p in ignore), "ignorePatterns")
    given = _keys(top.get("analysis", {}), set(LIMITS), "analysis")
    analysis = {k: given.get(k, default) for k, (default, _) in LIMITS.items()}
    _need(all(isinstance(v, int) and not isinstance(v, bool) and 1 <= v <= LIMITS[k][1] for k, v in analysis.items()), "analysis limits")
    composed = compose(tuple(packs))
    thresholds = top.get("thresholds") or composed.thresholds or THRESHOLDS
    _need(set(thresholds) == set(THRESHOLDS) and all(_number(v) for v in thresholds.values()), "thresholds")
    steps = tuple(thresholds[k] for k in THRESHOLDS)
    _need(0 <= steps[0] < steps[1] < steps[2], "thresholds increase")
    areas = composed.areas
    if "sensitiveAreas" in top:
        listed = [_keys(a, {"id", "patterns"}, "an area") for a in top["sensitiveAreas"]]
        _need(all(isinstance(a.get("id"), str) and 1 <= len(a["id"]) <= 200 for a in listed), "area ids")
        _need(all(isinstance(a.get("patterns"), list) and 1 <= len(a["patterns"]) <= 100 and all(isinstance(p, str) and 1 <= len(p) <= 1_000 for p in a["patterns"]) for a in listed), "area patterns")
        areas = {a["id"]: list(a["patterns"]) for a in listed}
        _need(len(areas) == len(listed), "area ids are unique")
    rules = _keys(top.get("rules", {}), set(top.get("rules", {})), "rules")
    for rule, setting in rules.items():
        _keys(setting, {"enabled", "weight", "options"}, f"rule {rule}")
        _need(bool(rule) and isinstance(setting.get("enabled", True), bool) and ("weight" not in setting or _number(setting["weight"])) and isinstance(setting.get("options", {}), dict), f"rule {rule}")
    return Config(language, tuple(packs), tuple(ignore), analysis, steps, areas, merge(composed.rules, rules))


def load(path: str | None, required: bool = False) -> Config:
    """A configuration file of at most a megabyte; a missing default one means defaults."""
    import os

    if path is None or (not os.path.exists(path) and not required):
        return Config()
    if os.path.islink(path) or os.path.getsize(path) > 1_000_000:
        raise ValueError("the configuration file is a link or too large")
    with open(path, encoding="utf-8") as f:
        return parse(json.load(f))
