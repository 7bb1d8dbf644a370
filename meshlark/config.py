"""Settings: defaults, overridden by a file, then the environment, then the caller; unknown names are errors."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, is_dataclass

from .functions import scores, text
from .operators import fusion, matching, review, search


@dataclass
class Tier:
    high: float = scores.HIGH
    medium: float = scores.MEDIUM
    margin: float = scores.MARGIN


@dataclass
class Matching:
    name_gap: float = matching.NAME_GAP
    group_gap: float = matching.GROUP_GAP
    address_gap: float = matching.ADDRESS_GAP
    endpoint_gap: float = 0.6
    label_heights: float = 3.0
    suffix_heights: float = 4.0
    duplicate_iou: float = 0.7
    least_cable: float = fusion.LEAST_CABLE
    missing_end: float = fusion.MISSING_END


@dataclass
class Retrieval:
    k1: float = search.K1
    b: float = search.B
    rrf: int = search.RRF
    top_k: int = search.TOP_K
    request_budget: int = review.BUDGET


@dataclass
class Settings:
    tier: Tier = field(default_factory=Tier)
    matching: Matching = field(default_factory=Matching)
    retrieval: Retrieval = field(default_factory=Retrieval)
    name_pattern: str = text.NAME
    link_pattern: str = text.LINK_TYPE


def override(settings, values: dict, path: str = "") -> None:
    """Puts nested values into a settings object, keeping each field's type."""
    known = {f.name for f in fields(settings)}
    for name, value in values.items():
        if name not in known:
            raise KeyError(f"unknown setting: {path}{name}")
        now = getattr(settings, name)
        if is_dataclass(now):
            override(now, value, f"{path}{name}.")
        else:
            setattr(settings, name, type(now)(value))


def load(file: str | None = None, environment: dict | None = None, prefix: str = "MESHLARK_", **caller) -> Settings:
    """Defaults < JSON file < environment (MESHLARK_TIER__HIGH=0.8) < caller."""
    settings = Settings()
    if file:
        with open(file, encoding="utf-8") as f:
            override(settings, json.load(f))
    for name, value in (os.environ if environment is None else environment).items():
        if name.startswith(prefix):
            nested: dict = {}
            *groups, last = name[len(prefix) :].lower().split("__")
            at = nested
            for g in groups:
                at = at.setdefault(g, {})
            at[last] = value
            override(settings, nested)
    override(settings, caller)
    return settings
