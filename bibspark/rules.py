"""Hand-kept rules: venue and key overrides, and links between records of one work."""

from __future__ import annotations

import json
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from bibspark.functions.records import Rules

# What each kind of entry may hold, and the test its value must pass.
RULE = {"label": lambda v: isinstance(v, str) and v != "", "preprint": lambda v: isinstance(v, bool)}


def _require(right: bool, what: str) -> None:
    if not right:
        raise ValueError(what)


def _is_key(value) -> bool:
    return isinstance(value, str) and bool(value)


def checked_overrides(data) -> dict:
    """data if it is {venues: {name: rule}, key_prefixes: {prefix: rule}} with rules of RULE; every fault is named."""
    _require(isinstance(data, dict) and sorted(data) == ["key_prefixes", "venues"], "overrides hold the objects venues and key_prefixes")
    faults = []
    for section, entries in sorted(data.items()):
        if not isinstance(entries, dict):
            faults.append(section)
            continue
        for name, rule in entries.items():
            fine = _is_key(name) and isinstance(rule, dict) and bool(rule) and all(k in RULE and RULE[k](v) for k, v in rule.items())
            faults += [] if fine else [f"{section}: {name!r}"]
    _require(not faults, "no rules: " + "; ".join(faults))
    return data


def checked_links(data) -> list[list[str]]:
    """The key lists of {groups: [{keys, note}]}: two keys or more a group, no key twice in the file."""
    groups = data.get("groups") if isinstance(data, dict) and list(data) == ["groups"] else None
    _require(isinstance(groups, list), "links hold the array groups")
    for n, group in enumerate(groups, 1):
        fine = isinstance(group, dict) and {"keys"} <= set(group) <= {"keys", "note"} and isinstance(group["keys"], list) and isinstance(group.get("note", ""), str)
        _require(fine and len(group["keys"]) > 1 and all(map(_is_key, group["keys"])), f"group {n} is not two keys or more and perhaps a note")
    twice = [k for k, n in Counter(k for group in groups for k in group["keys"]).items() if n > 1]
    _require(not twice, f"keys that stand in the file more than once: {twice}")
    return [group["keys"] for group in groups]


def load_rules(path: str | Path) -> Rules:
    """The rules of a user's overrides file, to be handed to the engine."""
    return Rules.of(checked_overrides(json.loads(Path(path).read_text(encoding="utf-8"))))


def load_links(spark: SparkSession, path: str | Path) -> DataFrame:
    """links(key, group_id) of a rules file."""
    groups = checked_links(json.loads(Path(path).read_text(encoding="utf-8")))
    return spark.createDataFrame([(k, n) for n, keys in enumerate(groups, 1) for k in keys], "key string, group_id int")
