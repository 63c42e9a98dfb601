"""Rules from a TOML text: a table per rule, whose keys are the rule's own."""

from __future__ import annotations

import dataclasses
import math
import tomllib

from taplight.operators.detectors import Beacon, DnsTunnel, Flood, Outbound, Scan, TlsMetadata

RULES = {"flood": Flood, "scan": Scan, "beacon": Beacon, "outbound": Outbound, "dns_tunnel": DnsTunnel, "tls_metadata": TlsMetadata}


def load(text: str) -> dict[str, object]:
    """A rule per table, those that are not named with their defaults.

    Unknown tables and keys, values of another type (true is no number), numbers that are not finite and numbers below
    zero raise ValueError.
    """
    found = tomllib.loads(text)
    if unknown := set(found) - set(RULES):
        raise ValueError(f"no such rule: {', '.join(sorted(unknown))}")
    out: dict[str, object] = {}
    for name, rule in RULES.items():
        table = found.get(name, {})
        if not isinstance(table, dict):
            raise ValueError(f"{name} is not a table")
        defaults = {f.name: f.default for f in dataclasses.fields(rule)}
        if unknown := set(table) - set(defaults):
            raise ValueError(f"{name} has no {', '.join(sorted(unknown))}")
        out[name] = rule(**{k: _checked(f"{name}.{k}", v, defaults[k]) for k, v in table.items()})
    return out


def _checked(where: str, value: object, default: object) -> object:
    if isinstance(default, tuple):
        if not isinstance(value, list):
            raise ValueError(f"{where} must be a list")
        return tuple(_checked(where, v, default[0]) for v in value)
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if not number or (isinstance(default, int) and not isinstance(value, int)) or not math.isfinite(value) or value < 0:
        raise ValueError(f"{where} must be a finite number that is not below zero, of the kind of {default!r}")
    return float(value) if isinstance(default, float) else value
