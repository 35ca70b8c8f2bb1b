"""Documents of settings: strict parsing and recursive merging, on the driver (they are small)."""

from __future__ import annotations

import json


def merge(base: dict, own: dict) -> dict:
    """``base`` with the settings of ``own``: objects merge key by key, everything else is replaced."""
    out = dict(base)
    for k, v in own.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def strict_json(text: str):
    """JSON without repeated keys and without NaN or infinities."""

    def once(pairs):
        keys = [k for k, _ in pairs]
        if len(set(keys)) != len(keys):
            raise ValueError(f"repeated key in {keys}")
        return dict(pairs)

    def no(name):
        raise ValueError(f"{name} is no number")

    return json.loads(text, object_pairs_hook=once, parse_constant=no)
