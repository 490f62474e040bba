"""Configuration trees: layers of JSON files merged on the driver, typed look-ups, and
a check against a schema. Small by nature; nothing here touches a table."""

from __future__ import annotations

import copy
import json
import os

TRUE, FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}
MISSING = object()


def deep_merge(base: dict, over: dict) -> dict:
    """Objects merge key by key, anything else is replaced; neither argument changes."""
    out = copy.deepcopy(base)
    for key, value in over.items():
        both = isinstance(out.get(key), dict) and isinstance(value, dict)
        out[key] = deep_merge(out[key], value) if both else copy.deepcopy(value)
    return out


def layers(*paths: str) -> Config:
    """Files in order, a later one over an earlier; missing files are no layer."""
    out: dict = {}
    for path in paths:
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                loaded = json.load(f)
            if not isinstance(loaded, dict):
                raise ValueError(f"{path}: the root must be an object")
            out = deep_merge(out, loaded)
    return Config(out)


class Config:
    def __init__(self, data: dict):
        self.data = copy.deepcopy(data)

    def at(self, key: str, default=None):
        """The value at a dotted key."""
        now = self.data if key else MISSING
        for part in key.split(".") if key else ():
            now = now.get(part, MISSING) if isinstance(now, dict) else MISSING
        return default if now is MISSING else now

    def text(self, key: str, default: str | None = None) -> str | None:
        value = self.at(key)
        return default if value is None else value if isinstance(value, str) else str(value)

    def flag(self, key: str, default: bool | None = None) -> bool | None:
        value = self.at(key)
        if isinstance(value, (bool, int)):
            return value != 0
        word = value.strip().lower() if isinstance(value, str) else ""
        return True if word in TRUE else False if word in FALSE else default

    def whole(self, key: str, default: int | None = None) -> int | None:
        value = self.at(key)
        if isinstance(value, bool) or value is None:
            return default
        if isinstance(value, float):
            return int(value) if value.is_integer() else default
        try:
            return int(value.strip() if isinstance(value, str) else value)
        except (TypeError, ValueError):
            return default


KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int, "number": (int, float)}


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """What a value breaks of a schema: type, enum, ranges, lengths, required and
    additional properties, items; in order of the tree."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    fits = [k for k in kinds if isinstance(value, KINDS[k]) and not (isinstance(value, bool) and k in ("integer", "number"))]
    if kinds and not fits:
        return [f"{at}: must be {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: must be one of {schema['enum']}")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    for name, bad in (("minimum", lambda m: value < m), ("maximum", lambda m: value > m), ("exclusiveMinimum", lambda m: value <= m), ("exclusiveMaximum", lambda m: value >= m)):
        if number and name in schema and bad(schema[name]):
            out.append(f"{at}: {name} is {schema[name]}")
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        out.append(f"{at}: needs {schema['minLength']} characters")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            out.append(f"{at}: needs {schema['minItems']} items")
        for i, item in enumerate(value):
            out += problems(item, schema.get("items", {}), f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}: {k} is missing" for k in schema.get("required", []) if k not in value]
        for key, item in value.items():
            if key in known:
                out += problems(item, known[key], f"{at}.{key}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}: {key} is unknown")
    return out
