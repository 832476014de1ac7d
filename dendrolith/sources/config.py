"""Analysis documents: tolerant JSON, pruning and references by id."""

from __future__ import annotations

import json
import re

STRING = re.compile(r'"(?:\\.|[^"\\])*"')


def read(text: str) -> dict:
    """JSON with trailing commas."""
    kept: list[str] = []
    plain = STRING.sub(lambda m: (kept.append(m[0]), f"\0{len(kept) - 1}\0")[1], text)
    plain = re.sub(r",(\s*[}\]])", r"\1", plain)
    return json.loads(re.sub("\0([0-9]+)\0", lambda m: kept[int(m[1])], plain))


def prune(node):
    """Drop objects marked ``ignore`` and keys that start with an underscore."""
    if isinstance(node, dict):
        return {k: prune(v) for k, v in node.items() if not k.startswith("_") and not (isinstance(v, dict) and v.get("ignore"))}
    if isinstance(node, list):
        return [prune(v) for v in node if not (isinstance(v, dict) and v.get("ignore"))]
    return node


class Registry:
    """Objects by id. ``&id`` names an object, ``%id`` a vector and ``$id`` a simplex; ``id[a:b]`` a slice."""

    def __init__(self, document):
        self.by_id: dict[str, dict] = {}
        self._collect(document)

    def _collect(self, node) -> None:
        if isinstance(node, dict):
            if "id" in node:
                self.by_id[node["id"]] = node
            for v in node.values():
                self._collect(v)
        elif isinstance(node, list):
            for v in node:
                self._collect(v)

    def resolve(self, reference: str):
        found = re.fullmatch(r"([&%$])([^\[\]]+)(?:\[(\d*):(\d*)\])?", reference)
        if not found or found[2] not in self.by_id:
            raise KeyError(reference)
        node = self.by_id[found[2]]
        if found[1] == "&" and found[3] is None:
            return node
        values = node.get("values", node.get("x"))
        return values if found[3] is None else values[int(found[3] or 0) : int(found[4]) if found[4] else None]


def check_keys(node: dict, allowed: set[str]) -> None:
    unknown = set(node) - allowed - {"id", "type"}
    if unknown:
        raise ValueError(f"unknown keys {sorted(unknown)} in {node.get('id', '?')}")
