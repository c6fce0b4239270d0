"""Nested states to flat named arrays and back, by a JSON template (never a pickle)."""

from __future__ import annotations

import json
from typing import Any

import numpy as np

TEMPLATE = "._template"


def flatten(tree: Any, prefix: str = "state") -> list[tuple[str, list[int], str, bytes]]:
    """Rows ``(name, shape, dtype, data)``: each numpy array of the tree, then the template."""
    rows: list[tuple[str, list[int], str, bytes]] = []

    def walk(x, path):
        if isinstance(x, np.ndarray):
            rows.append((path, list(x.shape), str(x.dtype), np.ascontiguousarray(x).tobytes()))
            return {"array": path, "shape": list(x.shape), "dtype": str(x.dtype)}
        if isinstance(x, dict):
            return {"dict": [[_key(k), walk(v, f"{path}.{k}")] for k, v in x.items()]}
        if isinstance(x, (list, tuple)):
            return {"list" if isinstance(x, list) else "tuple": [walk(v, f"{path}.{i}") for i, v in enumerate(x)]}
        if x is None or isinstance(x, (bool, int, float, str)):
            return {"value": x}
        raise TypeError(f"{path}: {type(x).__name__} can't be saved")

    template = json.dumps(walk(tree, prefix)).encode()
    return [*rows, (prefix + TEMPLATE, [len(template)], "uint8", template)]


def _key(k):
    if not isinstance(k, (str, int)) or isinstance(k, bool):
        raise TypeError(f"key {k!r} can't be saved")
    return k


def _build(node, leaf):
    ((kind, x), *_) = node.items()
    if kind == "array":
        return leaf(node)
    if kind == "dict":
        return {k: _build(v, leaf) for k, v in x}
    if kind in ("list", "tuple"):
        return [_build(v, leaf) for v in x] if kind == "list" else tuple(_build(v, leaf) for v in x)
    return x


def unflatten(arrays: dict[str, bytes], prefix: str = "state") -> Any:
    """The tree of named arrays; one that is missing is an error naming it."""
    def leaf(node):
        if node["array"] not in arrays:
            raise KeyError(f"missing array {node['array']!r}")
        return np.frombuffer(bytes(arrays[node["array"]]), node["dtype"]).reshape(node["shape"]).copy()

    return _build(json.loads(bytes(arrays[prefix + TEMPLATE])), leaf)


def describe(template: bytes) -> Any:
    """The tree with ``(name, shape, dtype)`` in place of arrays."""
    return _build(json.loads(template), lambda node: (node["array"], tuple(node["shape"]), node["dtype"]))
