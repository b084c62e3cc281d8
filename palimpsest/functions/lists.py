"""Ordered, duplicate-free operations on lists of names, and lookups in nested settings."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any


def is_array(value: Any) -> bool:
    """Whether ``value`` is a list of things: neither a string nor a mapping."""
    return isinstance(value, Iterable) and not isinstance(value, (str, bytes, Mapping))


def _key(name: Any, case_insensitive: bool) -> Any:
    return name.upper() if case_insensitive and isinstance(name, str) else name


def _several(lists: tuple) -> list[list]:
    """Lists given one by one, or as one list of lists; a flat list stands for itself."""
    if len(lists) == 1 and lists[0] and all(is_array(x) for x in lists[0]):
        lists = tuple(lists[0])
    return [list(x) for x in lists]


def list_union(*lists: Iterable, case_insensitive: bool = False) -> list:
    """Everything in any list, in the order and spelling first met."""
    found: dict[Any, Any] = {}
    for one in _several(lists):
        for name in one:
            found.setdefault(_key(name, case_insensitive), name)
    return list(found.values())


def list_intersection(*lists: Iterable, case_insensitive: bool = False) -> list:
    """What is in every list, in the order and spelling of the first."""
    first, *others = _several(lists) or [[]]
    held = [{_key(n, case_insensitive) for n in one} for one in others]
    return list_union([n for n in first if all(_key(n, case_insensitive) in h for h in held)], case_insensitive=case_insensitive)


def list_difference(a: Iterable, b: Iterable, case_insensitive: bool = False) -> list:
    """What is in ``a`` and not in ``b``."""
    without = {_key(n, case_insensitive) for n in b}
    return list_union([n for n in a if _key(n, case_insensitive) not in without], case_insensitive=case_insensitive)


def prefix_array_elements(names: Iterable[str], prefix: str) -> list[str]:
    if not is_array(names):
        raise ValueError(f"prefix_array_elements expects an array of strings, got: {names!r}")
    names = list(names)
    if not all(isinstance(n, str) for n in names):
        raise ValueError(f"prefix_array_elements expects all array elements to be strings, got: {names!r}")
    return [prefix + n for n in names]


def quoted_csv(names: Iterable[str], alias: str = "") -> str:
    """Names in one string, separated by commas, each behind ``alias.`` where one is given."""
    return ", ".join(f"{alias}.{n}" if alias else n for n in names)


def get_from_object(value: Any, *path: Any, default: Any = None) -> Any:
    """What lies at ``path`` in nested mappings and lists; ``default`` where a step leads nowhere (also a
    negative index)."""
    for step in path:
        if isinstance(value, Mapping):
            if step not in value:
                return default
            value = value[step]
        elif is_array(value) and isinstance(step, int) and 0 <= step < len(value):
            value = list(value)[step]
        else:
            return default
    return value


def get_config_value(config: Mapping, key: str, default: Any = None) -> Any:
    """A setting from the ``meta`` block, else from the settings themselves, else ``default``; one that is
    set to None counts as not set."""
    for found in (get_from_object(config, "meta", key), config.get(key)):
        if found is not None:
            return found
    return default
