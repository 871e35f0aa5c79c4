"""Layered configuration: groups, overrides by dotted keys, references; settings from the environment."""

from __future__ import annotations

import copy
import functools
import os
import re

_REFERENCE = re.compile(r"\$\{([^}]+)\}")


def merged(*layers: dict) -> dict:
    """Deep merge; later layers win."""
    out: dict = {}
    for layer in layers:
        for key, value in layer.items():
            out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


def _at(tree: dict, path: str):
    for part in path.split("."):
        tree = tree[part]
    return tree


def _typed(text: str):
    if text in ("null", "none", "None"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def composed(groups: dict[str, dict[str, dict]], chosen: dict[str, str], base: dict | None = None, overrides: tuple[str, ...] = ()) -> dict:
    """A configuration of one option of each group, with ``key.path=value`` overrides and ``${key.path}`` references resolved."""
    tree = merged(base or {}, {g: groups[g][o] for g, o in chosen.items()})
    for item in overrides:
        path, _, value = item.partition("=")
        *above, last = path.lstrip("+").split(".")
        node = tree
        for part in above:
            node = node.setdefault(part, {})
        node[last] = _typed(value)

    def resolved(value):
        if isinstance(value, dict):
            return {k: resolved(v) for k, v in value.items()}
        if isinstance(value, str) and (whole := _REFERENCE.fullmatch(value)):
            return resolved(_at(tree, whole[1]))
        return _REFERENCE.sub(lambda m: str(resolved(_at(tree, m[1]))), value) if isinstance(value, str) else value

    return resolved(tree)


def from_environment(defaults: dict[str, object], env: dict[str, str] | None = None) -> dict[str, object]:
    """Defaults replaced by variables of the same name in upper case; unknown variables are ignored."""
    env = dict(os.environ) if env is None else env
    return {k: type(v)(_typed(env[k.upper()])) if k.upper() in env and v is not None else env.get(k.upper(), v) for k, v in defaults.items()}


def env_file(path: str) -> dict[str, str]:
    """The settings of a file of KEY=value lines; comments, blank lines, ``export`` and quotes as usual. A missing file has none."""
    out: dict[str, str] = {}
    if not os.path.exists(path):
        return out
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            key, mark, value = line.strip().removeprefix("export ").partition("=")
            if mark and key.strip() and not key.startswith("#"):
                value = value.strip()
                quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
                out[key.strip().upper()] = value[1:-1] if quoted else value.split(" #")[0].rstrip()
    return out


@functools.cache
def _cached(defaults: tuple, path: str) -> tuple:
    env = {k.upper(): v for k, v in os.environ.items()}
    return tuple(from_environment(dict(defaults), env_file(path) | env).items())


def settings(defaults: dict[str, object], path: str = ".env") -> dict[str, object]:
    """Defaults, replaced by those of an .env file, and these by the environment's, whatever the case of their names; read once for the same defaults and path."""
    return dict(_cached(tuple(defaults.items()), path))


def database_url(user: str, password: str, host: str, port: int, name: str, override: str | None = None) -> str:
    return override or f"jdbc:postgresql://{host}:{port}/{name}?user={user}&password={password}"
