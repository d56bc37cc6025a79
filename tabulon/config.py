"""Options, kept as JSON in the Spark session's configuration."""

from __future__ import annotations

import json
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULTS = {
    "display.max_rows": 1000,
    "compute.max_rows": 1000,
    "compute.max_columns": 10_000,
    "compute.shortcut_limit": 1000,
    "compute.ops_on_diff_frames": False,
    "compute.default_index_type": "distributed",
    "compute.ordered_head": False,
    "plotting.max_rows": 1000,
    "plotting.sample_ratio": None,
    "plotting.backend": "plotly",
}
INDEX_TYPES = ("sequence", "distributed", "distributed-sequence")


class OptionError(AttributeError, KeyError):
    """No such option."""


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _check(key: str, value=None) -> str:
    if key not in DEFAULTS:
        raise OptionError(f"no such option: {key!r}; there are {', '.join(DEFAULTS)}")
    default = DEFAULTS[key]
    if value is not None and default is not None and (type(value) is not type(default)):
        raise ValueError(f"{key} takes {type(default).__name__}, not {value!r}")
    if key == "compute.default_index_type" and value is not None and value not in INDEX_TYPES:
        raise ValueError(f"{key} is one of {INDEX_TYPES}")
    return f"tabulon.{key}"


def get_option(key: str, default=...):
    name = _check(key)
    found = _session().conf.get(name, None)
    return json.loads(found) if found is not None else DEFAULTS[key] if default is ... else default


def set_option(key: str, value) -> None:
    _session().conf.set(_check(key, value), json.dumps(value))


def reset_option(key: str) -> None:
    _session().conf.unset(_check(key))


def show_options() -> dict:
    return {k: get_option(k) for k in DEFAULTS}


@contextmanager
def option_context(*args):
    """``with option_context("display.max_rows", 10): ...``"""
    if len(args) % 2 or not args:
        raise ValueError("give pairs of an option and its value")
    pairs = list(zip(args[::2], args[1::2]))
    before = {k: get_option(k) for k, _ in pairs}
    try:
        for k, v in pairs:
            set_option(k, v)
        yield
    finally:
        for k, v in before.items():
            set_option(k, v)


class Options:
    """Attribute access: ``options.display.max_rows = 10``."""

    def __init__(self, prefix: str = ""):
        object.__setattr__(self, "_prefix", prefix)

    def __getattr__(self, name):
        key = f"{self._prefix}.{name}" if self._prefix else name
        return get_option(key) if key in DEFAULTS else Options(key) if any(k.startswith(f"{key}.") for k in DEFAULTS) else _check(key)

    def __setattr__(self, name, value):
        set_option(f"{self._prefix}.{name}" if self._prefix else name, value)

    def __dir__(self):
        return [k.removeprefix(f"{self._prefix}.") for k in DEFAULTS if k.startswith(self._prefix)]


options = Options()
