"""Settings with types and bounds: from a TOML file, the environment and the call, and judged where many owners' are stored in a table."""

from __future__ import annotations

import tomllib
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.arguments import ArgumentError

PREFIX = "WEBLOOM_"


class Setting(NamedTuple):
    """A setting's type, what it is by default, its bounds, and the values it may have."""

    kind: type
    default: object = None
    least: float | None = None
    most: float | None = None
    choices: tuple[str, ...] = ()


# Names, defaults and bounds. Fixed values.
SETTINGS: dict[str, Setting] = {
    "timeout": Setting(int, 30_000, 1_000, 300_000),
    "headless": Setting(bool, True),
    "wait_until": Setting(str, "domcontentloaded", choices=("domcontentloaded", "load", "networkidle")),
    "user_agent": Setting(str),
    "locale": Setting(str, "en-US"),
    "timezone": Setting(str, "UTC"),
    "engine": Setting(str, choices=("playwright", "patchright", "camoufox")),
    "stealth": Setting(bool, False),
    "escalate": Setting(bool, True),
    "solve_captcha": Setting(bool, False),
    "only_main_content": Setting(bool, True),
    "search_providers": Setting(str),
    "search_provider": Setting(str, "brave", choices=("duckduckgo", "brave")),
    "search_rate_limit": Setting(float, None, 0.1, 100.0),
    "strategy_memory": Setting(bool, True),
    "metrics": Setting(bool, True),
    "metrics_full_url": Setting(bool, False),
    "metrics_remote_url": Setting(str),
    "metrics_remote_username": Setting(str),
    "metrics_remote_tenant": Setting(str),
    "metrics_job": Setting(str, "webloom"),
    "cache_dir": Setting(str),
}
TRUE, FALSE = ("1", "true", "t", "yes", "y", "on"), ("0", "false", "f", "no", "n", "off")


def checked(name: str, value: object) -> object:
    """A value in its setting's type, from text too; an ArgumentError if it is none, out of bounds or no choice."""
    if name not in SETTINGS:
        raise ArgumentError(name, value, "is no setting")
    s = SETTINGS[name]
    if value is None:
        if s.default is None:
            return None
        raise ArgumentError(name, value, "needs a value")
    if s.kind is bool:
        text = str(value).strip().lower()
        if text not in TRUE + FALSE:
            raise ArgumentError(name, value, "needs true or false")
        return text in TRUE
    if s.kind is not str:
        try:
            number = s.kind(value.strip() if isinstance(value, str) else value)
        except (TypeError, ValueError):
            number = None
        if number is None or isinstance(value, bool) or (s.kind is int and isinstance(value, float) and value != number):
            raise ArgumentError(name, value, f"needs a {'whole ' if s.kind is int else ''}number")
        if (s.least is not None and not number >= s.least) or (s.most is not None and not number <= s.most):
            raise ArgumentError(name, value, f"needs {s.least} to {s.most}")
        return number
    if not isinstance(value, str):
        raise ArgumentError(name, value, "needs a text")
    if s.choices and value not in s.choices:
        raise ArgumentError(name, value, f"needs one of {', '.join(s.choices)}")
    return value


def stored(text: str | None) -> dict[str, object]:
    """A file's settings; a file that is no TOML counts as empty, so that it stops nothing. Unknown names are left out."""
    try:
        found = tomllib.loads(text or "")
    except tomllib.TOMLDecodeError:
        return {}
    return {k: v for k, v in found.items() if k in SETTINGS}


def from_environment(variables: Mapping[str, str], prefix: str = PREFIX) -> dict[str, str]:
    """The settings that the environment names."""
    return {name: variables[key] for name in SETTINGS if (key := f"{prefix}{name.upper()}") in variables}


def resolve(file: str | None = None, variables: Mapping[str, str] | None = None, call: Mapping[str, object] | None = None) -> dict[str, object]:
    """All settings by precedence, each checked: defaults, then the file, then the environment, then the call, of which nulls count as not given."""
    given = {k: v for k, v in (call or {}).items() if v is not None}
    layers = [stored(file), from_environment(variables or {}), given]
    named = {k: v for layer in layers for k, v in layer.items()}
    return {name: checked(name, named[name]) if name in named else s.default for name, s in SETTINGS.items()} | {k: checked(k, v) for k, v in given.items() if k not in SETTINGS}


def written(settings: Mapping[str, object]) -> str:
    """A file of the settings that are not as by default."""
    out = []
    for name, value in settings.items():
        value = checked(name, value)
        if value != SETTINGS[name].default:
            text = str(value).lower() if isinstance(value, bool) else str(value)
            out.append(f"{name} = " + (text if not isinstance(value, str) else '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'))
    return "\n".join([*out, ""])


def schema() -> dict:
    """The settings as a JSON schema, for forms."""
    kinds = {int: "integer", float: "number", bool: "boolean", str: "string"}
    made = {}
    for name, s in SETTINGS.items():
        made[name] = {"type": kinds[s.kind] if s.default is not None else [kinds[s.kind], "null"], "default": s.default}
        made[name] |= {k: v for k, v in (("minimum", s.least), ("maximum", s.most), ("enum", list(s.choices) or None)) if v is not None}
    return {"type": "object", "properties": made, "additionalProperties": False}


def judged(rows: DataFrame) -> DataFrame:
    """Stored settings (owner, name, value as text) with whether each is known and fits, and what is in effect for its owner: the value, or the default where it does not
    fit. The table of settings, one row each, goes to the rows; nothing is shuffled."""
    text_of = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    bound = lambda v: None if v is None else float(v)
    spec = [(n, s.kind.__name__, text_of(s.default), bound(s.least), bound(s.most), list(s.choices)) for n, s in SETTINGS.items()]
    known = rows.sparkSession.createDataFrame(spec, "name string, kind string, default string, least double, most double, choices array<string>")
    text, low, number = F.trim("value"), F.lower(F.trim("value")), F.trim("value").try_cast("double")
    bounded = number.isNotNull() & (number >= F.coalesce("least", number)) & (number <= F.coalesce("most", number))
    fits = (
        F.when(F.col("kind") == "bool", low.isin(*TRUE, *FALSE))
        .when(F.col("kind") == "int", text.rlike(r"^[+-]?[0-9]+$") & bounded)
        .when(F.col("kind") == "float", bounded)
        .otherwise((F.size("choices") == 0) | F.array_contains("choices", F.col("value")))
    )
    plain = F.when(F.col("kind") == "bool", F.when(low.isin(*TRUE), "true").otherwise("false")).when(F.col("kind").isin("int", "float"), text).otherwise(F.col("value"))
    out = rows.join(F.broadcast(known), "name", "left").withColumn("known", F.col("kind").isNotNull()).withColumn("fits", F.coalesce(fits, F.lit(False)) & F.col("known"))
    return out.select("owner", "name", "value", "known", "fits", F.when(F.col("fits"), plain).otherwise(F.col("default")).alias("effective"))
