"""Settings by precedence, with their checks, and the same judged in a table."""

import tomllib

import pytest

from webloom.functions import settings
from webloom.functions.arguments import ArgumentError


def test_precedence():
    file = 'timeout = 5000\nstealth = true\nlocale = "de-DE"\nunknown = 1\n'
    env = {"WEBLOOM_TIMEOUT": "7000", "WEBLOOM_HEADLESS": "off", "OTHER_STEALTH": "0"}
    got = settings.resolve(file, env, {"locale": "fr-FR", "engine": None})
    assert (got["timeout"], got["stealth"], got["headless"], got["locale"], got["engine"], got["timezone"]) == (7000, True, False, "fr-FR", None, "UTC")
    assert settings.resolve("not = = toml") == settings.resolve() == {n: s.default for n, s in settings.SETTINGS.items()}
    with pytest.raises(ArgumentError):
        settings.resolve(call={"nothing": 1})


@pytest.mark.parametrize(("name", "value"), [("timeout", "soon"), ("timeout", 999), ("timeout", 300_001), ("timeout", True), ("timeout", 5000.5), ("stealth", "maybe"), ("engine", "netscape"), ("search_rate_limit", "0.01"), ("locale", 5), ("locale", None), ("x", 1), ("search_rate_limit", "nan")])
def test_checks(name, value):
    with pytest.raises(ArgumentError):
        settings.checked(name, value)


def test_files():
    given = {"timeout": 2000, "stealth": True, "locale": 'a "b" \\ c', "search_rate_limit": 2.5, "headless": True}
    text = settings.written(given)
    assert tomllib.loads(text) == {k: v for k, v in given.items() if k != "headless"} and settings.resolve(text)["locale"] == given["locale"]
    shape = settings.schema()["properties"]
    assert shape["timeout"] == {"type": "integer", "default": 30_000, "minimum": 1_000, "maximum": 300_000} and shape["engine"]["type"] == ["string", "null"] and "camoufox" in shape["engine"]["enum"]


def test_table(spark):
    """What fits in a table is what the checks let through."""
    values = ["5000", " 5000 ", "999", "1e4", "true", "Off", "", "brave", "camoufox", "0.1", "101", "text", "UTC", "+70000", "nan"]
    rows = [(k, n, v) for n in [*settings.SETTINGS, "nothing"] for k, v in enumerate(values)] + [(99, "timeout", None), (None, None, "x")]
    for r in settings.judged(spark.createDataFrame(rows, "owner int, name string, value string")).collect():
        try:
            fits = r.value is not None and settings.checked(r.name, r.value) is not None
        except ArgumentError:
            fits = False
        assert r.fits == fits and r.known == (r.name in settings.SETTINGS), r
        default = settings.SETTINGS[r.name].default if r.known else None
        if not r.fits:
            assert r.effective == (None if default is None else str(default).lower() if isinstance(default, bool) else str(default))
        else:
            assert settings.checked(r.name, r.effective) == settings.checked(r.name, r.value)
