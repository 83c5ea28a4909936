"""Configuration: names of predefined fields, level words, what is hidden and ignored, formats.

Layers are applied one over the other; each is a dict of the shape of DEFAULTS.
"""

from __future__ import annotations

import copy
import json
import tomllib
from pathlib import Path

# The names by which logs are known to hold each predefined field, best first.
DEFAULTS = {
    "fields": {
        "ignore": ["_*"],
        "hide": [],
        "predefined": {
            "time": {"names": ["ts", "TS", "time", "TIME", "Time", "timestamp", "Timestamp", "TIMESTAMP", "_SOURCE_REALTIME_TIMESTAMP", "__REALTIME_TIMESTAMP", "@timestamp"], "show": "always"},
            "logger": {"names": ["logger", "LOGGER", "Logger", "span.name"]},
            "level": {
                "show": "always",
                "variants": [
                    {
                        "names": ["level", "LEVEL", "Level"],
                        "values": {"error": ["error", "err", "fatal", "critical", "panic"], "warning": ["warning", "warn"], "info": ["info", "information"], "debug": ["debug"], "trace": ["trace"]},
                    },
                    {"names": ["PRIORITY"], "values": {"error": [3, 2, 1], "warning": [5, 4], "info": [6], "debug": [7]}},
                ],
            },
            "message": {"names": ["msg", "message", "MESSAGE", "Message"]},
            "caller": {"names": ["caller", "CALLER", "Caller"]},
            "caller-file": {"names": []},
            "caller-line": {"names": []},
        },
    },
    "formatting": {"flatten": "always", "prettify-field-keys": True, "message": {"format": "delimited"}, "expansion": {"mode": "auto"}},
    "time-format": "%b %d %T.%3N",
    "time-zone": "UTC",
    "input-info": "auto",
    "ascii": "auto",
}

# The marks between the parts of a line, as (ASCII, Unicode).
PUNCTUATION = {
    "logger-name-separator": (":", ":"), "field-key-value-separator": ("=", "="), "hidden-fields-indicator": ("...", "..."),
    "level-left-separator": ("[", "["), "level-right-separator": ("]", "]"), "array-separator": (" ", " "),
    "source-location-separator": ("-> ", "→ "), "message-delimiter": ("::", "›"), "caller-name-file-separator": (" @ ", " @ "),
    "input-number-prefix": ("#", "#"), "input-right-separator": (" | ", " │ "),
}


def merged(base: dict, over: dict) -> dict:
    """``over`` on ``base``, table by table; lists and scalars are replaced."""
    out = copy.deepcopy(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


def read_layer(path: str) -> dict:
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError:
            raise ValueError(f"{path}: YAML needs the yaml package") from None
        return yaml.safe_load(text) or {}
    return tomllib.loads(text)


def load(*paths: str) -> dict:
    """The defaults, then each file; ``-`` drops what came before it."""
    out = copy.deepcopy(DEFAULTS)
    for path in paths:
        out = copy.deepcopy(DEFAULTS) if path == "-" else merged(out, read_layer(path))
    return out


def layers(environ: dict[str, str], home: Path, system: Path = Path("/etc")) -> list[str]:
    """Files that hold before ``--config``: the system's, the user's, then the one that QUARRYLOG_CONFIG names."""
    user = Path(environ.get("XDG_CONFIG_HOME") or home / ".config")
    out = []
    for folder in (system, user):
        found = (folder / "quarrylog" / f"config.{kind}" for kind in ("toml", "yaml", "yml", "json"))
        out += [str(x) for x in found if x.is_file()][:1]
    return out + ([environ["QUARRYLOG_CONFIG"]] if environ.get("QUARRYLOG_CONFIG") else [])


def marks(settings: dict, unicode: bool) -> dict[str, str]:
    """PUNCTUATION in one of its forms; ``formatting.punctuation`` replaces a mark, for both forms or each (ascii, unicode)."""
    out = {k: v[unicode] for k, v in PUNCTUATION.items()}
    for name, given in settings["formatting"].get("punctuation", {}).items():
        out[name] = given if isinstance(given, str) else given.get("unicode" if unicode else "ascii", out.get(name, ""))
    return out


def level_words(variant: dict) -> dict[str, str]:
    """word -> level of a variant; words count as written, in lower, upper and title case."""
    out = {}
    for level, words in variant["values"].items():
        for word in map(str, words):
            for form in (word, word.lower(), word.upper(), word.title()):
                out.setdefault(form, level)
    return out
