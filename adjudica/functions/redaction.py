"""Redaction of options that are kept as JSON text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names whose values must not be shown, and what stands for them.
TELLING = re.compile(r"api[_-]?key|(?<!max[_-])token|secret|password|authorization|credential|cookie", re.I)
HIDDEN = "<redacted>"


class _Reader:
    """Reads JSON and hides values while objects are built, innermost first; ``hid`` tells whether any was."""

    def __init__(self) -> None:
        self.hid = False

    def built(self, pairs: list[tuple[str, object]]) -> dict[str, object]:
        telling = {name for name, _ in pairs if TELLING.search(name)}
        self.hid |= any(name in telling and value != HIDDEN for name, value in pairs)
        return dict(pairs) | dict.fromkeys(telling, HIDDEN)

    def read(self, text: str) -> object:
        return json.loads(text, object_pairs_hook=self.built)


def _written(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _inner(text: str) -> str:
    """A text among the options: if it holds a JSON object or list, that without what must not be shown."""
    reader = _Reader()
    try:
        value = reader.read(text) if text.lstrip()[:1] in ("{", "[") else None
    except ValueError:
        return text
    return _written(value) if reader.hid else text


def _options(text: str) -> str:
    reader = _Reader()
    try:
        options = reader.read(text)
    except ValueError:
        return text
    safe = {name: _inner(value) if isinstance(value, str) else value for name, value in options.items()} if isinstance(options, dict) else options
    return _written(safe) if reader.hid or safe != options else text


@F.pandas_udf(T.StringType())
def redacted(texts: pd.Series) -> pd.Series:
    """Each JSON text without the values of telling fields at any depth, also within JSON that one of its own fields has as a
    text; a text that isn't JSON, or null, or has nothing to hide stays as it is.  Texts that repeat in a batch are read once."""
    known = {text: _options(text) for text in texts.dropna().unique()}
    return pd.Series([known.get(text) for text in texts], texts.index, object)  # objects, as nulls alone would become numbers
