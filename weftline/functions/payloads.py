"""Reading of JSON payloads."""

from __future__ import annotations

import json


def read_payload(text: str | None) -> object | None:
    """The value of a JSON text; a JSON string that holds JSON is decoded once more; None if unreadable."""
    if not text:
        return None
    try:
        value = json.loads(text)
        if isinstance(value, str):
            value = json.loads(value)
    except (ValueError, RecursionError):
        return None
    return value
