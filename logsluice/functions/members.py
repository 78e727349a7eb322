"""Edits of a JSON object's top-level members that copy all other text as it is written."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from typing import NamedTuple

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{},:]|[^\s"\[\]{},:]+', re.DOTALL)


class Member(NamedTuple):
    key: str
    written: str  # the key with its quotes, and the value, as they stand in the text
    value: str


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def members(text: str) -> list[Member] | None:
    """The top-level members in order, repeated keys too; None for anything that is no object.

    Values are found by their brackets, so that nothing is too deep and numbers, escapes and
    white space inside a value stay what they are.
    """
    try:
        if not isinstance(json.loads(text, parse_int=str, parse_float=str, parse_constant=_no_constant), dict):
            return None
    except RecursionError:
        if not text.lstrip().startswith("{"):
            return None
    except ValueError:
        return None
    out, depth, key, start = [], 0, None, 0
    for token in _TOKEN.finditer(text):
        sign = token[0]
        if depth == 1 and (sign in ",}"):
            if key is not None:
                out.append(Member(json.loads(key), key, text[start : token.start()].strip()))
            key = None
        elif depth == 1 and key is None:
            key = sign
        elif depth == 1 and sign == ":":
            start = token.end()
        if sign in ("{", "["):
            depth += 1
        elif sign in ("}", "]"):
            depth -= 1
    return out


def _text(found: Sequence[Member]) -> str:
    return "{" + ",".join(f"{m.written}:{m.value}" for m in found) + "}"


def without_prefixes(text: str, prefixes: tuple[str, ...]) -> str:
    """Without the members whose key starts with a prefix; the same text if there are none, or no object."""
    found = members(text)
    if found is None:
        return text
    kept = [m for m in found if not m.key.startswith(prefixes)]
    return text if len(kept) == len(found) else _text(kept)


def merged(text: str, extra: str) -> str:
    """The members of both. One of ``extra`` stands in the place of the first of the same key, and for all of them.

    What is no object has no members.
    """
    added = {m.key: m for m in members(extra) or ()}
    out, placed = [], set()
    for m in members(text) or ():
        if m.key not in added:
            out.append(m)
        elif m.key not in placed:
            placed.add(m.key)
            out.append(added[m.key])
    return _text([*out, *(m for m in added.values() if m.key not in placed)])
