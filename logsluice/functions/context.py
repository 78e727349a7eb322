"""The semi-structured ``context`` column, held as JSON text.

What is looked up is looked up by built-in functions. Edits (``merge_context``,
``drop_internal_keys``, ``clean_context``, ``redact_json``) go through one Arrow-batched
pass, only for the rows that need it, and copy what they do not change.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from json.encoder import encode_basestring, encode_basestring_ascii

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from logsluice.functions.members import merged, without_prefixes
from logsluice.functions.url import REDACTED, SENSITIVE_KEYS

INTERNAL_PREFIXES = ("__", "_internal")
INTERNAL_MARK = "_internal"
CALLBACK_ERROR = "_callback_error"
TRACE_FRAMES = 10
# Levels kept in either form, and bytes of a text in the handler form.
PLAIN_DEPTH = 5
HANDLER_DEPTH = 10
HANDLER_TEXT = 10_000

# Frame fields that are safe to keep, and the texts left behind
# where something was cut.
FRAME_FIELDS = ("file", "line", "function", "class", "type")
TOO_DEEP = "[Max depth exceeded]"
TOO_DEEP_MARK = {"_truncated": "Max depth exceeded"}
CUT_MARK = "... [truncated]"

_FRAMES = "array<struct<file:string,line:bigint,function:string,class:string,type:string>>"
_EXCEPTION = (
    "exception struct<class:string,message:string,file:string,line:int,"
    "trace:array<struct<file:string,line:int>>>"
)


def context_value(context: Column, path: str) -> Column:
    """A value by dotted or bracketed path, such as ``user.roles[0]``."""
    steps = path.removeprefix("root").lstrip(".")
    if not steps:
        return context
    return F.get_json_object(context, "$" + (steps if steps.startswith("[") else "." + steps))


def drop_internal_keys(context: Column, prefixes: Sequence[str] = INTERNAL_PREFIXES) -> Column:
    """Without the top-level members whose key starts with one of ``prefixes``.

    All other members stay as they are written: numbers of any length, repeated keys, escapes.
    """
    mentioned = F.contains(context, F.lit("\\u"))
    for prefix in prefixes:
        mentioned = mentioned | F.contains(context, F.lit('"' + prefix))
    return _apply(lambda text: without_prefixes(text, tuple(prefixes)), context, mentioned)


def slim_trace(trace: Column, frames: int = TRACE_FRAMES) -> Column:
    """A JSON trace cut to its first frames, with only the safe fields of each."""
    return F.to_json(F.slice(F.from_json(trace, _FRAMES), 1, frames))


def source_from_exception(context: Column) -> Column:
    """``struct(source, source_line)`` of the exception held in the context.

    Argument errors are reported where the callee is declared, so for them the
    first trace frame, the caller, is taken when it names a file.
    """
    # Without the word there is no exception, unless its letters are escaped.
    named = F.contains(context, F.lit("exception")) | F.contains(context, F.lit("\\u"))
    exception = F.from_json(F.when(named, context), _EXCEPTION)["exception"]
    caller = F.get(exception["trace"], 0)
    # Class names and wording of argument errors.
    argument_error = (exception["class"] == "ArgumentCountError") | (
        (exception["class"] == "TypeError")
        & F.contains(exception["message"], F.lit("Argument #"))
    )
    use_caller = F.coalesce(argument_error & (F.length(caller["file"]) > 0), F.lit(False))
    return F.struct(
        F.when(use_caller, caller["file"]).otherwise(exception["file"]).alias("source"),
        F.when(use_caller, F.coalesce(caller["line"], exception["line"]))
        .otherwise(exception["line"])
        .alias("source_line"),
    )


def merge_context(context: Column, extra: Column, error: Column | None = None) -> Column:
    """Context plus extra members; an extra member replaces one of the same key.

    Where making the extras failed (``error`` not null), the row keeps its own
    context and tells the error in a marker member. Members that stay are copied as
    they are written; what is no object has no members.
    """
    added = extra
    if error is not None:
        told = F.to_json(F.create_map(F.lit(CALLBACK_ERROR), error))
        added = F.when(error.isNotNull(), told).otherwise(extra)

    @F.pandas_udf("string")
    def both(texts: pd.Series, extras: pd.Series) -> pd.Series:
        return pd.Series([None if e is None else merged(t, e) for t, e in zip(texts, extras, strict=True)], dtype=object)

    # Rows without anything to add go in as null.
    joined = both(F.when(added.isNotNull(), F.coalesce(context, F.lit(""))), added)
    return F.when(added.isNotNull(), joined).otherwise(context)


# --- recursive shaping: a small per-value helper run in Arrow batches ---------


class _Pairs(list):
    """A JSON object as it is written: keys in order, repeated ones too."""


class _Number(str):
    """A JSON number as it is written, whatever its size or digits."""


# NaN and Infinity are not JSON; they read as null.
_READER = json.JSONDecoder(
    object_pairs_hook=_Pairs, parse_float=_Number, parse_int=_Number, parse_constant=lambda _: None
)
_HALF = re.compile("[\ud800-\udfff]")


def _read(text: str) -> object:
    return _READER.decode(text)


def _string(text: str) -> str:
    # Half of a surrogate pair, as a cut emoji leaves it, has no UTF-8 form.
    if not text.isascii() and _HALF.search(text):
        return encode_basestring_ascii(text)
    return encode_basestring(text)


def _written(value: object) -> str:
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, str):
        return _string(value)
    if isinstance(value, dict):
        value = _Pairs(value.items())
    if isinstance(value, _Pairs):
        return "{" + ",".join(f"{_string(k)}:{_written(v)}" for k, v in value) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_written, value)) + "]"
    return json.dumps(value)


def _shaper(
    keys: tuple[str, ...] | None,
    prefixes: tuple[str, ...],
    every_depth: bool,
    max_depth: int | None,
    depth_mark: object,
    string_limit: int | None,
    slim_traces: bool = True,
) -> Callable[[str], str]:
    """The function that cleans one JSON text, with its options bound."""

    def slim(frames: object) -> object:
        if not isinstance(frames, list):
            return frames
        named = [dict(frame) for frame in frames[:TRACE_FRAMES] if isinstance(frame, _Pairs)]
        return [{f: frame[f] for f in FRAME_FIELDS if frame.get(f) is not None} for frame in named]

    def shape(value: object, depth: int) -> object:
        scalar = not isinstance(value, list)
        # A text mark replaces whatever lies too deep; an object mark only
        # stands in for arrays and objects.
        if max_depth is not None and depth > max_depth and not (scalar and every_depth):
            return depth_mark
        if isinstance(value, str) and not isinstance(value, _Number):
            raw = value.encode("utf-8", "surrogatepass") if string_limit else b""
            if string_limit and len(raw) > string_limit:
                return raw[:string_limit].decode("utf-8", "ignore") + CUT_MARK
            return value
        if scalar:
            return value
        if not isinstance(value, _Pairs):
            return [shape(v, depth + 1) for v in value]
        if slim_traces and dict(value).get("_type") == "exception":
            return _Pairs((k, hide(k, slim(v) if k == "trace" else shape(v, min(depth, 0)))) for k, v in value)
        return _Pairs(
            (k, hide(k, shape(v, depth + 1)))
            for k, v in value
            if not (every_depth and k.startswith(prefixes))
        )

    def hide(key: str, value: object) -> object:
        if keys and any(part in key.lower() for part in keys):
            return REDACTED
        return value

    def clean(text: str) -> str:
        try:
            root = _read(text)
            if isinstance(root, _Pairs):
                root = _Pairs(
                    (k, hide(k, shape(v, 1 if every_depth else 0))) for k, v in root if not k.startswith(prefixes)
                )
            elif isinstance(root, list):
                root = [shape(v, 1 if every_depth else 0) for v in root]
            else:
                return text
            return _written(root)
        except RecursionError:
            # Nested beyond what can be looked through, so nothing of it may be shown.
            return _written(depth_mark or TOO_DEEP)
        except ValueError:
            return text

    return clean


def _apply(clean: Callable[[str], str], context: Column, needed: Column) -> Column:
    @F.pandas_udf("string")
    def shaped(texts: pd.Series) -> pd.Series:
        return texts.map(clean, na_action="ignore")

    # Rows that need nothing go in as null: no JSON is parsed for them.
    return F.coalesce(shaped(F.when(needed, context)), context)


def redact_json(
    context: Column, keys: Sequence[str] = SENSITIVE_KEYS, enabled: bool = True
) -> Column:
    """Values of sensitive keys replaced, at every depth."""
    if not enabled:
        return context
    keys = tuple(k.lower() for k in keys)
    mentioned = F.lit(False)
    for key in keys:
        mentioned = mentioned | F.contains(F.lower(context), F.lit(key))
    # An escaped key may spell a listed word without containing it.
    mentioned = mentioned | F.contains(context, F.lit("\\u"))
    return _apply(_shaper(keys, (), True, None, None, None, slim_traces=False), context, mentioned)


def clean_context(
    context: Column,
    keys: Sequence[str] = SENSITIVE_KEYS,
    prefixes: Sequence[str] = INTERNAL_PREFIXES,
    redact: bool = True,
    handler: bool = False,
) -> Column:
    """Internal keys dropped, sensitive values redacted, traces slimmed, depth cut.

    The plain form cuts below five levels with a text. The ``handler`` form
    drops internal keys at every depth, cuts arrays and objects below ten
    levels with a marker object and shortens texts over 10,000 bytes.
    """
    keys = tuple(k.lower() for k in keys) if redact else None
    if handler:
        depth = HANDLER_DEPTH
        clean = _shaper(keys, tuple(prefixes), True, depth, TOO_DEEP_MARK, HANDLER_TEXT)
    else:
        depth = PLAIN_DEPTH
        clean = _shaper(keys, tuple(prefixes), False, depth, TOO_DEEP, None)
    # Most contexts hold none of the things looked for and stay as they are:
    # no more brackets than the depth allows, no exception, no internal or
    # sensitive key, no long text. What is told without a look at the text comes first.
    brackets = F.octet_length(context) - F.octet_length(
        F.replace(F.replace(context, F.lit("[")), F.lit("{"))
    )
    needed = F.octet_length(context) > HANDLER_TEXT if handler else F.lit(False)
    needed = needed | F.contains(context, F.lit("exception")) | F.contains(context, F.lit("\\u"))
    for prefix in prefixes:
        needed = needed | F.contains(context, F.lit('"' + prefix))
    for key in keys or ():
        needed = needed | F.contains(F.lower(context), F.lit(key))
    return _apply(clean, context, needed | (brackets > depth + 1))
