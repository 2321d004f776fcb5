"""The path language of JSON rules.

``a.b`` steps into objects; ``a[]`` takes a list and maps the rest of the path over it (nested lists stay
nested); ``a[2]`` and a step of digits index; a step without digits on a list maps over it. A list element
without the key gives null in its place; a missing step gives null; ``x[]`` of no list gives an empty list.

A path is compiled once to a function on parsed values. :func:`values` evaluates many paths over a JSON column
in one Arrow pass, giving JSON text; :func:`scalar` is the JVM form for paths that only step into objects and
fixed positions, which Catalyst can push through its own JSON reader.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INDEX = re.compile(r"^(.*?)\[(-?\d+)\]$")
Step = Callable[[object], object]


def _get(value: object, key: str) -> object:
    if isinstance(value, list):
        if key.isdigit():
            return value[int(key)] if int(key) < len(value) else None
        return [_get(x, key) for x in value]
    return value.get(key) if isinstance(value, dict) else None


def _at(value: object, index: int) -> object:
    return value[index] if isinstance(value, list) and -len(value) <= index < len(value) else None


@lru_cache(maxsize=1024)
def compile_path(path: str | None) -> Step:
    """The function of a path; the empty path and ``$`` give the value itself."""
    steps = [s for s in (path or "").strip().replace("$.", "").split(".") if s not in ("", "$")]

    def build(rest: list[str]) -> Step:
        if not rest:
            return lambda v: v
        head, tail = rest[0], build(rest[1:])
        if head.endswith("[]"):
            name, last = head[:-2], len(rest) == 1

            def spread(v: object) -> object:
                found = _get(v, name) if name else v
                if not isinstance(found, list):
                    return []
                return found if last else [tail(x) for x in found]

            return spread
        if m := _INDEX.match(head):
            name, index = m[1], int(m[2])
            return lambda v: tail(_at(_get(v, name) if name else v, index))

        def step(v: object) -> object:
            if isinstance(v, list) and not head.isdigit():
                return [step(x) for x in v]
            return tail(_get(v, head))

        return step

    return build(steps)


def evaluate(value: object, path: str | None) -> object:
    """The value of a path in a parsed document."""
    return compile_path(path)(value)


def is_scalar(path: str) -> bool:
    """Whether :func:`scalar` has the path's meaning on documents whose steps are objects."""
    return "[]" not in path and not any(s.isdigit() for s in path.split("."))


def scalar(document: Column, path: str) -> Column:
    """Text at a path of object steps and fixed indexes; objects and lists as JSON text, absent as null."""
    clean = re.sub(r"^\$\.?", "", path)
    return F.get_json_object(document, "$" + "".join(f"['{n}']{i}" for n, i in re.findall(r"([^.\[\]]+)((?:\[\d+\])*)", clean)))


def _listed(value: object) -> list[str]:
    """A value as the texts of a list: texts as they are, the rest as JSON, nulls left out."""
    items = value if isinstance(value, list) else [value]
    return [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in items if x is not None]


def _child_step(path: str, rules: dict) -> Step:
    """The function of a path with child rules ``{name: path or (path, rules)}``: a list of objects of lists of texts."""
    own = compile_path(path)
    steps = {n: _child_step(*r) if isinstance(r, tuple) else (lambda v, f=compile_path(r): _listed(f(v))) for n, r in rules.items()}

    def step(value: object) -> list | None:
        found = own(value)
        if found is None:
            return None
        return [{n: f(x) or [] for n, f in steps.items()} for x in (found if isinstance(found, list) else [found])]

    return step


def values(df: DataFrame, keep: list[str], document: str, paths: dict) -> DataFrame:
    """``keep…, <name> string…``: every path as JSON text (null if absent or unreadable), one parse a row. A path may be
    a pair of a path and child rules (see :func:`_child_step`)."""
    ddl = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep] + [f"`{n}` string" for n in paths])
    steps = {n: _child_step(*p) if isinstance(p, tuple) else compile_path(p) for n, p in paths.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in steps}
            for text in batch.column(len(keep)).to_pylist():
                try:
                    value = json.loads(text) if text else None
                except ValueError:
                    value = None
                for n, step in steps.items():
                    x = step(value)
                    out[n].append(None if x is None else json.dumps(x, ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(v, pa.string()) for v in out.values()]], [*keep, *out])

    return df.select(*keep, document).mapInArrow(run, ddl)


def items(df: DataFrame, keep: list[str], document: str, path: str) -> DataFrame:
    """``keep…, item_pos, item``: one row per element of the list at a path (one for a single value, none for
    null), the element as JSON text."""
    found = values(df, keep, document, {"item": path}).where("item is not null")
    listed = F.from_json("item", "array<string>")
    one = F.when(F.substring("item", 1, 1) == "[", listed).otherwise(F.array("item"))
    return found.select(*keep, F.posexplode(one).alias("item_pos", "item"))
