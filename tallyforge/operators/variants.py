"""JSON whose keys nobody declared, and nested values against a declared schema (survey rows P8, B3). Both work on VARIANT, which Spark reads once."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import let
from tallyforge.operators.validate import coerced_once

Path = tuple[str, ...]
#: Names of column types by those of values; a list, and what has several types, is text.
_TYPES = {"BIGINT": "bigint", "DOUBLE": "double", "DECIMAL": "double", "BOOLEAN": "boolean"}


def schema_tree(text: str, at: int = 0) -> tuple[Any, int]:
    """The schema of a variant as nested dicts of type names, and where it ends."""
    if not text.startswith("OBJECT<", at):
        if text.startswith("ARRAY<", at):
            return "ARRAY", schema_tree(text, at + 6)[1] + 1
        word = re.compile(r"([A-Z_]+)(?:\([\d, ]+\))?").match(text, at)
        return word[1], word.end()
    out, at = {}, at + 7
    while text[at] != ">":
        if text[at] == "`":
            name = re.compile(r"`((?:[^`]|``)*)`").match(text, at)
            key, at = name[1].replace("``", "`"), name.end()
        else:
            end = text.index(":", at)
            key, at = text[at:end], end
        out[key], at = schema_tree(text, at + 2)
        at += 2 if text[at] == "," else 0
    return out, at + 1


def at_path(v: Column, path: Path) -> Column:
    """What a variant holds at a path of keys, whatever characters they have."""
    for key in path:
        if "'" not in key and "\\" not in key:
            v = F.try_variant_get(v, f"$['{key}']", "variant")
        else:
            v = F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(key))
    return v


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT<"), F.lit(False))


def leaf_paths(rows: DataFrame, v: Column) -> dict[Path, str]:
    """Paths of all that is no object in ``v`` over all rows, with the type that fits everywhere (VARIANT: several).

    Schemas are merged by the rows' own aggregate, so the driver gets the merged one alone. Where a path is an object in some rows
    and none in others, the objects are merged in a pass of their own.
    """
    found: dict[Path, str] = {}
    open_: list[Path] = [()]
    while open_:
        subs = {p: at_path(v, p) for p in open_}
        row = rows.agg(*(F.schema_of_variant_agg(F.when(is_object(s), s)).alias(f"s{k}") for k, s in enumerate(subs.values()))).first()
        mixed: list[Path] = []

        def walk(path: Path, tree: Any, into: list[Path]) -> None:
            if isinstance(tree, dict):
                for key, sub in tree.items():
                    walk((*path, key), sub, into)
            elif path:
                found[path] = tree
                if tree == "VARIANT":
                    into.append(path)

        for path, text in zip(subs, row, strict=True):
            tree = schema_tree(text)[0] if text else "VOID"
            if isinstance(tree, dict):
                walk(path, tree, mixed)
        open_ = mixed
    return found


def json_normalize(rows: DataFrame, column: str, keep: list[str], corrupt: str = "corrupt") -> DataFrame:
    """``keep`` and a column for each path of keys that any of ``rows`` has in its JSON ``column``, the keys joined by ``_``.

    Lists stay whole, as JSON; so do values of a path that has several types, as text. Paths that give one name share a column, the first in order that has a
    value; names that differ only by case get a number. Texts that are no JSON object stand in ``corrupt``; nulls don't.
    """
    v = F.try_parse_json(column)
    parsed = rows.select(*keep, column, F.when(is_object(v), v).alias("_v"))
    paths = leaf_paths(parsed, F.col("_v"))
    named: dict[str, list[Path]] = {}
    for path in sorted(paths):
        named.setdefault("_".join(path), []).append(path)
    taken = {c.lower() for c in [*keep, corrupt]}
    out = []
    for name, same in named.items():
        kinds = {_TYPES.get(paths[p], "string") for p in same}
        kind = kinds.pop() if len(kinds) == 1 else "string"
        values = []
        for p in same:
            x = at_path(F.col("_v"), p)
            values.append(F.try_variant_get(x, "$", kind) if kind != "string" else F.when(~is_object(x), F.coalesce(F.try_variant_get(x, "$", "string"), F.when(F.schema_of_variant(x) != "VOID", x.cast("string")))))
        number, own = 1, name
        while own.lower() in taken:
            number += 1
            own = f"{name}_{number}"
        taken.add(own.lower())
        out.append(F.coalesce(*values).alias(own))
    return parsed.select(*keep, *out, F.when(F.col("_v").isNull(), F.col(column)).alias(corrupt))


def _kind(s: Column) -> Column:
    """The type of a variant as warnings name it, by its schema."""
    return F.when(s.startswith("OBJECT<"), "object").when(s.startswith("ARRAY<"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s.isNull() | (s == "VOID"), "null").otherwise("number")


def _text(v: Column, there: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.when(there, v.cast("string")))


def nested(v: Column, spec: dict, path: Column) -> Column:
    """The variant ``v`` as ``spec`` declares it (``clean``), and its ``warnings``, each with the path of what it is about.

    ``spec``: type (string, number, boolean, array, object), name, items of an array, fields of an object; nested as deep as it is. Numbers, booleans and
    dates are coerced, and a warning tells where; what is no array is wrapped; items that should be objects and aren't are left out; a field that is missing is null.
    A value, its schema and what is made of its parts are each bound once, so the work grows with the values and not with the depth of ``spec``.
    """
    return let(v, lambda x: let(F.schema_of_variant(x), lambda s: _nested(x, s, spec, path)))


def _both(clean: Column, warnings: Column) -> Column:
    return F.struct(clean.alias("clean"), warnings.alias("warnings"))


def _nested(v: Column, s: Column, spec: dict, path: Column) -> Column:
    kind = spec.get("type", "string")
    none = F.array().cast("array<string>")
    say = lambda text: F.concat(path, F.lit(": "), text)
    there = F.coalesce(s != "VOID", F.lit(False))
    if kind == "object":
        names = [f["name"] for f in spec["fields"]]
        made = F.struct(*(nested(at_path(v, (f["name"],)), f, F.concat(path, F.lit("." + f["name"]))).alias(f"f{k}") for k, f in enumerate(spec["fields"])))
        fits = let(made, lambda m: _both(F.struct(*(m[f"f{k}"]["clean"].alias(n) for k, n in enumerate(names))), F.concat(*(m[f"f{k}"]["warnings"] for k in range(len(names))))))
        odd = F.when(there, F.array(say(F.concat(F.lit("expected object, got "), _kind(s)))))
        return let(F.when(s.startswith("OBJECT<"), fits), lambda m: _both(m["clean"], F.coalesce(m["warnings"], odd, none)))
    if kind == "array":
        items = spec.get("items", {})
        is_array = s.startswith("ARRAY<")
        whole = F.when(there, F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)))
        wanted = F.lit(items.get("type") != "object")
        each = F.transform(whole, lambda x, i: F.struct(nested(x, items, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))).alias("made"), (wanted | is_object(x)).alias("fits")))
        odd = F.when(there & ~is_array, F.array(say(F.concat(F.lit("expected array, got "), _kind(s)))))
        return let(each, lambda xs: _both(F.transform(F.filter(xs, lambda e: e["fits"]), lambda e: e["made"]["clean"]), F.concat(F.coalesce(odd, none), F.coalesce(F.flatten(F.transform(xs, lambda e: e["made"]["warnings"])), none))))

    def told(text: Column) -> Column:
        return let(coerced_once(text, spec.get("name", ""), kind), lambda c: marked(text, c["value"], c["changed"]))

    def marked(text: Column, value: Column, changed: Column) -> Column:
        odd = changed if kind == "string" else changed & (_kind(s) != kind)
        return _both(value, F.when(there & F.coalesce(odd, F.lit(False)), F.array(say(F.concat(F.lit("read "), F.lit(kind), F.lit(" from "), text)))).otherwise(none))

    return let(_text(v, there), told)


def validated_nested(rows: DataFrame, column: str, spec: dict, keep: list[str]) -> DataFrame:
    """``keep``, ``clean`` and ``warnings`` of the JSON in ``column`` against ``spec``; what is no JSON is a warning of its own."""
    v = rows.select(*keep, column, F.try_parse_json(column).alias("_v"))
    made = v.select(*keep, column, F.col("_v").isNull().alias("_none"), nested(F.col("_v"), spec, F.lit(spec.get("name", "$"))).alias("_made"))
    bad = F.when(F.col(column).isNotNull() & F.col("_none"), F.array(F.lit("not JSON"))).otherwise(F.array().cast("array<string>"))
    return made.select(*keep, F.col("_made.clean").alias("clean"), F.concat(bad, "_made.warnings").alias("warnings"))
