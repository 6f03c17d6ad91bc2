"""Documents as rows: YAML parsed row by row, and written back. The rest of the patch work is relational.

Two dialects: ``1.1``, where ``on`` and ``yes`` are booleans, as the miner reads documents, and ``1.2`` (its core schema,
see ``syntax``), as patches do.

A node has its segments (mapping keys as they are; list elements as ``[identity~n]``, n counting equal identities
before it), its route (list positions in brackets), its kind and its value as JSON. Elements of ``steps`` are
identified by id, action (up to the first @), name, or that they run something; other mappings by id, name or key,
else by position; scalars by their value. Documents that can't be parsed have no nodes; neither do empty lists and
mappings below the root count as leaves.
"""

from __future__ import annotations

import functools
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from typing import Any

import pandas as pd
import yaml
from pyspark.sql import DataFrame, functions as F

from . import syntax
from .dealing import spread

NODE = "ordinal int, segments array<string>, path array<string>, route string, kind string, value string, eq string"


def parse(text: str | None, dialect: str = "1.2", document: int | None = None) -> Any:
    """The value of a document, None if it can't be read; of a stream of several only where one is asked for."""
    try:
        if dialect == "1.1":
            return yaml.load(text or "", Loader=yaml.SafeLoader)
        found = syntax.load(text)
        return found[document or 0] if document is not None or len(found) == 1 else None
    except (yaml.YAMLError, ValueError, RecursionError, KeyError, IndexError):
        return None


def identity(element: Any, position: int, in_steps: bool) -> str:
    if not isinstance(element, dict):
        return f"'{element}'" if isinstance(element, str) else f"#{position}" if isinstance(element, list) else repr(element)
    given = {k: v for k, v in element.items() if isinstance(v, str) and v}
    if not in_steps:
        return next((f"{k}={given[k]}" for k in ("id", "name", "key") if k in given), f"#{position}")
    if "id" not in given and "uses" in given:
        return f"uses={given['uses'].split('@')[0]}"
    return next((f"{k}={given[k]}" for k in ("id", "name") if k in given), "run" if "run" in element else "anon")


def kind_of(value: Any) -> str:
    names = {dict: "map", list: "list", bool: "bool", int: "int", float: "float", str: "str", type(None): "null"}
    return names.get(type(value), "str")


def equality_key(value: Any) -> str:
    """Equal for values that are equal: 1, 1.0 and true are."""
    return f"n{float(value)!r}" if isinstance(value, (bool, int, float)) else f"{kind_of(value)} {value}"


def walk(tree: Any) -> Iterator[tuple[list[str], list[str], str, Any]]:
    """(segments, path, route, value) of every node, parents first; a path names list elements by place."""
    todo: list[tuple[list[str], list[str], str, Any]] = [([], [], "", tree)]
    while todo:
        segments, path, route, value = todo.pop()
        yield segments, path, route, value
        below = []
        if isinstance(value, dict):
            below = [([*segments, str(k)], [*path, str(k)], f"{route}.{k}" if route else str(k), v) for k, v in value.items()]
        elif isinstance(value, list):
            seen: Counter = Counter()
            for i, v in enumerate(value):
                name = identity(v, i, bool(segments) and segments[-1] == "steps")
                below.append(([*segments, f"[{name}~{seen[name]}]"], [*path, f"[{i}]"], f"{route}[{i}]", v))
                seen[name] += 1
        todo += reversed(below)


#: Made once: json.dumps would make an encoder for every value.
_json = json.JSONEncoder(default=str, ensure_ascii=False).encode


def node_rows(text: str | None, dialect: str, document: int | None) -> list[tuple]:
    """NODE of a document."""
    tree = parse(text, dialect, document)
    if tree is None:
        return []
    return [
        (n, segments, path, route, kind_of(value), _json(value), None if isinstance(value, (dict, list)) else equality_key(value))
        for n, (segments, path, route, value) in enumerate(walk(tree))
    ]


#: Texts up to so many characters are kept with their nodes while a worker lives: copies of a file are parsed once.
KEPT_CHARS = 4096


@functools.lru_cache(maxsize=1024)
def kept_rows(text: str | None, dialect: str, document: int | None) -> list[tuple]:
    return node_rows(text, dialect, document)


def document_nodes(docs: DataFrame, keys: list[str], text: str = "text", dialect: str = "1.2", document: int | None = None) -> DataFrame:
    """(keys, NODE) of every document, its root first (ordinal 0); of streams of several documents that asked for."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keys)

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *key, body in batch[[*keys, "_text"]].itertuples(index=False, name=None):
                found = (kept_rows if len(body or "") <= KEPT_CHARS else node_rows)(body, dialect, document)
                rows += [(*key, *node) for node in found]
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=[*keys, *[c.split()[0] for c in NODE.split(", ")]])
                    rows = []
            yield pd.DataFrame(rows, columns=[*keys, *[c.split()[0] for c in NODE.split(", ")]])

    return spread(docs.select(*keys, F.col(text).cast("string").alias("_text"))).mapInPandas(nodes, f"{schema}, {NODE}")


def _place(tree: Any, path: list[str], make: bool) -> Any:
    """The node at a path; missing mapping keys at its end are made if asked for, else None."""
    for segment in path:
        if isinstance(tree, list):
            at = int(segment[1:-1]) if re.fullmatch(r"\[\d+\]", segment) else len(tree)
            if at >= len(tree):
                return None
            tree = tree[at]
            continue
        if not isinstance(tree, dict):
            return None
        there, key = _key(tree, segment)
        base = tree if there else _base(tree, segment)
        if base is None:
            if not make:
                return None
            base = tree
            base[key] = {}
        tree = base[_key(base, segment)[1]]
    return tree


def _key(tree: dict, name: str) -> tuple[bool, Any]:
    """Whether a mapping has a key of a name, and the key: keys that are no strings are named by their text."""
    if name in tree:
        return True, name
    found = [k for k in tree if not isinstance(k, str) and str(k) == name]
    return (True, found[0]) if found else (False, name)


def _base(tree: dict, name: str) -> dict | None:
    """The mapping that gives a key by a merge."""
    given = tree.get("<<")
    for base in given if isinstance(given, list) else [given]:
        if isinstance(base, dict):
            found = base if _key(base, name)[0] else _base(base, name)
            if found is not None:
                return found
    return None


def _canon(value: Any) -> Any:
    """Equal only for values alike in type, too."""
    if isinstance(value, dict):
        return ("map", frozenset((repr(k), _canon(v)) for k, v in value.items()))
    return ("list", tuple(map(_canon, value))) if isinstance(value, list) else (type(value).__name__, repr(value))


def _splices(parsed: syntax.Parsed, path: list[str], op: str, key: str, value: Any, note: str | None, want: list[Any], document: int) -> list[syntax.Splice] | None:
    """What to replace in the text for an operation; None where its form isn't known."""
    text, root = parsed.text, parsed.roots[document]
    at = len(path)
    while op == "set" and at and syntax.locate(root, path[:at]) is None:
        at -= 1  # the containers in between are made as well
    for name in [*reversed(path[at:])]:
        value, key = {key: value}, name
    node = syntax.locate(root, path[:at])
    if node is None or root is None or node.kind != "map":
        return None
    if op == "set":
        out = syntax.set_entry(text, node, key, value, note)
    else:
        above = next((k for n in root.below() for k, v in n.entries if v is node), None)
        out = syntax.remove_entry(text, node, key, syntax._colon(text, above) if above is not None and not node.flow else None)
        if out is not None and syntax.merged(node, key):
            place = _place(want[document], path, False)
            more = syntax.written_out(text, node, place, [str(k) for k in place])
            out = None if more is None else [*out, *more]
    if not out:
        return out

    def value_of(anchor: syntax.Node) -> Any:
        if anchor.flow or anchor.kind == "scalar":
            return yaml.load(text[anchor.start : anchor.end], Loader=syntax.Core)
        path_of = _path_to(root, anchor)
        return _place(parsed.values()[document], path_of, False) if path_of is not None else None

    gone = [(a, b) for a, b, _ in out if b > a]
    return [*out, *syntax.anchors_kept(text, root, gone, value_of)]


def _path_to(root: syntax.Node, wanted: syntax.Node) -> list[str] | None:
    todo: list[tuple[syntax.Node, list[str]]] = [(root, [])]
    while todo:
        node, path = todo.pop()
        if node is wanted:
            return path
        todo += [(v, [*path, syntax.key_text(k) or ""]) for k, v in node.entries] + [(v, [*path, f"[{i}]"]) for i, v in enumerate(node.items)]
    return None


def rewrite(text: str, operations: Iterable[tuple[Sequence[str], str, str, str | None, str | None]], document: int | None = None) -> str:
    """The text with operations (path, op set or remove, key, value as JSON, note) done one after the other.

    Only the characters of the edited entry change. What an edit gives is read again; if that isn't the tree asked for,
    the mapping that holds the entry is written anew on one line, and if that isn't it either, the text stays.
    """
    n, parsed, held = document or 0, None, (None, [])
    for place_of, op, key, value, note in operations:
        path = list(place_of)
        try:
            parsed = parsed or syntax.Parsed(text)
            roots = parsed.roots
            if n >= len(roots) or document is None and len(roots) > 1:
                return text
            node = syntax.locate(roots[n], path)
            # merge keys stay as they are, unless an entry that one gives is to go
            loader = syntax.Core if op == "remove" and node is not None and node.kind == "map" and syntax.merged(node, key) else syntax.Unmerged
            want, held = held[1] if held[0] is loader else parsed.values(loader), (None, [])
        except (yaml.YAMLError, ValueError, RecursionError, KeyError):
            return text
        new = None if value is None else json.loads(value)
        place = _place(want[n], path, op == "set")
        if not isinstance(place, dict):
            continue
        there, known = _key(place, key)
        if op == "set":
            place[known] = new
        elif there:
            del place[known]
        else:
            continue
        splices = _splices(parsed, path, op, key, new, note, want, n)
        for edit in (splices, None):
            if edit is None:
                if node is None:
                    break
                edit = [(node.start, max(node.start, len(text[: node.end].rstrip())), (f"&{node.anchor} " if node.anchor else "") + syntax.flow(place))]
            edited = syntax.spliced(text, edit)
            try:
                found = syntax.Parsed(edited)
                values = found.values(loader)
                if _canon(values) == _canon(want):
                    text, parsed, held = edited, found, (loader, values)  # the next operation begins with what was read here
                    break
            except (yaml.YAMLError, ValueError, RecursionError, KeyError):
                pass
    return text


@functools.lru_cache(maxsize=1024)
def kept_rewrite(text: str, operations: tuple) -> str:
    """``rewrite`` of texts up to KEPT_CHARS: what many targets have alike is done once while a worker lives."""
    return rewrite(text, operations)
