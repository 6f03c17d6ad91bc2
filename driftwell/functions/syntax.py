"""Documents without loss: a concrete syntax tree of YAML 1.2, and edits that are splices of the source text.

A node knows where its text stands, so an edit replaces, adds or removes the characters of one entry and no others. The
rules of scalars are those of YAML 1.2's core schema: ``0755`` is 755, ``0o755`` is 493; ``22:22``, ``1_000``, ``yes`` and
``2024-01-01`` are strings. Merge keys are read, unknown tags are those of the bare value, aliases are the node that they
name: an edit inside of one is made where the anchor stands. If an edit takes away an anchor that is still named, the
first alias left becomes the anchor.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
import yaml
from pyspark.sql import DataFrame, functions as F

from .dealing import spread

#: Scalars of the core schema of YAML 1.2, and the merge key.
CORE = [
    ("tag:yaml.org,2002:null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ("tag:yaml.org,2002:bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")),
    ("tag:yaml.org,2002:int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", list("-+0123456789")),
    ("tag:yaml.org,2002:float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", list("-+.0123456789")),
    ("tag:yaml.org,2002:merge", r"^<<$", ["<"]),
]
MERGE = "tag:yaml.org,2002:merge"
#: Texts that libyaml reads as PyYAML's own parser does, ten times as fast: printable ASCII in block style without explicit
#: keys, tags, directives and marks of documents; ``${{ }}`` and block scalars whose sign ends its line are among them.
ALIKE = re.compile(r"(?!.*(?:---|\.\.\.))(?:[ -~\n](?<![?!%|>{}\[\]])|\$\{\{[\w .()'-]*\}\}|[|>][-+]?(?=\n))*", re.S | re.A)


#: Of these texts PyYAML's composer might say more than libyaml's: anchors, aliases, and nesting that could be too deep.
APART = re.compile(r"[&*]|^[ -]{64}", re.M)


class Core(yaml.SafeLoader):
    """PyYAML's safe loader under the core schema of 1.2."""

    yaml_implicit_resolvers: dict = {}

    def whole(self, node: yaml.ScalarNode) -> int:
        text = self.construct_scalar(node)
        return int(text, 0) if text[:2] in ("0o", "0x") else int(text)

    def real(self, node: yaml.ScalarNode) -> float:
        text = self.construct_scalar(node).lower()
        return float(text.replace(".inf", "inf").replace(".nan", "nan"))

    def bare(self, node: yaml.Node) -> Any:
        if isinstance(node, yaml.MappingNode):
            return self.construct_mapping(node, deep=True)
        return self.construct_sequence(node, deep=True) if isinstance(node, yaml.SequenceNode) else self.construct_scalar(node)


class Unmerged(Core):
    """Leaves merge keys as they are: entries named ``<<``, so that what a base is given isn't copied."""

    def flatten_mapping(self, node: yaml.MappingNode) -> None:
        pass


class Plain(yaml.SafeDumper):
    """Writes strings in quotes that either version would take for something else."""

    def ignore_aliases(self, data: Any) -> bool:
        return True


class Name(yaml.SafeDumper):
    """Writes keys: quotes only where 1.2 needs them."""

    yaml_implicit_resolvers: dict = {}


for _tag, _form, _first in CORE:
    for _class in (Core, Plain, Name):
        _class.add_implicit_resolver(_tag, re.compile(_form), _first)
Core.add_constructor("tag:yaml.org,2002:int", Core.whole)
Core.add_constructor("tag:yaml.org,2002:float", Core.real)
Core.add_constructor(None, Core.bare)

if yaml.__with_libyaml__:

    class Quick(yaml.CSafeLoader):
        """Core's rules for nodes that libyaml puts together."""

        yaml_implicit_resolvers = Core.yaml_implicit_resolvers
        yaml_constructors = Core.yaml_constructors


@dataclass(slots=True, eq=False)
class Node:
    """A value, key or alias; ``start`` and ``end`` bound its text, with its tag and anchor, without what follows."""

    kind: str  # map, list, scalar, alias
    start: int
    end: int
    column: int
    flow: bool = False
    style: str = ""
    tag: str | None = None
    anchor: str | None = None
    text: str = ""  # of a scalar; the name of an alias
    implied: bool = False  # a plain scalar, whose type its text tells
    target: Node | None = None  # of an alias
    entries: list[tuple[Node, Node]] = field(default_factory=list)
    items: list[Node] = field(default_factory=list)

    def real(self) -> Node:
        return self.target if self.target is not None else self

    def below(self) -> Iterator[Node]:
        """The node and all in it, in order; aliases aren't followed."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += reversed([x for e in node.entries for x in e] + node.items)


def events_of(text: str) -> list[yaml.Event]:
    """The events of a stream; raises what PyYAML raises."""
    if yaml.__with_libyaml__ and ALIKE.fullmatch(text):
        try:
            return list(yaml.parse(text, Loader=yaml.CSafeLoader))
        except yaml.YAMLError:
            pass  # what PyYAML says of it holds
    return list(yaml.parse(text, Loader=Core))


class Parsed:
    """A text parsed once: its trees and its values come of the same events. Raises what PyYAML raises."""

    def __init__(self, text: str) -> None:
        self.text, self.events = text, events_of(text)

    @functools.cached_property
    def roots(self) -> list[Node | None]:
        return trees_of(self.events)

    def values(self, loader: type = Core) -> list[Any]:
        """The documents' values, made anew at every call; raises ValueError or what PyYAML raises."""
        if "*" in self.text and any(recursive(r) for r in self.roots):
            raise ValueError("an alias within its own anchor")
        maker, found = loader(""), []
        maker.state = functools.partial(next, iter(self.events), None)
        while maker.check_data():
            found.append(maker.get_data())
        return found or [None]


def read(text: str) -> list[Node | None]:
    """The root of each document of a stream; an empty document has none. Raises what PyYAML raises."""
    return Parsed(text).roots


def trees_of(events: list[yaml.Event]) -> list[Node | None]:
    roots: list[Node | None] = []
    stack: list[tuple[Node, list[Node]]] = []
    anchors: dict[str, Node] = {}

    def put(node: Node) -> None:
        if node.anchor:
            anchors[node.anchor] = node
        if stack:
            stack[-1][1].append(node)
        else:
            roots[-1] = node

    for e in events:
        if isinstance(e, yaml.DocumentStartEvent):
            roots.append(None)
            anchors = {}
        elif isinstance(e, yaml.AliasEvent):
            put(Node("alias", e.start_mark.index, e.end_mark.index, e.start_mark.column, text=e.anchor, target=anchors[e.anchor]))
        elif isinstance(e, yaml.ScalarEvent):
            put(Node("scalar", e.start_mark.index, e.end_mark.index, e.start_mark.column, style=e.style or "", tag=e.tag, anchor=e.anchor, text=e.value, implied=e.implicit[0] and not e.style))
        elif isinstance(e, (yaml.MappingStartEvent, yaml.SequenceStartEvent)):
            kind = "map" if isinstance(e, yaml.MappingStartEvent) else "list"
            node = Node(kind, e.start_mark.index, e.end_mark.index, e.start_mark.column, flow=bool(e.flow_style), tag=e.tag, anchor=e.anchor)
            put(node)
            stack.append((node, []))
        elif isinstance(e, (yaml.MappingEndEvent, yaml.SequenceEndEvent)):
            node, inner = stack.pop()
            if node.kind == "map":
                node.entries = list(zip(inner[::2], inner[1::2]))
            else:
                node.items = inner
            # a block ends with its last leaf: its own end mark lies behind the comments that follow
            node.end = e.end_mark.index if node.flow or not inner else inner[-1].end
            if node.kind == "map" and node.entries:
                node.column = node.entries[0][0].column
    return roots


def recursive(root: Node | None) -> bool:
    """Whether an alias stands within what it names."""
    return root is not None and any(x.kind == "alias" and x.target is not None and x.target.start < x.start < x.target.end for x in root.below())


def load(text: str | None, loader: type = Core) -> list[Any]:
    """The values of a stream's documents; raises ValueError or what PyYAML raises."""
    text = text or ""
    if loader is Core and yaml.__with_libyaml__ and ALIKE.fullmatch(text) and not APART.search(text):
        try:
            return list(yaml.load_all(text, Loader=Quick)) or [None]
        except yaml.YAMLError:
            pass  # what PyYAML says of it holds
    return Parsed(text).values(loader)


def key_text(key: Node) -> str | None:
    """A key as segments name it; None for keys that are no scalars."""
    key = key.real()
    if key.kind != "scalar":
        return None
    if not key.implied:
        return key.text
    value = yaml.load(key.text, Loader=Core) if any(re.match(form, key.text) for tag, form, _ in CORE if tag != MERGE) else key.text
    return str(value)


def entry_of(node: Node, name: str) -> tuple[Node, Node] | None:
    """The entry of a mapping itself; of equal keys the last."""
    return next((e for e in reversed(node.entries) if key_text(e[0]) == name and not is_merge(e[0])), None)


def is_merge(key: Node) -> bool:
    return key.kind == "scalar" and (key.implied and key.text == "<<" or key.tag == MERGE)


def merged(node: Node, name: str) -> tuple[Node, Node] | None:
    """The entry that a mapping has by a merge key."""
    for key, value in node.entries:
        if is_merge(key):
            for base in [value.real()] if value.real().kind == "map" else [x.real() for x in value.real().items]:
                if found := entry_of(base, name) or merged(base, name):
                    return found
    return None


def locate(root: Node | None, path: list[str]) -> Node | None:
    """The node at a path: keys, and places of lists as ``[n]``."""
    node = root
    for segment in path:
        if node is None:
            return None
        node = node.real()
        if node.kind == "list":
            n = int(segment[1:-1]) if re.fullmatch(r"\[\d+\]", segment) else len(node.items)
            node = node.items[n] if n < len(node.items) else None
        elif node.kind == "map":
            found = entry_of(node, segment) or merged(node, segment)
            node = found[1] if found else None
        else:
            return None
    return node.real() if node is not None else None


# ---- splices

Splice = tuple[int, int, str]


def flow(value: Any) -> str:
    """A value on one line, as it may stand within brackets."""
    return yaml.dump([value], Dumper=Plain, default_flow_style=True, sort_keys=False, width=10**9, allow_unicode=True).strip()[1:-1]


def name_text(key: str) -> str:
    """A key as it is written: a string under 1.2."""
    style = '"' if "\n" in key else None
    return yaml.dump(key, Dumper=Name, default_flow_style=True, default_style=style, width=10**9, allow_unicode=True).removesuffix("\n").removesuffix("\n...")


def block(value: Any, column: int, note: str = "", comment: str = "") -> str:
    """What stands after a key and its colon: a value on the line, or a block below it, indented by two more."""
    if isinstance(value, (dict, list)) and value:
        text = yaml.dump(value, Dumper=Plain, sort_keys=False, allow_unicode=True, width=10**9)
        return comment + "".join(f"\n{' ' * (column + 2)}{line}" if line else "\n" for line in text.splitlines())
    style = '"' if isinstance(value, str) and "\n" in value else None
    plain = yaml.dump(value, Dumper=Plain, default_flow_style=True, default_style=style, width=10**9, allow_unicode=True).removesuffix("\n").removesuffix("\n...")
    return f" {plain}{f' # {note}' if note else comment}"


def _line_end(text: str, at: int) -> int:
    end = text.find("\n", at)
    return len(text) if end < 0 else end


def _bare_end(text: str, node: Node, least: int) -> int:
    """Where a node's text ends, without the line ends of a block scalar."""
    return max(len(text[: node.end].rstrip()), least)


def _colon(text: str, key: Node) -> int:
    return text.index(":", key.end) + 1


def set_entry(text: str, node: Node, key: str, value: Any, note: str | None) -> list[Splice] | None:
    """Splices that give a mapping's entry a value; None where the mapping's form isn't one that is known."""
    there = entry_of(node, key)
    if node.flow:
        if there is not None:
            if there[1].start == there[1].end:
                return [(there[0].end, max(there[1].end, there[0].end), f": {flow(value)}")]
            return [(there[1].start, there[1].end, flow(value))]
        added = f"{flow({key: value})[1:-1]}"
        if not node.entries:
            inside = text.rindex("{", node.start, node.end) + 1
            return [(inside, inside, added)]
        end = max(node.entries[-1][1].end, node.entries[-1][0].end)
        return [(end, end, f", {added}")]
    if not node.entries:
        return None
    if there is None:  # it goes below the first entry, where a mapping's column is sure and no comment of its end is near
        first_key, first = node.entries[0]
        keeps = any(x.style in ("|", ">") and x.end == first.end for x in first.below())
        at = first.end if keeps and text[first.end - 1 : first.end] == "\n" else _line_end(text, _bare_end(text, first, first_key.end))
        new = f"{' ' * node.column}{name_text(key)}:{block(value, node.column, note or '')}"
        if at and text[at - 1] == "\n":
            return [(at, at, f"{new}\n")]
        return [(at, at, f"\n{new}" if at < len(text) else f"\n{new}\n")]
    name, old = there
    if text[name.start - 1 : name.start] == "?" or text[:name.start].rstrip(" ").endswith("?") and ":" not in text[name.end : _line_end(text, name.end)]:
        return [(old.start, old.end, flow(value))]
    colon = _colon(text, name)
    end = _bare_end(text, old, colon)
    after = text[end : _line_end(text, end)] if "\n" not in text[colon:end] else ""
    beside = after if after.strip().startswith("#") else ""
    if not beside and "\n" in text[colon:end]:  # a block: its key's own line may have a comment
        head = text[colon : _line_end(text, colon)]
        beside = head if head.strip().startswith("#") else ""
    return [(colon, end + (len(after) if after and beside else 0), block(value, name.column, note or "", beside))]


def remove_entry(text: str, node: Node, key: str, parent_key_end: int | None) -> list[Splice] | None:
    there = next((i for i, (k, _) in enumerate(node.entries) if not is_merge(k) and key_text(k) == key), None)
    if there is None:
        return []
    name, old = node.entries[there]
    if node.flow:
        end = max(old.end, name.end)
        if there + 1 < len(node.entries):
            return [(name.start, node.entries[there + 1][0].start, "")]
        if there:
            before = node.entries[there - 1]
            return [(max(before[1].end, before[0].end), end, "")]
        comma = re.match(r"\s*,", text[end : node.end])
        return [(name.start, end + (comma.end() if comma else 0), "")]
    if len(node.entries) == 1:  # the block goes, an empty mapping stays
        end = _bare_end(text, node, name.end)
        properties = text[node.start : name.start].strip() if node.start < name.start else ""
        if parent_key_end is None:
            return [(name.start, end, "{}")]
        head = text[parent_key_end : _line_end(text, parent_key_end)]
        if node.start < name.start and node.start < _line_end(text, parent_key_end):
            return [(node.start, end, f"{properties} {{}}")]
        if not head.strip() or head.strip().startswith("#"):
            return [(parent_key_end, parent_key_end, " {}"), (_line_end(text, parent_key_end), end, "")]
        return [(name.start, end, "{}")]
    start, end = name.start, _bare_end(text, old, _colon(text, name))
    if any(x.style in ("|", ">") and x.end == old.end for x in old.below()) and text[old.end - 1 : old.end] == "\n":
        end = old.end - 1
    if not text[start - name.column : start].strip():
        return [(start - name.column, min(_line_end(text, end) + 1, len(text)), "")]
    # it shares its line with what it stands in, as in ``- key: value``
    return [(start, node.entries[there + 1][0].start, "")] if there + 1 < len(node.entries) else None


def written_out(text: str, node: Node, tree: dict, names: list[str]) -> list[Splice] | None:
    """A mapping's merge keys replaced by the entries that they give; ``tree`` holds the values to be, ``names`` what stays."""
    own = {key_text(k) for k, _ in node.entries}
    given = {k: v for k, v in tree.items() if str(k) in names and str(k) not in own}
    out: list[Splice] = []
    for key, value in node.entries:
        if not is_merge(key):
            continue
        end = _bare_end(text, value, key.end)
        if node.flow:
            out.append((key.start, end, flow(given)[1:-1] if given else "{}: "))
            if not given:
                return None
        else:
            lines = f"\n{' ' * node.column}".join(f"{name_text(k) if isinstance(k, str) else flow(k)}: {flow(v)}" for k, v in given.items())
            if not lines:
                return None
            out.append((key.start, end, lines))
        given = {}
    return out


def anchors_kept(text: str, root: Node, gone: list[tuple[int, int]], value_of: Callable[[Node], Any]) -> list[Splice]:
    """Where the text of an anchor goes while aliases of it stay: the first of those becomes the anchor."""
    inside = lambda n: any(a <= n.start and n.end <= b and n.start < b for a, b in gone)
    out, moved = [], set()
    for alias in root.below():
        anchor = alias.target
        if alias.kind != "alias" or anchor is None or inside(alias) or not inside(anchor) or id(anchor) in moved:
            continue
        moved.add(id(anchor))
        source = text[anchor.start : anchor.end]
        whole = "\n" not in source and (anchor.flow or anchor.kind == "scalar")
        out.append((alias.start, alias.end, source if whole else f"&{anchor.anchor} {flow(value_of(anchor))}"))
    return out


def spliced(text: str, splices: list[Splice]) -> str:
    for start, end, new in sorted(splices, reverse=True):
        text = text[:start] + new + text[end:]
    return text


# ---- as a table

TOKEN = "document int, ordinal int, parent int, path array<string>, role string, kind string, style string, tag string, anchor string, alias string, value string, start long, end long, line int, column int"


def tokens(text: str) -> Iterator[tuple]:
    """TOKEN of every key and value of a stream, in the order of the text."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    for d, root in enumerate(read(text)):
        todo: list[tuple[Node, int | None, list[str], str]] = [(root, None, [], "value")] if root is not None else []
        n = 0
        while todo:
            node, parent, path, role = todo.pop()
            line = bisect.bisect_right(starts, node.start) - 1
            alias = node.text if node.kind == "alias" else None
            style = "flow" if node.flow else "block" if node.kind in ("map", "list") else node.style
            yield d, n, parent, path, role, node.kind, style, node.tag, node.anchor, alias, node.text if node.kind == "scalar" else None, node.start, node.end, line, node.start - starts[line]
            below: list[tuple[Node, int | None, list[str], str]] = []
            for key, value in node.entries:
                at = [*path, key_text(key) or text[key.start : key.end]]
                below += [(key, n, at, "key"), (value, n, at, "value")]
            below += [(item, n, [*path, f"[{i}]"], "value") for i, item in enumerate(node.items)]
            todo += reversed(below)
            n += 1


def document_tokens(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, TOKEN) of every document: the concrete syntax tree as rows. Texts that aren't YAML have none.

    Positions count characters from 0. What lies between tokens (comments, white space, marks) is the text between them.
    """
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keys)
    columns = [*keys, *[c.split()[0] for c in TOKEN.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for *key, body in batch[[*keys, "_text"]].itertuples(index=False, name=None):
                try:
                    rows += [(*key, *t) for t in tokens(body or "")]
                except (yaml.YAMLError, ValueError, RecursionError, KeyError):
                    continue
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=columns).astype({"parent": "Int32"})
                    rows = []
            yield pd.DataFrame(rows, columns=columns).astype({"parent": "Int32"})

    return spread(docs.select(*keys, F.col(text).cast("string").alias("_text"))).mapInPandas(run, f"{schema}, {TOKEN}")
