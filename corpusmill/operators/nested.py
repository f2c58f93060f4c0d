"""Deeply nested semi-structured records -> related flat tables with parent links (shared inlining).

Two distributed passes over the same JSON text columns:

1. ``schema_edges`` walks every record and reduces it to the distinct edges of the schema graph (root,
   element, child, form). Its size is that of the schema, not of the data; ``analyse`` refuses more than
   ``max_edges``.
2. ``shred`` emits rows by the plan that the graph gives. An element has a table of its own if it is a root,
   repeated, shared by several parents or recursive; a singleton descendant is inlined into its owner as a
   dotted attribute. An element whose objects are those of a root (it recurs, or is a list, and most of its
   attributes mark the root) is that root again, under whatever key and object it stands: this is how the
   children of declarations are found. ``related`` gives one typed table an element, with foreign keys.

Defined results: null, blank or cut-off JSON text gives no rows for that column; a JSON null takes no
position; a lone value counts as a list of one; an object keyed by position, a wrapper that holds the
siblings, lists of lists and a JSON text inside a string all count as the list they stand for. Records of
any depth are read. Of a record delivered again the latest delivery counts. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from json.decoder import scanstring

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.arrow import map_columns, map_rows
from corpusmill.operators import files as K

_NODE = "array<struct<element:string,node_path:string,parent_path:string,parent_element:string,ord:int,attributes:array<struct<key:string,value:string>>>>"
_FOUND = "array<struct<node_kind:string,node_path:string,parent_path:string>>"


@dataclass(frozen=True)
class Root:
    """One JSON column: its element name and the attributes that mark an object of it."""

    column: str
    element: str
    marks: frozenset[str]
    scalars: bool = False  # whether a bare scalar is an entry


DECLARATIONS = Root("declarations", "declaration", frozenset({"kind", "name", "start_line", "end_line", "signature", "docstring", "modifiers"}))
IMPORTS = Root("imports", "import", frozenset({"module", "names", "alias", "name", "path"}), scalars=True)
ROOTS = (DECLARATIONS, IMPORTS)

_SPACE = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")
_ATOMS = {"true": True, "false": False, "null": None}


def parse_json(text: str):
    """The value of a JSON text of any depth; ValueError if it is none. Keeps its own stack where the library's runs out."""
    try:
        return json.loads(text)
    except RecursionError:
        pass
    at = _SPACE.match(text).end()
    stack: list[tuple[list | dict, str | None]] = []  # open containers with the key that waits for a value
    value, have = None, False
    n = len(text)
    while True:
        if not have:
            c = text[at : at + 1]
            if c in "{[" and c:
                at = _SPACE.match(text, at + 1).end()
                box: list | dict = {} if c == "{" else []
                if text[at : at + 1] == ("}" if c == "{" else "]"):
                    value, have, at = box, True, at + 1
                    continue
                stack.append((box, None))
            elif c == '"':
                value, at = scanstring(text, at + 1, True)
                have = True
            elif m := _ATOM.match(text, at):
                value, have, at = _ATOMS[m[0]] if m[0] in _ATOMS else float(m[0]) if re.search(r"[.eE]", m[0]) else int(m[0]), True, m.end()
            else:
                raise ValueError(f"no value at {at}")
        if have:
            if not stack:
                if _SPACE.match(text, at).end() != n:
                    raise ValueError("extra data")
                return value
            box, key = stack[-1]
            if isinstance(box, list):
                box.append(value)
            else:
                box[key] = value
            have = False
            at = _SPACE.match(text, at).end()
            c = text[at : at + 1]
            if c == ",":
                at = _SPACE.match(text, at + 1).end()
                if isinstance(box, list):
                    continue
            elif c == ("]" if isinstance(box, list) else "}"):
                stack.pop()
                value, have, at = box, True, at + 1
                continue
            else:
                raise ValueError(f"no separator at {at}")
        box = stack[-1][0]
        if isinstance(box, dict):
            if text[at : at + 1] != '"':
                raise ValueError(f"no key at {at}")
            key, at = scanstring(text, at + 1, True)
            at = _SPACE.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError(f"no colon at {at}")
            stack[-1] = (box, key)
            at = _SPACE.match(text, at + 1).end()


def _load(text: str | None):
    """(parsed, ok); a text that is cut off or blank is not ok."""
    if text is None or not text.strip():
        return None, False
    try:
        return parse_json(text), True
    except ValueError:
        return None, False


def _positions(value: dict) -> bool:
    return bool(value) and all(k.lstrip("-").isdigit() for k in value)


def entries(value, root: Root) -> list:
    """The siblings that ``value`` stands for, in order, nulls left out; without recursion, as values may be of any depth."""
    out: list = []
    todo = [(value, True)]
    while todo:
        x, top = todo.pop()
        if isinstance(x, str) and x.strip()[:1] in ("[", "{"):
            inner, ok = _load(x)
            if ok:
                todo.append((inner, top))
                continue
        if isinstance(x, list):
            todo += [(y, False) for y in reversed(x)]
        elif isinstance(x, dict):
            if not x:
                if not top:
                    out.append(x)
            elif not top or root.marks & x.keys():
                out.append(x)
            elif _positions(x):
                todo += [(x[k], False) for k in sorted(x, key=int, reverse=True)]
            else:
                todo += [(y, False) for y in reversed([*x.values()]) if isinstance(y, (list, dict)) or root.scalars]
        elif x is not None and root.scalars:
            out.append(x)
    return out


def objects(value) -> tuple[list[dict], bool]:
    """(objects that a value holds, whether it is a list of any kind): of a list, an object, one keyed by position, or their JSON text."""
    out: list[dict] = []
    repeated = isinstance(value, list)
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, str) and x.strip()[:1] in ("[", "{"):
            x = _load(x)[0]
            repeated = repeated or isinstance(x, list)
        if isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, dict):
            if _positions(x):
                repeated = True
                todo += [x[k] for k in sorted(x, key=int, reverse=True)]
            else:
                out.append(x)
    return out, repeated


def _scalar(value) -> str:
    return "boolean" if isinstance(value, bool) else "bigint" if isinstance(value, int) else "double" if isinstance(value, float) else "string"


def edges_of(value, root: Root) -> set[tuple[str, str, str]]:
    """Distinct (element, child, form) of one parsed record; form is object, array or the type of a scalar."""
    found: set[tuple[str, str, str]] = set()
    stack = [(root.element, e) for e in entries(value, root)]
    while stack:
        owner, node = stack.pop()
        if not isinstance(node, dict):
            continue
        for k, v in node.items():
            if v is None:
                continue
            held, repeated = objects(v) if isinstance(v, (list, dict, str)) else ([], False)
            found.add((owner, k, "array" if repeated else "object" if held else _scalar(v)))
            stack += [(k, x) for x in held]
    return found


def schema_edges(df: DataFrame, roots: tuple[Root, ...] = ROOTS) -> DataFrame:
    """Distinct edges of the schema graph: (root, element, child, form)."""

    def kernel(*columns):
        seen: set[tuple[str, str, str, str]] = set()
        for root, texts in zip(roots, columns):
            for text in texts:
                value, ok = _load(text)
                if ok:
                    seen |= {(root.element, *e) for e in edges_of(value, root)}
        return list(zip(*sorted(seen))) or [[], [], [], []]

    return map_columns(df, [r.column for r in roots], kernel, "root string, element string, child string, form string").distinct()


@dataclass(frozen=True)
class Plan:
    """What the schema graph says: keys under which a root recurs, (root, owner, key) with a table of their own, attributes of each element with their types."""

    again: frozenset[tuple[str, str]] = frozenset()
    tables: frozenset[tuple[str, str, str]] = frozenset()
    attributes: dict[tuple[str, str], dict[str, str]] = field(default_factory=dict)

    def elements(self) -> list[tuple[str, str]]:
        """(root, element) of every table."""
        return sorted({*self.attributes} | {(r, k) for r, _, k in self.tables})


def _reaches_itself(start: str, children: dict[str, set[str]]) -> bool:
    seen, todo = set(), list(children.get(start, ()))
    while todo:
        x = todo.pop()
        if x == start:
            return True
        if x not in seen:
            seen.add(x)
            todo += children.get(x, ())
    return False


def analyse(edges: list[tuple[str, str, str, str]], roots: tuple[Root, ...] = ROOTS, max_edges: int = 10_000, alike: float = 0.6) -> Plan:
    """Shared inlining: tables for roots and repeated, shared or recursive elements; the rest is inlined.

    ``alike`` is the share of an element's attributes that must mark a root for it to be that root again.
    """
    if len(edges) > max_edges:
        raise ValueError(f"schema graph has more than {max_edges} edges")
    again: set[tuple[str, str]] = set()
    tables: set[tuple[str, str, str]] = set()
    attributes: dict[tuple[str, str], dict[str, str]] = {}
    for root in roots:
        own = [e[1:] for e in edges if e[0] == root.element]
        held = {c for _, c, form in own if form in ("array", "object")}  # elements with objects, or lists of scalars
        children: dict[str, set[str]] = {}
        parents: dict[str, set[str]] = {}
        keys: dict[str, set[str]] = {}
        for element, child, form in own:
            keys.setdefault(element, set()).add(child)
            if form in ("array", "object") and child in held:
                children.setdefault(element, set()).add(child)
                parents.setdefault(child, set()).add(element)
        for e in held:
            recurs = _reaches_itself(e, children)
            listed = any(c == e and form == "array" for _, c, form in own)
            marks = keys.get(e, set()) - {e}
            if marks and (recurs or listed) and len(marks & root.marks) >= alike * len(marks):
                again.add((root.element, e))
        for element, child, form in own:
            if (root.element, child) in again:
                continue
            of = root.element if (root.element, element) in again else element
            if form == "array" or (form == "object" and (len(parents[child] - {e for r, e in again if r == root.element}) > 1 or _reaches_itself(child, children))):
                tables.add((root.element, of, child))
        # attributes: a table's own, and those of the singletons below it, dotted
        heads = {root.element} | {k for r, _, k in tables if r == root.element}
        for head in heads:
            seen: dict[str, str] = {}
            todo = [("", x) for x in ([head] if head != root.element else [head, *(e for r, e in again if r == root.element)])]
            while todo:
                prefix, element = todo.pop()
                for owner, child, form in own:
                    if owner != element or (root.element, child) in again:
                        continue
                    of = root.element if (root.element, owner) in again else owner
                    if (root.element, of, child) in tables:
                        continue
                    if form == "object":
                        if prefix.count(".") < len(own):
                            todo.append((f"{prefix}{child}.", child))
                    else:
                        name = prefix + child
                        seen[name] = form if seen.get(name, form) == form else "double" if {seen[name], form} == {"bigint", "double"} else "string"
            attributes[root.element, head] = dict(sorted(seen.items())) or {"value": "string"}
    return Plan(frozenset(again), frozenset(tables), attributes)


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def shred_record(value, root: Root, plan: Plan, attributes: bool = True) -> list[tuple]:
    """Rows (element, node_path, parent_path, parent_element, ord, attributes) of one parsed record, without recursion.

    Without ``attributes`` only the rows of the root's own element are given.
    """
    rows: list[tuple] = []
    stack = [(root.element, e, str(i), "", None, i) for i, e in enumerate(entries(value, root))][::-1]
    while stack:
        element, node, path, parent, owner, at = stack.pop()
        own: dict[str, str | None] = {}
        below: list[tuple] = []
        children = 0
        todo = [("", node, element)] if isinstance(node, dict) else []
        if not todo and attributes:
            own["value"] = _text(node)
        while todo:
            prefix, obj, of = todo.pop()
            for k, v in obj.items():
                if v is None:
                    continue
                if (root.element, k) in plan.again:
                    for e in entries(v, root):
                        below.append((root.element, e, f"{path}.{children}", path, element, children))
                        children += 1
                elif (root.element, of, k) in plan.tables:
                    held, repeated = objects(v)
                    listed = held or (v if isinstance(v, list) else [v])
                    below += [(k, x, f"{path}/{prefix}{k}.{j}", path, element, j) for j, x in enumerate(y for y in listed if y is not None)]
                elif isinstance(v, dict):
                    todo.append((f"{prefix}{k}.", v, k))
                elif attributes:
                    own[prefix + k] = _text(v)
        if attributes or element == root.element:
            rows.append((element, path, parent, owner, at, own))
        stack += below[::-1]
    return rows


def _planned(df: DataFrame, roots: tuple[Root, ...], plan: Plan | None) -> Plan:
    return plan or analyse([tuple(r) for r in schema_edges(df, roots).collect()], roots)


def _deliveries(df: DataFrame, key: str) -> DataFrame:
    """``df`` with the key as file_id and, where its times are known, the delivery."""
    given = df.select(F.col(key).cast("bigint").alias("file_id"), *(c for c in df.columns if c not in (key, "file_id", "delivery"))).filter("file_id is not null")
    return K.delivered(given)


def shred(df: DataFrame, key: str, roots: tuple[Root, ...] = ROOTS, plan: Plan | None = None) -> DataFrame:
    """(record_id, element, node_path, parent_path, parent_element, ord, attributes map): all flat rows; the foreign key of a row is (record_id, parent_element, parent_path)."""
    plan = _planned(df, roots, plan)

    def kernel(*columns):
        out = []
        for texts in zip(*columns):
            rows = []
            for root, text in zip(roots, texts):
                value, ok = _load(text)
                if ok:
                    rows += [(*r[:5], sorted(r[5].items())) for r in shred_record(value, root, plan)]
            out.append(rows)
        return [out]

    each = map_rows(_deliveries(df, key), ["file_id", "delivery"], [r.column for r in roots], kernel, f"nodes {_NODE}")
    flat = K.once(each, "nodes").select(F.col("file_id").alias("record_id"), F.explode("nodes").alias("n")).select("record_id", "n.*")
    return flat.withColumn("attributes", F.map_from_entries("attributes"))


def found(files: DataFrame, plan: Plan | None = None, roots: tuple[Root, ...] = ROOTS) -> DataFrame:
    """(file_id, node_kind, node_path, parent_path) of every declaration object and import entry: the rows of the root elements under the plan."""
    plan = _planned(files, roots, plan)

    def kernel(*columns):
        out = []
        for texts in zip(*columns):
            rows = []
            for root, text in zip(roots, texts):
                value, ok = _load(text)
                if ok:
                    rows += [r[:3] for r in shred_record(value, root, plan, attributes=False)]
            out.append(rows)
        return [out]

    each = map_rows(_deliveries(files, "file_id"), ["file_id", "delivery"], [r.column for r in roots], kernel, f"nodes {_FOUND}")
    return K.once(each, "nodes").select("file_id", F.explode("nodes").alias("n")).select("file_id", "n.*")


def tables(files: DataFrame) -> DataFrame:
    """Every flat row with its attributes; distinct by record, element and place."""
    return shred(files, "file_id")


def related(df: DataFrame, key: str, roots: tuple[Root, ...] = ROOTS, plan: Plan | None = None) -> dict[str, DataFrame]:
    """One typed table an element, named root or root.element: record_id, node_path, parent_element, parent_path (the foreign key), ord, and its attributes by type."""
    plan = _planned(df, roots, plan)
    rows = shred(df, key, roots, plan)
    out = {}
    for root, element in plan.elements():
        kinds = plan.attributes.get((root, element), {"value": "string"})
        own = rows.filter((F.col("element") == element) & (F.lit(root == element) | F.col("node_path").contains("/")))
        typed = [F.col("attributes")[k].try_cast(t).alias(k) for k, t in kinds.items()]
        out[element if root == element else f"{root}.{element}"] = own.select("record_id", "node_path", "parent_element", "parent_path", "ord", *typed)
    return out
