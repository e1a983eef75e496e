"""Mutations as batches of commands: text and binary forms, a journal, and events.

A batch is a short program: the driver reads it and every command becomes a
lazy change of the graph's frames.  Commands run in order and stop at the
first error unless told otherwise; what was done before an error stays.
"""

from __future__ import annotations

import ast
import re
import struct
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.graph import Graph, GraphError
from graphloom.operators.attributes import set_dictionary

SCOPES = ("node", "edge", "network")
#: Operation codes of the binary form, in order from 1.
OPERATIONS = ("ADD_NODES", "ADD_EDGES", "SET_ATTR_VALUES", "REMOVE_NODES", "REMOVE_EDGES", "DEFINE_ATTRIBUTE", "SET_CATEGORY_DICTIONARY")
#: Attribute type codes.
TYPE_NAMES = {0: "string", 1: "boolean", 2: "float", 3: "integer", 4: "unsignedinteger", 5: "double", 6: "category", 7: "data", 8: "json", 9: "biginteger", 10: "unsignedbiginteger", 11: "multicategory"}


@dataclass
class Command:
    operation: str
    arguments: dict[str, object]
    capture: str | None = None
    base: str | None = None  #: the result set that ids are relative to


@dataclass
class Result:
    operation: str
    ok: bool
    ids: list[int] = field(default_factory=list)
    error: str | None = None


_LINE = re.compile(r"\s*(?:(?P<var>[A-Za-z_]\w*)\s*=\s*)?(?P<op>[A-Z_]+)\b(?P<rest>.*?)(?:!\s*relative(?:\s+(?P<base>[A-Za-z_]\w*))?)?\s*$", re.S)


def _arguments(text: str) -> dict[str, object]:
    """``key=value`` pairs; lists and quoted strings may hold blanks."""
    out: dict[str, object] = {}
    for m in re.finditer(r'([A-Za-z_]\w*)=(\[(?:"(?:[^"\\]|\\.)*"|[^\]"])*\]|"(?:[^"\\]|\\.)*"|\S+)', text):
        raw = m[2]
        if raw[0] in '["' or re.fullmatch(r"[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?", raw):
            value = ast.literal_eval(raw)
            if isinstance(value, list) and len({isinstance(v, str) for v in value}) > 1:
                raise GraphError("values mix strings and numbers")
        else:
            value = raw
        out[m[1]] = value
    return out


def parse_text(text: str) -> list[Command]:
    commands = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        m = _LINE.match(line)
        if m is None or m["op"] not in OPERATIONS:
            raise GraphError(f"unknown command {line!r}")
        args = _arguments(m["rest"])
        base = None
        if re.search(r"!\s*relative", line):
            base = m["base"] or ("added_edge_ids" if m["op"] == "REMOVE_EDGES" or args.get("scope") == "edge" else "added_node_ids")
        commands.append(Command(m["op"], args, m["var"], base))
    return commands


def parse_binary(data: bytes) -> list[Command]:
    if data[:4] != b"HNPB" or data[4] != 1:
        raise GraphError("this is no batch of version 1")
    (count,), at, commands = struct.unpack_from("<I", data, 8), 12, []
    for _ in range(count):
        op, flags, _, slot, n = struct.unpack_from("<BBHII", data, at)
        body = data[at + 12 : at + 12 + n]
        at += 12 + n
        if not 1 <= op <= len(OPERATIONS) or len(body) != n:
            raise GraphError("a record cannot be read")
        commands.append(_binary_command(OPERATIONS[op - 1], bool(flags & 1), slot, body))
    return commands


def _binary_command(op: str, relative: bool, slot: int, body: bytes) -> Command:
    u32 = lambda k, at: list(struct.unpack_from(f"<{k}I", body, at))
    capture = f"slot{slot}" if slot else None
    base, args = None, {}
    if op == "ADD_NODES":
        args["n"] = u32(1, 0)[0]
    elif op == "ADD_EDGES":
        k, b = u32(2, 0)
        flat = u32(2 * k, 8)
        args["pairs"], base = list(zip(flat[::2], flat[1::2], strict=True)), b
    elif op in ("REMOVE_NODES", "REMOVE_EDGES"):
        args["ids"] = u32(u32(1, 0)[0], 4)
        base = 0
    elif op == "SET_ATTR_VALUES":
        scope, kind = body[0], body[1]
        k, values, base, size = u32(4, 4)
        args = {"scope": SCOPES[scope], "name": body[20 : 20 + size].decode(), "ids": u32(k, 20 + size)}
        at = 20 + size + 4 * k
        if kind == 0:
            args["values"] = list(struct.unpack_from(f"<{values}d", body, at))
        else:
            texts = []
            for _ in range(values):
                (n,) = struct.unpack_from("<I", body, at)
                texts.append(body[at + 4 : at + 4 + n].decode())
                at += 4 + n
            args["values"] = texts
    elif op == "DEFINE_ATTRIBUTE":
        dimension, size = u32(2, 4)
        args = {"scope": SCOPES[body[0]], "type": body[1], "dimension": dimension, "name": body[12 : 12 + size].decode()}
    else:
        entries, size = u32(2, 4)
        at, labels = 12 + size, []
        for _ in range(entries):
            (n,) = struct.unpack_from("<I", body, at)
            labels.append(body[at + 4 : at + 4 + n].decode())
            at += 4 + n
        args = {"scope": SCOPES[body[0]], "name": body[12 : 12 + size].decode(), "entries": labels}
    # without a slot, relative ids refer to what was added last of the command's own scope
    last = "added_edge_ids" if op == "REMOVE_EDGES" or args.get("scope") == "edge" and op == "SET_ATTR_VALUES" else "added_node_ids"
    return Command(op, args, capture, f"slot{base}" if relative and base else (last if relative else None))


def to_text(commands: list[Command]) -> str:
    """The inverse of ``parse_text``."""

    def shown(v: object) -> str:
        if isinstance(v, str):
            return v if re.fullmatch(r"[A-Za-z_]\w*", v) else '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
        if isinstance(v, list):
            return "[" + ",".join(f"({a},{b})" if isinstance(x, tuple) and (a := x[0]) is not None and (b := x[1]) is not None else ('"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"' if isinstance(x, str) else repr(x)) for x in v) + "]"
        return str(v)

    lines = []
    for c in commands:
        head = f"{c.capture} = " if c.capture else ""
        tail = f" ! relative {c.base}" if c.base else ""
        lines.append(f"{head}{c.operation} " + " ".join(f"{k}={shown(v)}" for k, v in c.arguments.items()) + tail)
    return "\n".join(lines)


def to_binary(commands: list[Command]) -> bytes:
    """The inverse of ``parse_binary``."""
    slots: dict[str, int] = {}
    records = []
    for c in commands:
        a, base = c.arguments, slots.get(c.base or "", 0)
        slot = slots.setdefault(c.capture, len(slots) + 1) if c.capture else 0
        name = str(a.get("name", "")).encode()
        scope = SCOPES.index(a["scope"]) if "scope" in a else 0
        if c.operation == "ADD_NODES":
            body = struct.pack("<I", a["n"])
        elif c.operation == "ADD_EDGES":
            flat = [x for p in a["pairs"] for x in p]
            body = struct.pack(f"<II{len(flat)}I", len(flat) // 2, base, *flat)
        elif c.operation in ("REMOVE_NODES", "REMOVE_EDGES"):
            body = struct.pack(f"<I{len(a['ids'])}I", len(a["ids"]), *a["ids"])
        elif c.operation == "SET_ATTR_VALUES":
            ids, values = a.get("ids", [0]), a["values"]
            text = bool(values) and isinstance(values[0], str)
            body = struct.pack("<BBHIIII", scope, int(text), 0, len(ids), len(values), base, len(name)) + name + struct.pack(f"<{len(ids)}I", *ids)
            body += b"".join(struct.pack("<I", len(v.encode())) + v.encode() for v in values) if text else struct.pack(f"<{len(values)}d", *values)
        elif c.operation == "DEFINE_ATTRIBUTE":
            kind = a["type"] if isinstance(a["type"], int) else next(k for k, v in TYPE_NAMES.items() if v == str(a["type"]).lower())
            body = struct.pack("<BBHII", scope, kind, 0, int(a.get("dimension", 1)), len(name)) + name
        else:
            body = struct.pack("<BBHII", scope, 0, 0, len(a["entries"]), len(name)) + name + b"".join(struct.pack("<I", len(x.encode())) + x.encode() for x in a["entries"])
        records.append(struct.pack("<BBHII", OPERATIONS.index(c.operation) + 1, int(c.base is not None), 0, slot, len(body)) + body)
    return b"HNPB" + struct.pack("<BBHI", 1, 0, 0, len(records)) + b"".join(records)


class Log:
    """A graph that changes by commands, with its journal and listeners."""

    def __init__(self, graph: Graph):
        self.graph = graph
        self.journal: list[dict[str, object]] = []
        self.sets: dict[str, list[int]] = {}
        self._listeners: list[tuple[str | None, Callable[[dict], None]]] = []
        self._named: dict[str, Callable[[], None]] = {}
        self._batch: list[dict] | None = None

    # -- events ------------------------------------------------------------------------------

    def on(self, kind: str | None, handler: Callable[[dict], None]) -> Callable[[], None]:
        """Call ``handler`` for events of a kind (all for None); returns a function that ends this."""
        entry = (kind, handler)
        self._listeners.append(entry)
        return lambda: self._listeners.remove(entry) if entry in self._listeners else None

    def listen(self, place: str, handler: Callable[[dict], None] | None) -> Callable[[], None]:
        """One listener for each ``kind.namespace``: a new handler replaces the one before, None removes it."""
        if not place.partition(".")[2]:
            raise GraphError(f"no namespace in {place!r}")
        self._named.pop(place, lambda: None)()
        if handler is None:
            return lambda: None
        self._named[place] = self.on(place.partition(".")[0], handler)
        return self._named[place]

    def emit(self, event_kind: str, **detail: object) -> None:
        event = {"seq": len(self.journal), "event": event_kind, **detail}
        self.journal.append(event)
        if event_kind == "topology:changed":
            self._notify({**event, "event": f"{detail['kind']}:{detail['op']}"})
        self._notify(event)

    def _notify(self, event: dict) -> None:
        if self._batch is not None:
            self._batch.append(event)
            return
        self._tell(event)

    def _tell(self, event: dict) -> None:
        for kind, handler in list(self._listeners):
            if kind is None or kind == event["event"]:
                handler(event)

    @contextmanager
    def batch(self) -> Iterator[Log]:
        """Events within come as one ``batch:applied``."""
        outer, self._batch = self._batch, []
        try:
            yield self
        finally:
            inner, self._batch = self._batch, outer
            self._tell({"seq": len(self.journal), "event": "batch:applied", "events": inner})

    def remove_attribute(self, scope: str, name: str) -> None:
        self.graph = self.graph.remove_attribute(scope, name)
        self.emit("attribute:removed", scope=scope, name=name)

    def drain(self) -> list[dict[str, object]]:
        out, self.journal = self.journal, []
        return out

    # -- commands ----------------------------------------------------------------------------

    def apply_text(self, text: str, stop_on_error: bool = True) -> list[Result]:
        return self.apply(parse_text(text), stop_on_error)

    def apply_binary(self, data: bytes, stop_on_error: bool = True) -> list[Result]:
        return self.apply(parse_binary(data), stop_on_error)

    def apply(self, commands: list[Command], stop_on_error: bool = True) -> list[Result]:
        results = []
        with self.batch():
            for c in commands:
                try:
                    results.append(Result(c.operation, True, self._run(c)))
                except (GraphError, KeyError, IndexError, ValueError, TypeError) as e:
                    results.append(Result(c.operation, False, error=str(e)))
                    if stop_on_error:
                        break
        return results

    def _absolute(self, c: Command, ids: list[int]) -> list[int]:
        if c.base is None:
            return [int(i) for i in ids]
        known = self.sets.get(c.base)
        if known is None:
            raise GraphError(f"there is no result set {c.base!r}")
        return [known[int(i)] for i in ids]

    def _run(self, c: Command) -> list[int]:
        a, g = c.arguments, self.graph
        made: list[int] = []
        if c.operation == "ADD_NODES":
            first = g.valid_range("node").first()["stop"]
            self.graph = g.add_nodes(int(a["n"]))
            made = list(range(first, first + int(a["n"])))
            self.sets["added_node_ids"] = made
            self.emit("topology:changed", kind="nodes", op="added", ids=made)
        elif c.operation == "ADD_EDGES":
            pairs = [tuple(self._absolute(c, p)) for p in a["pairs"]]
            first = g.valid_range("edge").first()["stop"]
            self.graph = g.add_edges(pairs)
            made = list(range(first, first + len(pairs)))
            self.sets["added_edge_ids"] = made
            self.emit("topology:changed", kind="edges", op="added", ids=made)
        elif c.operation in ("REMOVE_NODES", "REMOVE_EDGES"):
            ids = self._absolute(c, a["ids"])
            self.graph = g.remove_nodes(ids) if c.operation == "REMOVE_NODES" else g.remove_edges(ids)
            self.emit("topology:changed", kind=c.operation.split("_")[1].lower(), op="removed", ids=ids)
        elif c.operation == "DEFINE_ATTRIBUTE":
            kind = TYPE_NAMES[a["type"]] if isinstance(a["type"], int) else str(a["type"])
            self.graph = g.define_attribute(str(a["scope"]), str(a["name"]), kind, int(a.get("dimension", 1)))
            self.emit("attribute:defined", scope=a["scope"], name=a["name"], type=kind)
        elif c.operation == "SET_CATEGORY_DICTIONARY":
            self.graph = set_dictionary(g, str(a["scope"]), str(a["name"]), {x: i for i, x in enumerate(a["entries"])})
            self.emit("attribute:changed", scope=a["scope"], name=a["name"], op="dictionary")
        else:
            self._set_values(c)
        if c.capture:
            self.sets[c.capture] = made
        return made

    def _set_values(self, c: Command) -> None:
        a, g = c.arguments, self.graph
        scope, name, values = str(a["scope"]), str(a["name"]), list(a["values"])
        if scope == "network":
            if name not in g.attributes:
                raise GraphError(f"no attribute {name!r}")
            self.graph = g.with_attribute("network", name, values[0] if len(values) == 1 else values)
        else:
            ids = self._absolute(c, a["ids"])
            field_ = g.frame(scope).schema[name]
            kind = field_.dataType
            vector = isinstance(kind, T.ArrayType)
            if vector:
                if not ids or len(values) % len(ids):
                    raise GraphError("the number of values does not fit the ids")
                size = len(values) // len(ids)
                values = [values[i : i + size] for i in range(0, len(values), size)]
            elif len(values) == 1:
                values = values * len(ids)
            if len(values) != len(ids):
                raise GraphError("the number of values does not fit the ids")
            labels = g.categories.get((scope, name))
            if labels is not None:
                unknown = [v for v in values if isinstance(v, str) and v not in labels]
                if unknown:
                    raise GraphError(f"unknown category {unknown[0]!r}")
                values = [labels[v] if isinstance(v, str) else int(v) for v in values]
            elif isinstance(kind, T.StringType) != all(isinstance(v, str) for v in values):
                raise GraphError("values do not fit the attribute's type")
            whole = T.LongType() if isinstance(kind.elementType if vector else kind, T.IntegralType) else T.DoubleType()
            number = int if isinstance(whole, T.LongType) else float  # whole numbers of integral types keep all digits
            raw = T.ArrayType(whole) if vector else T.StringType() if isinstance(kind, T.StringType) else whole
            cast = [[number(x) for x in v] if vector else v if isinstance(v, str) else number(v) for v in values]
            table = g.spark.createDataFrame(list(zip(ids, cast, strict=True)), T.StructType([T.StructField("id", T.LongType()), T.StructField("value", raw)]))
            self.graph = g.set_values(scope, name, table.withColumn("value", F.col("value").cast(kind)))
        self.emit("attribute:changed", scope=scope, name=name)


def replayed(graph: Graph, text: str) -> Graph:
    """The graph after a text batch; an error raises."""
    log = Log(replace(graph))
    for r in log.apply_text(text):
        if not r.ok:
            raise GraphError(f"{r.operation}: {r.error}")
    return log.graph
