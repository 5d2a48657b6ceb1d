"""Schemas from the source of Python classes, without importing it.

A class with the decorator ``schema("description")`` becomes a schema; its annotated names become fields::

    @schema("A listing")
    class Listing:
        name: Annotated[str, describe("Shown name"), constrain(max_length=60)]
        kind: Literal["house", "flat"] | None
        tags: Annotated[list[str], values_from("tags")]
        owner: Person

``None`` in a union makes a field optional.  What isn't understood is warned of and taken as a string.
"""

from __future__ import annotations

import ast
import json
import re
from dataclasses import replace
from pathlib import Path

from loomfield.plans import schema as s


class Extraction:
    def __init__(self):
        self.classes: dict[str, ast.ClassDef] = {}
        self.schemas: dict[str, s.Schema] = {}
        self.warnings: list[str] = []
        self._open: list[str] = []

    def add(self, source: str, name: str = "<source>") -> None:
        for node in ast.walk(ast.parse(source, name)):
            if isinstance(node, ast.ClassDef) and _description(node) is not None:
                if node.name in self.classes:
                    raise ValueError(f"two classes are named {node.name!r}")
                self.classes[node.name] = node

    def build(self) -> dict[str, s.Schema]:
        for name in self.classes:
            self._schema(name)
        return self.schemas

    def _schema(self, name: str) -> s.Schema:
        if name not in self.schemas:
            node, self._open = self.classes[name], [*self._open, name]
            fields = {x.target.id: self._field(x.annotation, f"{name}.{x.target.id}") for x in node.body if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name)}
            self.schemas[name] = s.Schema(name, _description(node) or "", fields)
            self._open = self._open[:-1]
        return self.schemas[name]

    def _field(self, node: ast.expr, where: str) -> s.Field:
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            node = ast.parse(node.value, mode="eval").body
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
            parts = _union(node)
            rest = [p for p in parts if not (isinstance(p, ast.Constant) and p.value is None)]
            if len(rest) == 1:
                own = self._field(rest[0], where)
                return own.optional() if len(rest) < len(parts) else own
            return self._unknown(node, where)
        if isinstance(node, ast.Name):
            plain = {"str": s.string, "int": s.number, "float": s.number, "bool": s.boolean}
            if node.id in plain:
                return plain[node.id]()
            if node.id in self.classes:
                if node.id in self._open:
                    self.warnings.append(f"{where}: {node.id} refers to itself; its contents aren't checked")
                    return s.Field(s.ObjectType(node.id))
                return s.nested(self._schema(node.id))
        if isinstance(node, ast.Subscript) and isinstance(node.value, ast.Name):
            inner = node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice]
            kind = node.value.id
            if kind in ("list", "List") and len(inner) == 1:
                return self._field(inner[0], where).array()
            if kind == "Optional" and len(inner) == 1:
                return self._field(inner[0], where).optional()
            if kind == "Literal" and all(isinstance(x, ast.Constant) for x in inner):
                values = [x.value for x in inner]
                if all(isinstance(v, str) for v in values):
                    return s.enum(*values)
                if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
                    return s.number()
            if kind == "Annotated":
                return self._annotated(self._field(inner[0], where), inner[1:], where)
        return self._unknown(node, where)

    def _annotated(self, own: s.Field, notes: list[ast.expr], where: str) -> s.Field:
        for call in notes:
            name = call.func.id if isinstance(call, ast.Call) and isinstance(call.func, ast.Name) else None
            try:
                if name == "describe":
                    own = own.describe(ast.literal_eval(call.args[0]))
                elif name == "values_from":
                    kind = s.SourcedEnumType(ast.literal_eval(call.args[0]))
                    own = replace(own, type=s.ArrayType(kind) if isinstance(own.type, s.ArrayType) else kind)
                elif name == "constrain":
                    for k in call.keywords:  # a bad entry goes alone
                        try:
                            own = own.constrain(**{k.arg: ast.literal_eval(k.value)})
                        except (ValueError, TypeError, re.error) as e:
                            self.warnings.append(f"{where}: {k.arg}: {e}")
                else:
                    self.warnings.append(f"{where}: {ast.unparse(call)} isn't known")
            except (ValueError, IndexError):
                self.warnings.append(f"{where}: {ast.unparse(call)} isn't a literal")
        return own

    def _unknown(self, node: ast.expr, where: str) -> s.Field:
        self.warnings.append(f"{where}: {ast.unparse(node)} is taken as a string")
        return s.string()


def _union(node: ast.expr) -> list[ast.expr]:
    return [*_union(node.left), *_union(node.right)] if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr) else [node]


def _description(node: ast.ClassDef) -> str | None:
    for d in node.decorator_list:
        if isinstance(d, ast.Call) and isinstance(d.func, ast.Name) and d.func.id == "schema":
            return d.args[0].value if d.args and isinstance(d.args[0], ast.Constant) else ""
    return None


def extract(paths: list[str | Path]) -> tuple[dict[str, s.Schema], list[str]]:
    """Schemas by class name, and warnings."""
    found = Extraction()
    for p in map(Path, paths):
        found.add(p.read_text(), str(p))
    return found.build(), found.warnings


def emit(schemas: dict[str, s.Schema], folder: str | Path, dialect: str = "standard") -> list[Path]:
    """A JSON Schema file for each schema, and an index."""
    out = []
    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, schema in sorted(schemas.items()):
        out.append(Path(folder) / f"{name}.schema.json")
        out[-1].write_text(json.dumps(schema.json_schema(dialect), indent=2, ensure_ascii=False) + "\n")
    out.append(Path(folder) / "index.json")
    out[-1].write_text(json.dumps({n: f"{n}.schema.json" for n in sorted(schemas)}, indent=2) + "\n")
    return out
