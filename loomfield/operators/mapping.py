"""Cells cast to declared types, rows mapped onto dotted field paths, rows and tables as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions.text import bare, parse_number, split_list
from loomfield.plans.schema import ArrayType, BooleanType, EnumType, FieldType, NumberType, Schema, array, enum, nested, string

YES = ("true", "yes", "y", "1", "on", "x", "✓")
NO = ("false", "no", "n", "0", "off", "-", "—")
CELL_WIDTH = 40


def cast_cell(text: Column, kind: FieldType) -> Column:
    """A cell as JSON: of the declared type where that is unambiguous, else the trimmed string."""
    t = bare(text)
    string = F.to_json(F.to_variant_object(F.array(t)))
    quoted = F.substring(string, F.lit(2), F.length(string) - 2)
    if isinstance(kind, NumberType):
        n = parse_number(t)
        plain = F.when((n == F.floor(n)) & (F.abs(n) < 1e15), n.cast("long").cast("string")).otherwise(n.cast("string"))
        return F.coalesce(plain, quoted)
    if isinstance(kind, BooleanType):
        word = F.lower(t)
        return F.when(word.isin(*YES), "true").when(word.isin(*NO), "false").otherwise(quoted)
    if isinstance(kind, EnumType):
        found = F.coalesce(*[F.when(F.lower(t) == v.lower(), v) for v in kind.values], t)
        wrapped = F.to_json(F.to_variant_object(F.array(found)))
        return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)
    if isinstance(kind, ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(split_list(t), lambda x: cast_cell(x, kind.items)), ","), F.lit("]"))
    return quoted


def normalised(header: str) -> str:
    return " ".join(header.split()).lower()


def apply_mapping(rows: DataFrame, mapping: list[tuple[str, str | None]], schema: Schema | None = None, out: str = "data_json") -> DataFrame:
    """``rows`` with a JSON object of mapped cells: exact header first, then without regard to case and spaces.

    The mapping is resolved on the driver, so the plan is a projection; blank cells and unmapped columns are
    left out, dotted paths nest, and a later entry for a path replaces an earlier one that has a value.
    """
    types = {f.path: f.type for f in schema.leaves()} if schema else {}
    by_key = {}
    for c in rows.columns:
        by_key[normalised(c)] = c
    tree: dict = {}
    for header, path in mapping:
        name = header if header in rows.columns else by_key.get(normalised(header))
        if not path or name is None:
            continue
        cell = F.col(f"`{name}`")
        value = cast_cell(cell, types[path]) if path in types else cast_cell(cell, FieldType())
        value = F.when(F.length(bare(cell)) > 0, value)
        node, parts = tree, path.split(".")
        for part in parts[:-1]:
            if not isinstance(node.get(part), dict):
                node[part] = {}
            node = node[part]
        before = node.get(parts[-1])
        node[parts[-1]] = F.coalesce(value, before) if isinstance(before, Column) else value

    def render(node: dict) -> Column:
        parts = []
        for key, value in node.items():
            inner = render(value) if isinstance(value, dict) else value
            present = F.nullif(inner, F.lit("{}")) if isinstance(value, dict) else inner
            parts.append(F.concat(F.lit(f'"{key}":'), present))
        return F.concat(F.lit("{"), F.concat_ws(",", *parts) if parts else F.lit(""), F.lit("}"))

    return rows.withColumn(out, render(tree))


def row_text(columns: list[str]) -> Column:
    """``Header: value`` lines of cells that aren't blank; further lines of a cell are indented."""
    lines = [F.when(F.length(bare(F.col(f"`{c}`"))) > 0, F.concat(F.lit(f"{c}: "), F.regexp_replace(bare(F.col(f"`{c}`")), "\\r?\\n", "\n  "))) for c in columns]
    return F.concat_ws("\n", *lines)


def table_text(table: DataFrame, columns: list[str], order: str, width: int = CELL_WIDTH) -> DataFrame:
    """(order, line): rows padded to their columns' widest cell, at most ``width``; one aggregate finds the widths."""
    shown = {c: F.regexp_replace(F.coalesce(F.col(f"`{c}`"), F.lit("")), "\\s+", " ") for c in columns}
    cells = table.select(F.col(order), *[F.when(F.length(x) > width, F.concat(F.substring(x, 1, width - 1), F.lit("…"))).otherwise(x).alias(c) for c, x in shown.items()])
    widths = cells.agg(*[F.greatest(F.coalesce(F.max(F.length(f"`{c}`")), F.lit(0)), F.lit(min(len(c), width))).alias(c) for c in columns]).first()
    return cells.select(order, F.rtrim(F.concat_ws(" | ", *[F.rpad(F.col(f"`{c}`"), widths[c], " ") for c in columns])).alias("line"))


CONFIDENCE = ("high", "medium", "low")


def mapping_schema(target: Schema, schema_id: str | None = None) -> Schema:
    """A schema whose answer says which column feeds which field of ``target``; the fields' paths are its choices."""
    leaves = target.leaves()
    if not leaves:
        raise ValueError(f"{target.id} has no fields")
    name = schema_id or f"{target.id}ColumnMapping"
    listed = "\n".join(f"- {leaf.path}: {leaf.field.description or leaf.path}" for leaf in leaves)
    column = Schema(
        f"{name}Column",
        "What one column of the table feeds",
        {
            "column": string("The column's header as it stands in the table"),
            "field": enum(*(leaf.path for leaf in leaves)).describe(f"The field that the column feeds; left out where none fits. The fields:\n{listed}").optional(),
            "transform": string("How a cell becomes the field's value where it isn't a copy").constrain(max_length=200).optional(),
            "confidence": enum(*CONFIDENCE).describe("How sure that is").optional(),
        },
    )
    return Schema(name, f"Which columns of a table feed which fields of {target.id}, one entry for each column in their order", {"columns": array(nested(column)).describe("One entry for each column")})


def mapping_of(answer: dict) -> list[tuple[str, str | None]]:
    """The pairs that ``apply_mapping`` takes, from an answer of ``mapping_schema``."""
    return [(c["column"], c.get("field")) for c in answer.get("columns") or []]


def mapping_texts(rows: DataFrame, key: str, headers: str = "headers", sample_rows: int = 5, width: int = CELL_WIDTH) -> DataFrame:
    """(key, text) for tables as rows (key, row_number, headers array, cells array): numbered columns, then the first rows as an aligned table."""
    ranked = rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy("row_number"))).withColumn("__n", F.count("*").over(Window.partitionBy(key)))
    few = ranked.where(F.col("__k") <= sample_rows)
    shown = lambda cells: F.transform(cells, lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+", " "))
    cut = lambda cells: F.transform(shown(cells), lambda c: F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 1), F.lit("…"))).otherwise(c))
    lines = few.groupBy(key).agg(F.first(headers).alias("h"), F.max("__n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("__k", cut(F.col("cells")).alias("c")))), lambda x: x["c"]).alias("cells"))
    table = F.concat(F.array(cut(F.col("h"))), F.col("cells"))
    widths = F.transform(F.sequence(F.lit(0), F.size("h") - 1), lambda j: F.array_max(F.transform(table, lambda r: F.length(F.get(r, j)))))
    aligned = F.transform(table, lambda r: F.rtrim(F.array_join(F.zip_with(r, widths, lambda c, w: F.rpad(c, w, " ")), " | ")))
    numbered = F.array_join(F.transform("h", lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c)), "\n")
    head = F.concat(F.lit("Columns ("), F.size("h").cast("string"), F.lit("):\n"), numbered)
    count = F.concat(F.lit("Sample rows ("), F.size("cells").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit("):\n"))
    return lines.select(key, F.concat(head, F.lit("\n\n"), count, F.array_join(aligned, "\n")).alias("text"))
