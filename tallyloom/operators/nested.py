"""Deeply nested records as flat tables that keep their parent and place.

``infer_schema`` merges the schemas of JSON texts, ``part_schema`` those of content parts; ``relational`` turns any
nested DataFrame into one table for the record and one for each array level below it. ``content_parts`` has the rule
by which a message's text is a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strict JSON: what the default reader forgives (single quotes, NaN) isn't well-formed.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def infer_schema(df: DataFrame, column: str) -> T.DataType:
    """One schema for every JSON text of a column, malformed and null texts aside; merged on the executors."""
    return _merged(df.select(F.schema_of_variant_agg(F.try_parse_json(F.col(column))).alias("s")).first()["s"])


def _merged(merged: str | None) -> T.DataType:
    if merged is None or merged == "VOID":
        return T.NullType()
    return T._parse_datatype_string(merged.replace("OBJECT<", "STRUCT<"))


def relational(df: DataFrame, key: str, name: str = "root") -> dict[str, DataFrame]:
    """``{path: table}``: the record's own scalars under ``name``, and a child table for each array below it.

    A row has ``parent_id`` (the record's key), ``path`` (such as ``metrics[0].categories[2]``), the ordinals of every
    level as ``ordinals``, a key of its own as ``row_key``, that of the row right above it as ``parent_key`` (null for the
    record), and the element's scalars. The entries of a map are a child table too, with ``key`` and in the order of
    their keys, so that equal maps give equal rows. Null and empty arrays and maps give no rows; a
    null element gives none either, and doesn't shift its neighbours' ordinals. Struct fields are flattened with
    ``_``; names that would clash with the columns named here get a trailing ``_``. Each level explodes on its
    own from the record, so no join and no shuffle is needed to keep the links.
    """
    tables: dict[str, DataFrame] = {}

    def scalars(kind: T.StructType, at: Column, prefix: str = "") -> list[tuple[str, Column]]:
        out: list[tuple[str, Column]] = []
        for f in kind:
            if isinstance(f.dataType, T.StructType):
                out += scalars(f.dataType, at.getField(f.name), f"{prefix}{f.name}_")
            elif not isinstance(f.dataType, (T.ArrayType, T.MapType)):
                out.append((prefix + f.name, at.getField(f.name)))
        return out

    def arrays(kind: T.StructType, at: Column, prefix: str = "") -> list[tuple[str, T.ArrayType, Column]]:
        """The arrays of a struct, and its maps as arrays of their entries."""
        out: list[tuple[str, T.ArrayType, Column]] = []
        for f in kind:
            if isinstance(f.dataType, T.StructType):
                out += arrays(f.dataType, at.getField(f.name), f"{prefix}{f.name}.")
            elif isinstance(f.dataType, T.ArrayType):
                out.append((prefix + f.name, f.dataType, at.getField(f.name)))
            elif isinstance(f.dataType, T.MapType):
                m = f.dataType
                entry = T.StructType([T.StructField("key", m.keyType, False), T.StructField("value", m.valueType)])
                by_key = lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0)
                out.append((prefix + f.name, T.ArrayType(entry), F.array_sort(F.map_entries(at.getField(f.name)), by_key)))
        return out

    def named(columns: list[tuple[str, Column]], taken: set[str]) -> list[Column]:
        out = []
        for n, c in columns:
            while n.lower() in taken:
                n += "_"
            taken.add(n.lower())
            out.append(c.alias(n))
        return out

    key_of = lambda path: F.concat(F.col("parent_id").cast("string"), F.lit(":"), F.col(path))
    row_key = key_of("path")

    def walk(base: DataFrame, label: str, kind: T.StructType) -> None:
        own = named(scalars(kind, F.col("_e")), {"parent_id", "path", "ordinals", "row_key", "parent_key"})
        tables[label] = base.select("parent_id", "path", "ordinals", row_key.alias("row_key"), (F.lit(None).cast("string") if label == name else key_of("_above")).alias("parent_key"), *own)
        for child, of, at in arrays(kind, F.col("_e")):
            opened = base.select("parent_id", "path", "ordinals", F.posexplode_outer(at).alias("_i", "_x")).filter("_x is not null")
            place = F.concat(F.when(F.col("path") == "", "").otherwise(F.concat("path", F.lit("."))), F.lit(child), F.lit("["), F.col("_i"), F.lit("]"))
            element = of.elementType
            value = F.col("_x") if isinstance(element, T.StructType) else F.struct(F.col("_x").alias("value"))
            inner = element if isinstance(element, T.StructType) else T.StructType([T.StructField("value", element)])
            walk(opened.select("parent_id", F.col("path").alias("_above"), place.alias("path"), F.concat("ordinals", F.array("_i")).alias("ordinals"), value.alias("_e")), f"{label}.{child}", inner)

    record = df.select(
        F.col(key).alias("parent_id"), F.lit("").alias("path"), F.array().cast("array<int>").alias("ordinals"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_e")
    )
    walk(record, name, df.schema)
    return tables


def _flat(kind: T.DataType) -> T.DataType:
    """A type that a table can hold: what has no single type, or names that differ in case only, stays JSON text."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_flat(kind.elementType))
    if isinstance(kind, T.StructType):
        names = {f.name.lower() for f in kind}
        return T.StructType([T.StructField(f.name, _flat(f.dataType)) for f in kind]) if names and len(names) == len(kind.fields) else T.StringType()
    return T.StringType() if isinstance(kind, (T.NullType, T.VariantType)) else kind


def _ddl(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        return f"array<{_ddl(kind.elementType)}>"
    if isinstance(kind, T.StructType):
        return "struct<" + ",".join(f"`{f.name.replace('`', '``')}`:{_ddl(f.dataType)}" for f in kind) + ">"
    return kind.simpleString()


#: The fields that parts have in any table.
_LEAST = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())])


def _opened(c: Column) -> Column:
    """The text as array<array<map<string,variant>>>: it is parsed inside one more pair of brackets, as the parser
    would otherwise ignore what follows the list."""
    return F.when(F.ltrim(c).startswith("["), F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<array<map<string,variant>>>", _STRICT))


def _is_list(opened: Column) -> Column:
    fits = (F.size(opened) == 1) & opened[0].isNotNull() & F.forall(opened[0], lambda e: e.isNull() | F.map_contains_key(e, "type"))
    return F.coalesce(fits, F.lit(False))


def part_schema(contents: DataFrame, column: str) -> T.StructType:
    """One schema for the parts of all contents that are lists, by name; merged on the executors, a row a field."""
    opened = contents.select(_opened(F.col(column)).alias("o")).filter("o is not null").filter(_is_list(F.col("o")))
    fields = opened.select(F.explode(F.col("o")[0]).alias("e")).select(F.explode("e").alias("name", "value"))
    found = {r["name"]: _flat(_merged(r["s"])) for r in fields.groupBy("name").agg(F.schema_of_variant_agg("value").alias("s")).collect()}
    return T.StructType([*_LEAST, *[T.StructField(n, k) for n, k in sorted(found.items()) if n not in _LEAST.names]])


def content_parts(content: Column | str, kind: T.StructType = _LEAST) -> Column:
    """A message's content parts as an array of structs of ``kind``, null elements kept in place.

    Well-formed JSON of a list whose elements are all null or objects with a ``type`` is that list. Null and ''
    have no part. Any other content is one part without a type, and its ``text``. Fields whose names differ in case
    only are told apart by a trailing ``_``.
    """
    c = F.col(content) if isinstance(content, str) else content
    names: list[str] = []
    for n in kind.names:
        while n.lower() in {x.lower() for x in names}:
            n += "_"
        names.append(n)
    fields = list(zip(names, kind.fields, strict=True))
    part = lambda e: F.struct(*[F.try_variant_get(F.element_at(e, F.lit(f.name)), "$", _ddl(f.dataType)).alias(n) for n, f in fields])
    one = F.array(F.struct(*[(c if f.name == "text" else F.lit(None).cast(f.dataType)).alias(n) for n, f in fields]))
    none = F.array().cast(T.ArrayType(T.StructType([T.StructField(n, f.dataType) for n, f in fields])))

    def decide(opened: Column) -> Column:
        return F.when(_is_list(opened), F.transform(opened[0], lambda e: F.when(e.isNotNull(), part(e)))).otherwise(one)

    # a lambda's variable holds the parsed text, else each of its uses would parse again
    return F.when(c.isNull() | (c == ""), none).otherwise(F.transform(F.array(_opened(c)), decide)[0])


def prediction_tables(predictions: DataFrame, record: str = "rec_id") -> dict[str, DataFrame]:
    """The flat tables of predictions: ``predictions`` (usage_input_tokens), ``.messages``, ``.messages.content`` with
    all fields that parts have by part_schema(), and a table for each array inside parts."""
    kind = part_schema(predictions.select(F.explode("messages.content").alias("content")), "content")
    slim = predictions.select(
        F.col(record).alias("record"),
        F.struct(F.col("model_output.usage.input_tokens").alias("input_tokens")).alias("usage"),
        F.transform(
            F.arrays_zip(F.col("messages.role").alias("role"), F.col("messages.content").alias("content")), lambda m: F.struct(m["role"].alias("role"), content_parts(m["content"], kind).alias("content"))
        ).alias("messages"),
    )
    return relational(slim, "record", "predictions")


def report_tables(reports: DataFrame, record: str = "report_id") -> dict[str, DataFrame]:
    """The flat tables of reports: ``reports``, ``.metrics``, ``.metrics.categories`` and ``.metrics.categories.subsets``."""
    return relational(reports.select(F.col(record).alias("record"), "metrics"), "record", "reports")


def flat_paths(predictions: DataFrame, reports: DataFrame) -> DataFrame:
    """(tbl, parent_id, path) of all usages, content parts and subsets; no shuffle, as each level opens in its row.

    Records stored twice under their own ids count twice. Null and empty arrays give no rows, null elements are
    skipped and keep their place. Usages need a record's ``input_tokens`` not to be null.
    """
    p, r = prediction_tables(predictions), report_tables(reports)
    return (
        p["predictions"].filter("usage_input_tokens is not null").select(F.lit("predictions").alias("tbl"), "parent_id", F.lit("usage").alias("path"))
        .unionByName(p["predictions.messages.content"].select(F.lit("predictions").alias("tbl"), "parent_id", "path"))
        .unionByName(r["reports.metrics.categories.subsets"].select(F.lit("reports").alias("tbl"), "parent_id", "path"))
    )


def json_tables(df: DataFrame, key: str, column: str, name: str = "json") -> dict[str, DataFrame]:
    """relational() over a column of JSON texts, by the merged schema of all of them; malformed texts give null fields."""
    kind = infer_schema(df, column)
    if not isinstance(kind, T.StructType):
        kind = T.StructType([T.StructField("value", kind if not isinstance(kind, T.NullType) else T.StringType())])
    parsed = df.select(F.col(key).alias("record"), F.from_json(F.col(column), kind.json()).alias("fields"))
    return relational(parsed, "record", name)
