"""Raw documents from lines of JSON, read as VARIANT: every line becomes a document or a reject with its reasons."""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logwarden.schema import raw_schema
from logwarden.sources.sinks import read_run, stage, write_daily

#: Request fields that count; they come as text or as JSON numbers.
COUNTS = (("status",), ("bytes_sent",))
REJECT = T.StructType([T.StructField("line", T.StringType()), T.StructField("reason", T.StringType())])


def _fields(schema: T.StructType, parents: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    """Paths and types of all fields, objects before what is in them."""
    out = []
    for f in schema:
        out.append(((*parents, f.name), f.dataType))
        if isinstance(f.dataType, T.StructType):
            out += _fields(f.dataType, (*parents, f.name))
    return out


def _named(mark: str, path: tuple[str, ...]) -> str:
    return f"{mark} {' '.join(path)}"


def _x(path: tuple[str, ...]) -> Column:
    """The JSON value at a path."""
    return F.col(f"`{_named('x', path)}`")


def _is(path: tuple[str, ...], *kinds: str) -> Column:
    """Whether the value at a path has one of the JSON types; false where it is absent."""
    return F.coalesce(F.col(f"`{_named('kind', path)}`").rlike("^(" + "|".join(kinds) + r")\b"), F.lit(False))


def _cast(path: tuple[str, ...], kind: str) -> Column:
    return F.try_variant_get(_x(path), "$", kind)


def _value(path: tuple[str, ...], kind: T.DataType) -> Column:
    """The field's value, null if it can't be read. A JSON number of the request loses its fraction where it counts, and true is
    1; its text stays as it is and is judged by ``normalize_logs``. A single text is a list of one, as token claims allow."""
    text = F.when(~_is(path, "OBJECT", "ARRAY"), _cast(path, "string"))
    if isinstance(kind, T.ArrayType):
        return F.when(_is(path, "STRING"), F.array(_cast(path, "string"))).otherwise(_cast(path, "array<string>"))
    if path == ("response_time",):
        return F.when(_is(path, "BOOLEAN"), _cast(path, "double").cast("string")).otherwise(text)
    if path in COUNTS:
        whole = _cast(path, "double").try_cast("bigint").cast("string")
        return F.when(_is(path, "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN"), whole).otherwise(text)
    return text if kind == T.StringType() else _cast(path, kind.simpleString())


#: JSON values that stand for a missing object.
_NOTHING = ("false", "0", '""', "[]")


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns through a generator, so that Spark computes each once for a row, see normalize_logs."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))) if columns else df


def _document(schema: T.StructType, parents: tuple[str, ...] = ()) -> list[Column]:
    out = []
    for f in schema:
        path = (*parents, f.name)
        held = F.when(_is(path, "OBJECT"), F.struct(*_document(f.dataType, path))) if isinstance(f.dataType, T.StructType) else (
            F.col(f"`{_named('value', path)}`"))
        out.append(held.alias(f.name))
    return out


#: Kinds of the JSON values that need no conversion and can't be unreadable.
_PLAIN = {T.StringType: "STRING", T.LongType: "BIGINT", T.IntegerType: "BIGINT", T.BooleanType: "BOOLEAN", T.ArrayType: "ARRAY<(?:STRING|VOID)>"}


def _plain_kinds(kind: T.DataType) -> str:
    """Pattern of what ``schema_of_variant`` says of a value that has the schema's own types throughout, and no other fields."""
    if not isinstance(kind, T.StructType):
        return f"(?:{_PLAIN[type(kind)]}|VOID)"
    fields = sorted(kind, key=lambda f: f.name)
    names = {f.name: f.name if re.fullmatch("[A-Za-z0-9_]+", f.name) else f"`{f.name}`" for f in fields}
    return "(?:OBJECT<" + "".join(f"(?:{names[f.name]}: {_plain_kinds(f.dataType)}(?:, |(?=>)))?" for f in fields) + ">|VOID)"


def _wide(kind: T.DataType) -> str:
    """The type in SQL, int as bigint."""
    if isinstance(kind, T.StructType):
        return "struct<" + ", ".join(f"`{f.name}`: {_wide(f.dataType)}" for f in kind) + ">"
    return "bigint" if kind == T.IntegerType() else kind.simpleString()


def parse_lines(lines: DataFrame, column: str = "value", provenance: str = "provenance") -> DataFrame:
    """A row for each line: the fields of a raw document, the ``line`` and the ``reason`` it is no document, else null.

    Reasons: ``empty`` (null or blank), ``not json``, ``not an object``, or ``unreadable: `` and the fields whose value has
    another type (all of them). Numbers of a request may be JSON numbers: 200.7 is 200, true is 1. A claim that should be a
    list may be one text. A claim that is a number may be digits in text. An object that is false, 0, "" or [] is missing.
    Fields outside the schema are passed over. Other columns of ``lines`` are not kept.

    Lines whose fields all have the schema's own types, which one look at the document's kinds tells, are read in one step; only
    the others are read field by field.
    """
    schema = raw_schema(provenance)
    fields = _fields(schema)
    rows = _once(lines.select(F.col(f"`{column}`").alias("line")), {"json": F.try_parse_json("line")})
    rows = _once(rows, {"plain": F.when(F.schema_of_variant("json").rlike(f"^{_plain_kinds(schema)}$"), F.try_variant_get("json", "$", _wide(schema)))})
    fits = [F.coalesce(F.col("plain." + ".".join(f"`{n}`" for n in p)).between(-2**31, 2**31 - 1), F.lit(True)) for p, t in fields if t == T.IntegerType()]
    rows = _once(rows, {"is plain": reduce(Column.__and__, fits, F.col("plain").isNotNull())})
    rows = _once(rows, {"x ": F.when(~F.col("is plain"), F.col("json"))})
    for depth in sorted({len(path) for path, _ in fields}):
        rows = _once(rows, {_named("x", p): F.try_variant_get(_x(p[:-1]), f"$['{p[-1]}']", "variant") for p, _ in fields if len(p) == depth})
    rows = _once(rows, {_named("kind", p): F.schema_of_variant(_x(p)) for p, _ in fields})
    rows = _once(rows, {_named("value", p): _value(p, t) for p, t in fields if not isinstance(t, T.StructType)})
    faults = []
    for p, t in fields:
        odd = (~_is(p, "OBJECT") & ~F.to_json(_x(p)).isin(*_NOTHING) if isinstance(t, T.StructType)
               else F.col(f"`{_named('value', p)}`").isNull())
        faults.append(F.when(F.col(f"`{_named('kind', p)}`").isNotNull() & ~_is(p, "VOID") & odd, F.lit(".".join(p))))
    rows = _once(rows, {"wrong": F.concat_ws(", ", F.array_compact(F.array(*faults)))})
    blank = F.coalesce(F.trim("line"), F.lit("")) == ""
    reason = (F.when(blank, "empty").when(_x(()).isNull(), "not json")
              .when(~F.col("line").rlike(r"^\s*\{"), "not an object").when(F.col("wrong") != "", F.concat(F.lit("unreadable: "), "wrong")))
    document = [F.when(F.col("is plain"), F.col(f"plain.`{f.name}`").cast(f.dataType)).otherwise(c).alias(f.name) for f, c in zip(schema, _document(schema))]
    return rows.select(*document, "line", F.when(~F.col("is plain"), reason).alias("reason"))


def ingest_lines(lines: DataFrame, root: str, run: str, work: str, day: dt.date | None = None, column: str = "value",
                 provenance: str = "provenance") -> dict:
    """Files documents under ``raw`` and rejects, whole lines with their reasons, under ``rejected``. The rows of both add up to
    the lines read. Running it again replaces its own output."""
    kept = F.when(F.col("reason").isNotNull(), F.col("line"))  # a document's line is not read again
    parsed = stage(parse_lines(lines, column, provenance).withColumn("line", kept), work, "parsed-lines")
    names = [f"`{f.name}`" for f in raw_schema(provenance)]
    return {"raw": write_daily(parsed.filter("reason IS NULL").select(*names), f"{root}/raw", run, day),
            "rejected": write_daily(parsed.filter("reason IS NOT NULL").select("line", "reason"), f"{root}/rejected", run, day)}


def ingested(spark: SparkSession, root: str, run: str, provenance: str = "provenance") -> tuple[DataFrame, DataFrame]:
    """The raw documents of a run and its rejects (line, reason)."""
    return read_run(spark, f"{root}/raw", run, raw_schema(provenance)), read_run(spark, f"{root}/rejected", run, REJECT)
