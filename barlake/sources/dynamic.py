"""Datasets whose keys come from the data: unknown JSONL, snapshots, collector meta.

Keys are flattened inside the row (no shuffle) into ``fields``, a map from
``a_b_c`` to text. :func:`widen` turns chosen keys into typed columns, and
:func:`field_names` lists the keys a table holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType

from barlake.functions import maybe_numeric, symbol_or, to_int, truthy, ts_from_ms
from barlake.functions.text import stripped
from barlake.sources.lines import JSON_OPTIONS, valid_docs

DOC = "MAP<STRING, VARIANT>"
ENTRIES = "ARRAY<STRUCT<key: STRING, value: VARIANT, inner: MAP<STRING, VARIANT>>>"


def _entry(key: Column, value: Column) -> Column:
    """A key, its value, and the value's own entries if it is an object."""
    return F.struct(key.alias("key"), value.alias("value"), value.try_cast(DOC).alias("inner"))


def _entries(doc: Column) -> Column:
    return F.transform(F.map_entries(doc), lambda e: _entry(e["key"], e["value"]))


def _opened(entries: Column) -> Column:
    """Replace every object in an entry list by its own entries, under joined keys."""
    def inner(e: Column) -> Column:
        return F.transform(
            F.map_entries(e["inner"]), lambda x: _entry(F.concat(e["key"], F.lit("_"), x["key"]), x["value"])
        )

    return F.flatten(F.transform(entries, lambda e: F.when(e["inner"].isNotNull(), inner(e)).otherwise(F.array(e))))


def _text(value: Column, plain: Column) -> Column:
    """Text of a leaf from its plain text: decimals keep a fraction, '' is null."""
    kind = F.schema_of_variant(value)
    spelled_out = F.concat(
        F.regexp_replace(value.try_cast("decimal(38, 18)").cast("string"), "0+$", ""), F.lit("0")
    )
    # a decimal without a fraction was one in the source, unless it is a whole number too long for a LONG
    whole = ~plain.contains(".") & F.right(plain, F.lit(1)).between("0", "9") & (F.length(plain) < 19)
    return (
        F.when(whole & kind.startswith("DECIMAL"), F.concat(plain, F.lit(".0")))
        .when(plain.contains("E") & (kind == "DOUBLE"), F.coalesce(spelled_out, plain))
        .otherwise(F.nullif(plain, F.lit("")))
    )


def _to_map(entries: Column) -> Column:
    """Leaves as map<key, text>; lists and objects kept whole become compact JSON."""
    plain = F.transform(
        entries, lambda e: F.struct(e["key"], e["value"], stripped(e["value"].cast("string")).alias("plain"))
    )
    return F.map_from_entries(F.transform(plain, lambda e: F.struct(e["key"], _text(e["value"], e["plain"]))))


def flattener() -> Callable[[str], dict[str, str | None] | None]:
    """A function from a text to its flattened keys and texts, null for a text that is not one JSON object.

    One pass in the order of the text. Texts of more than some 900 levels count
    as broken. It holds all it needs, so workers take it without the package.
    """
    import json
    from decimal import Decimal

    compact = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False).encode
    decode = json.loads

    def other(value: object) -> str | None:
        """Text of a value that is neither string, whole number nor object: numbers keep a fraction, without exponent."""
        if value is None:
            return None
        plain = compact(value)
        if isinstance(value, float) and plain[-1].isdigit():
            plain = format(Decimal(plain), "f") if "e" in plain else plain
            return plain if "." in plain else f"{plain}.0"
        return plain

    def walk(prefix: str, doc: dict, out: dict[str, str | None]) -> None:
        for key, value in doc.items():
            name = f"{prefix}_{key}" if prefix else key
            kind = type(value)
            if kind is str:
                out[name] = value.strip() or None
            elif kind is int:
                out[name] = str(value)
            elif kind is dict:
                walk(name, value, out)
            else:
                out[name] = other(value)

    def flat(line: str) -> dict[str, str | None] | None:
        out: dict[str, str | None] = {}
        try:
            doc = decode(line)
            if type(doc) is not dict:
                return None
            walk("", doc, out)
        except (ValueError, RecursionError):
            return None
        return out

    return flat


def _flattened(texts: DataFrame) -> DataFrame:
    """The texts that are one JSON object, with ``fields`` (map of a_b_c to text) for ``value``.

    Of keys that meet when joined, the last one in the text counts. VARIANT can
    tell neither their order nor open objects of any depth in one pass, so the
    text is read by a JSON reader in Arrow batches.
    """
    carried = [c for c in texts.columns if c != "value"]
    schema = StructType([*(texts.schema[c] for c in carried), StructField("fields", MapType(StringType(), StringType()))])
    flat = flattener()

    def strings(values: list) -> pa.Array:
        try:
            return pa.array(values, pa.string())
        except UnicodeEncodeError:  # half a surrogate pair is no character
            return pa.array([v if v is None else v.encode("utf-8", "replace").decode() for v in values], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, ends, keys, values = [], [0], [], []
            for line in batch.column(0).to_pylist():
                fields = None if line is None else flat(line)
                good.append(fields is not None)
                if fields is not None:
                    keys += fields
                    values += fields.values()
                    ends.append(len(keys))
            maps = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), strings(keys), strings(values))
            rows = batch.filter(pa.array(good, pa.bool_())).columns[1:]
            yield pa.RecordBatch.from_arrays([*rows, maps], [*carried, "fields"])

    return texts.select("value", *carried).mapInArrow(run, schema)


def generic_jsonl(texts: DataFrame) -> DataFrame:
    """Any object per line; time is the first filled one of ts, timestamp, time."""
    docs = _flattened(texts)
    fields = F.col("fields")
    time = F.coalesce(truthy(fields["ts"]), truthy(fields["timestamp"]), fields["time"])
    ts_ms = to_int(F.col("_time"))
    return docs.withColumn("_time", time).select(
        symbol_or(fields["symbol"], F.col("path_symbol")).alias("symbol"),
        ts_ms.alias("ts_ms"),
        ts_from_ms(ts_ms).alias("ts"),
        "fields", "path_symbol",
        *[c for c in docs.columns if c not in ("fields", "path_symbol")],
    )


def snapshot(texts: DataFrame) -> DataFrame:
    """Instrument or ticker document: one row of flattened keys."""
    docs = _flattened(texts)
    return docs.select(
        symbol_or(F.col("fields")["symbol"], F.col("path_symbol")).alias("symbol"),
        "fields", "path_symbol",
        *[c for c in docs.columns if c not in ("fields", "path_symbol")],
    )


def meta(texts: DataFrame) -> DataFrame:
    """Collector state: top-level keys, and ``endpointState`` as text and as ``{endpoint}_{key}``."""
    docs = valid_docs(texts, DOC, keep_text=True)
    carried = [c for c in docs.columns if c not in ("doc", "value", "path_symbol")]
    state = F.try_element_at("doc", F.lit("endpointState"))
    opened = F.coalesce(_opened(_entries(state.try_cast(DOC))), F.array().cast(ENTRIES))
    # in the state's own place, so that of keys that meet the last one in the text counts
    entries = F.flatten(F.transform(
        _entries(F.col("doc")), lambda e: F.when(e["key"] == "endpointState", opened).otherwise(F.array(e))
    ))
    # a VARIANT sorts the keys of objects; the text keeps them as they came
    kept = F.from_json("value", "endpointState STRING", JSON_OPTIONS)["endpointState"]
    state_text = F.when(F.schema_of_variant(state).rlike("^(OBJECT|ARRAY)"), kept).otherwise(F.to_json(state))
    fields = F.col("fields")
    rows = docs.select(
        _to_map(entries).alias("fields"),
        state_text.alias("endpoint_state_json"),
        "path_symbol", *carried,
    )
    times = {"listing_time": "listingTimeMs", "collected_from": "collectedFromMs", "collected_to": "collectedToMs"}
    return rows.select(
        symbol_or(fields["symbol"], F.col("path_symbol")).alias("symbol"),
        "endpoint_state_json",
        *[ts_from_ms(to_int(fields[key])).alias(name) for name, key in times.items()],
        "fields", "path_symbol", *carried,
    )


def field_names(rows: DataFrame) -> DataFrame:
    """Distinct flattened keys of a table (schema-sized result)."""
    return _exploded(rows, []).select("field").distinct()


def _exploded(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row per key. The outer form keeps the optimizer from testing for empty maps up front,
    which would flatten every document twice."""
    return rows.select(*keep, F.explode_outer("fields").alias("field", "_text")).where(F.col("field").isNotNull())


def widen(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Chosen keys as columns of the given types; what does not fit the type is null."""
    typed = [F.try_element_at("fields", F.lit(k)).try_cast(t).alias(k) for k, t in columns.items()]
    return rows.select(*[c for c in rows.columns if c != "fields" and c not in columns], *typed)


#: Types of keys from the narrowest to the widest; a key without a filled value has none.
KEY_TYPES = ["void", "bigint", "double", "string"]


def key_types(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., field, type): the narrowest type that all filled values of a key fit, for each group."""
    value = maybe_numeric(F.col("_text"))
    counts = _exploded(rows, list(by)).select(*by, "field", value.alias("_v")).groupBy(*by, "field").agg(
        F.count("_v.value_str").alias("_n"), F.count("_v.value_long").alias("_whole"), F.count("_v.value_double").alias("_number"),
    )
    kind = F.when(F.col("_n") == 0, "void").when(F.col("_whole") == F.col("_n"), "bigint").when(F.col("_number") == F.col("_n"), "double")
    return counts.select(*by, "field", kind.otherwise("string").alias("type"))


def merged_types(types: DataFrame) -> DataFrame:
    """(field, type): the widest type of each key over all groups; one row per key. A key that is never filled is text."""
    rank = F.array_position(F.array(*[F.lit(t) for t in KEY_TYPES]), F.col("type"))
    widest = types.where("field is not null").groupBy("field").agg(F.max(rank).alias("_rank"))
    names = F.array(*[F.lit(t if t != "void" else "string") for t in KEY_TYPES])
    return widest.select("field", F.element_at(names, F.col("_rank").cast("int")).alias("type"))


def with_key_columns(rows: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """The rows with every key that is no column yet as a typed column, in the order of names; ``fields`` stays.

    ``types`` are known :func:`key_types`; without them one pass over the rows
    finds them. What passes through the driver is one row per key, like a schema.
    """
    found = {r["field"]: r["type"] for r in merged_types(key_types(rows) if types is None else types).collect()}
    known = {c.lower() for c in rows.columns}
    typed = []
    for key in sorted(found):
        if key.lower() not in known:
            known.add(key.lower())  # names differ in more than case
            typed.append(F.try_element_at("fields", F.lit(key)).try_cast(found[key]).alias(key))
    return rows.select("*", *typed)


def long_form(rows: DataFrame) -> DataFrame:
    """One row per key, with the text and its numeric readings."""
    keep = [c for c in rows.columns if c != "fields"]
    return (
        _exploded(rows, keep)
        .select(*keep, "field", maybe_numeric(F.col("_text")).alias("_v"))
        .select(*keep, "field", "_v.value_str", "_v.value_long", "_v.value_double")
    )
