"""Names, version ids, timestamps and JSON as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def camel_to_snake(c: Column) -> Column:
    """Digits stay with the letters before them."""
    parted = F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1_$2"), r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(parted)


def snake_to_camel(c: Column) -> Column:
    parts = F.split(c, "_")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p))))
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))


def clean_columns(df: DataFrame) -> DataFrame:
    """Column names in lower case, white space and dashes as underscores."""
    import re

    return df.toDF(*(re.sub(r"[\s-]", "_", c.lower()) for c in df.columns))


def same_version(a: Column, b: Column) -> Column:
    """Version ids match if one begins with the other."""
    return a.startswith(b) | b.startswith(a)


def is_full_version(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{32}$")


def expand_version(versions: DataFrame, prefix: str, col: str = "uuid") -> DataFrame:
    """(uuid): the one version that begins with the prefix; raises unless there is exactly one."""
    hit = versions.where(F.col(col).startswith(prefix)).agg(F.count("*").alias("n"), F.min(col).alias(col))
    return hit.select(F.when(F.col("n") == 1, F.col(col)).otherwise(F.raise_error(F.concat(F.lit(f"versions that begin with {prefix}: "), F.col("n").cast("string"))).cast("string")).alias(col))


def local_timestamp(c: Column, zone: str = "US/Eastern", default: str = "2018-01-01") -> Column:
    """UTC instant of a local time text; null stands for the default."""
    return F.to_utc_timestamp(F.to_timestamp(F.coalesce(c, F.lit(default))), zone)


def log_timestamp(line: Column) -> Column:
    """Timestamp of a log line that ends its JSON's Timestamp with nanoseconds and zone; cut to microseconds."""
    text = F.regexp_extract(line, r'"Timestamp"\s*:\s*"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)', 1)
    return F.to_timestamp(F.when(text != "", text))


def join_int_lists(c: Column) -> Column:
    """JSON text whose lists of integers stand on one line."""
    return F.regexp_replace(F.regexp_replace(c, r"(-?\d+),\s*\n\s*(?=-?\d)", "$1, "), r"\[\s*\n\s*(-?\d[^\[\]{}\"]*?)\s*\n\s*\]", "[$1]")


def nan_to_text(c: Column, text: str = "nan") -> Column:
    return F.when(F.isnan(c), F.lit(text)).otherwise(c.cast("string"))


def nested_keys(schema: T.DataType, prefix: str = "") -> list[str]:
    """Paths of all fields of a nested type."""
    out: list[str] = []
    if isinstance(schema, T.ArrayType):
        return nested_keys(schema.elementType, prefix)
    if isinstance(schema, T.StructType):
        for f in schema.fields:
            path = f"{prefix}.{f.name}" if prefix else f.name
            out += [path, *nested_keys(f.dataType, path)]
    return out


def merge_schemas(a: T.StructType, b: T.StructType) -> T.StructType:
    """Fields of both, nested structs merged; of other conflicts the first type stays."""
    out = {f.name: f for f in a.fields}
    for f in b.fields:
        own = out.get(f.name)
        if own is None:
            out[f.name] = f
        elif isinstance(own.dataType, T.StructType) and isinstance(f.dataType, T.StructType):
            out[f.name] = T.StructField(f.name, merge_schemas(own.dataType, f.dataType), own.nullable or f.nullable)
    return T.StructType(list(out.values()))


def unsigned_to_long(df: DataFrame) -> DataFrame:
    """Decimals without a fraction (as unsigned 64-bit columns arrive) as LONG, nested ones too; raises on overflow."""

    def fixed(t: T.DataType) -> T.DataType:
        if isinstance(t, T.DecimalType) and t.scale == 0:
            return T.LongType()
        if isinstance(t, T.ArrayType):
            return T.ArrayType(fixed(t.elementType), t.containsNull)
        if isinstance(t, T.MapType):
            return T.MapType(fixed(t.keyType), fixed(t.valueType), t.valueContainsNull)
        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(f.name, fixed(f.dataType), f.nullable) for f in t.fields])
        return t

    return df.select(*(F.col(f"`{f.name}`").cast(fixed(f.dataType)).alias(f.name) for f in df.schema.fields))


def require_no_nulls(df: DataFrame, columns: list[str], policy: str = "error") -> DataFrame:
    """Nullable integers: error raises on a null, makefloat turns the column to doubles, skip leaves it."""
    if policy == "skip":
        return df
    if policy == "makefloat":
        return df.withColumns({c: F.col(c).cast("double") for c in columns})
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"null in {c}")).cast(df.schema[c].dataType)) for c in columns})


def narrowest_int(most: int) -> str:
    """The smallest integer type that holds 0..most."""
    return next(t for t, b in (("byte", 7), ("short", 15), ("int", 31), ("long", 63)) if most < 1 << b)
