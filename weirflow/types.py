"""The dataflow type system: DT_ names and pipeline column codes as Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

# Type names and column codes of the package format, with the Spark type of each.
DT_TYPES: dict[str, T.DataType] = {
    "DT_BOOL": T.BooleanType(),
    "DT_I1": T.ByteType(),
    "DT_I2": T.ShortType(),
    "DT_I4": T.IntegerType(),
    "DT_I8": T.LongType(),
    "DT_UI1": T.ShortType(),
    "DT_UI2": T.IntegerType(),
    "DT_UI4": T.LongType(),
    "DT_UI8": T.LongType(),
    "DT_R4": T.FloatType(),
    "DT_R8": T.DoubleType(),
    "DT_FLOAT": T.DoubleType(),
    "DT_CY": T.DecimalType(19, 4),
    "DT_DATE": T.TimestampNTZType(),
    "DT_DBDATE": T.DateType(),
    "DT_DBTIME": T.StringType(),
    "DT_DBTIME2": T.StringType(),
    "DT_DBTIMESTAMP": T.TimestampNTZType(),
    "DT_DBTIMESTAMP2": T.TimestampNTZType(),
    "DT_DBTIMESTAMPOFFSET": T.TimestampType(),
    "DT_STR": T.StringType(),
    "DT_WSTR": T.StringType(),
    "DT_TEXT": T.StringType(),
    "DT_NTEXT": T.StringType(),
    "DT_IMAGE": T.BinaryType(),
    "DT_BYTES": T.BinaryType(),
    "DT_GUID": T.StringType(),
    "DT_FILETIME": T.LongType(),
}
PIPELINE_CODES = {
    "bool": "DT_BOOL", "i1": "DT_I1", "i2": "DT_I2", "i4": "DT_I4", "i8": "DT_I8", "ui1": "DT_UI1", "ui2": "DT_UI2",
    "ui4": "DT_UI4", "ui8": "DT_UI8", "r4": "DT_R4", "r8": "DT_R8", "cy": "DT_CY", "decimal": "DT_DECIMAL",
    "numeric": "DT_NUMERIC", "date": "DT_DATE", "dbDate": "DT_DBDATE", "dbTime": "DT_DBTIME", "dbTimeStamp": "DT_DBTIMESTAMP",
    "dbTimeStamp2": "DT_DBTIMESTAMP2", "str": "DT_STR", "wstr": "DT_WSTR", "text": "DT_TEXT", "nText": "DT_NTEXT",
    "image": "DT_IMAGE", "bytes": "DT_BYTES", "guid": "DT_GUID",
}
#: OLE DB parameter type codes.
OLEDB_CODES = {2: "DT_I2", 3: "DT_I4", 4: "DT_R4", 5: "DT_R8", 6: "DT_CY", 7: "DT_DATE", 8: "DT_WSTR", 11: "DT_BOOL", 20: "DT_I8", 72: "DT_GUID", 129: "DT_STR", 130: "DT_WSTR", 131: "DT_NUMERIC", 135: "DT_DBTIMESTAMP"}


def spark_type(name: str, *args: int, cast: bool = False) -> T.DataType:
    """The Spark type of a DT_ name or a pipeline code; ``args`` are length, precision or scale as the type has them.

    Unsigned types are widened. As the target of a cast DT_DATE is a date; as a column's type it is a timestamp.
    """
    dt = PIPELINE_CODES.get(name) or PIPELINE_CODES.get(name.lower()) or name.upper()
    if dt == "DT_DECIMAL":
        return T.DecimalType(38, args[0] if args else 0)
    if dt == "DT_NUMERIC":
        precision, scale = (*args, *(18, 0)[len(args) :])[:2]
        return T.DecimalType(precision or 18, scale)
    if cast and dt == "DT_DATE":
        return T.DateType()
    if dt not in DT_TYPES:
        raise ValueError(f"unknown type {name}")
    return DT_TYPES[dt]


def field(name: str, code: str, length: int = 0, precision: int = 0, scale: int = 0, source: str | None = None) -> T.StructField:
    """A column of a package as a field; what Spark's type does not hold is kept as metadata."""
    args = {"DT_NUMERIC": (precision, scale), "DT_DECIMAL": (scale,)}.get(PIPELINE_CODES.get(code, code.upper()), ())
    meta = {"type": code, "length": length} | ({"source": source} if source else {})
    return T.StructField(name, spark_type(code, *args), True, meta)


def ddl(table: str, schema: T.StructType, dialect: str = "spark") -> str:
    """CREATE TABLE for a schema, in Spark's dialect or in T-SQL."""
    tsql = {"boolean": "BIT", "tinyint": "SMALLINT", "int": "INT", "double": "FLOAT", "float": "REAL", "string": "NVARCHAR(MAX)", "binary": "VARBINARY(MAX)", "timestamp": "DATETIMEOFFSET", "timestamp_ntz": "DATETIME2"}
    quote = (lambda n: f"`{n}`") if dialect == "spark" else (lambda n: f"[{n}]")
    kinds = [f.dataType.simpleString() for f in schema]
    if dialect != "spark":
        kinds = [f"NVARCHAR({f.metadata['length']})" if k == "string" and f.metadata.get("length") else tsql.get(k, k.upper()) for k, f in zip(kinds, schema, strict=True)]
    columns = ", ".join(f"{quote(f.name)} {k.upper()}" for k, f in zip(kinds, schema, strict=True))
    return f"CREATE TABLE {quote(table)} ({columns})" + " USING parquet" * (dialect == "spark")
