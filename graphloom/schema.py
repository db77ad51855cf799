"""Schemas of the record types: scans, parsed files, events, snapshots, catalog rows."""

from __future__ import annotations

from pyspark.sql import types as T


def record(*fields: tuple[str, str | T.DataType]) -> T.StructType:
    plain = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType()}
    return T.StructType([T.StructField(name, plain.get(kind, kind) if isinstance(kind, str) else kind) for name, kind in fields])


STRINGS = T.ArrayType(T.StringType())
SCAN = record(("project", "string"), ("root", "string"), ("path", "string"), ("rel_path", "string"), ("ext", "string"), ("size", "long"))
DEFINITION = record(("name", "string"), ("line", "int"))
CALLS = record(("name", "string"), ("line", "int"), ("calls", STRINGS))
PARSED = record(
    ("language", "string"), ("line_count", "int"), ("functions", T.ArrayType(DEFINITION)), ("imports", STRINGS), ("calls", STRINGS), ("function_calls", T.ArrayType(CALLS))
)
AST = T.StructType([*record(("project", "string"), ("path", "string"), ("rel_path", "string")).fields, *PARSED.fields])
EVENT = record(
    ("file_pos", "long"), ("branch", "int"), ("i", "long"), ("kind", "string"), ("label", "string"), ("uid", "string"), ("type", "string"),
    ("src_label", "string"), ("src_uid", "string"), ("dst_label", "string"), ("dst_uid", "string"), ("props", T.MapType(T.StringType(), T.StringType())),
)
HASHES = record(("identity", "string"), ("hash", "string"))
CHURN = record(("project", "string"), ("rel_path", "string"), ("commits", "long"), ("added", "long"), ("removed", "long"))
