"""Schemas of the program-fact tables and constructors for small ones.

A program is held as a dozen flat DataFrames keyed by natural keys (function name, block number, instruction
number); nothing is interned, so no pass over all packages is needed before a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMA_VERSION = "4"

FACTS: dict[str, str] = {
    "package": "import_path string, schema_version string, go_version string, extractor_version string",
    "file": "import_path string, idx int, path string, sha256 string",
    "type": "type_id int, repr string, kind string, elem int, key int, array_len long, chan_dir string, fields array<struct<name: string, type: int, embedded: boolean>>, params array<int>, results array<int>, variadic boolean, name string",
    "func": "func string, import_path string, name string, sig int, has_body boolean, file string, line int, col int, result_names array<string>",
    "param": "func string, idx int, vid int, name string, type_id int",
    "freevar": "func string, idx int, vid int, name string, type_id int",
    "value": "func string, vid int, kind string, type_id int, const_kind string, const_bool boolean, const_int long, const_text string, const_bytes binary, ref_name string",
    "block": "func string, b int",
    "cfg_edge": "func string, src int, dst int, succ_pos int, pred_pos int",
    "wire": "func string, b int, i int, kind string, register int, type_id int, operands array<int>, file string, line int, col int, detail string, token string, field int, callee_kind string, callee string, iface int, method string, sig int, blocking boolean, comma_ok boolean, heap boolean, idx int",
    "instr": "func string, b int, i int, op string, dst int, type_id int, a0 int, a1 int, a2 int, a3 int, operands array<int>, field int, sub string, callee_kind string, callee string, iface int, method string, sig int, blocking boolean, comma_ok boolean, file string, line int, col int",
    "select_arm": "func string, b int, i int, arm int, dir string, chan int, send int",
    "method": "type_id int, name string, sig int, func string",
    "pragma": "decl_id string, text string, file string, line int, col int",
    "finding": "checker string, tag string, func string, file string, line int, col int, message string, severity string, trace array<struct<block: int, file: string, line: int, col: int>>, model array<struct<name: string, value: string>>",
    "effect": "func string, domain string, root_kind string, root_id string, path array<int>, op string",
    "clause": "func string, side string, tag string, provenance string, term string, ord int",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(FACTS[name])


def rows(spark: SparkSession, name: str, data: list[dict | tuple]) -> DataFrame:
    """A fact table from dicts (absent columns are null) or full tuples."""
    s = schema(name)
    full = [tuple(r.get(f.name) for f in s.fields) if isinstance(r, dict) else tuple(r) for r in data]
    return spark.createDataFrame(full, s)


def conforms(df: DataFrame, name: str) -> DataFrame:
    """df with exactly the table's columns and types. Raises ValueError where one is missing or of another type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    for f in schema(name).fields:
        if f.name not in have:
            raise ValueError(f"{name}: no column {f.name}")
        if have[f.name].simpleString() != f.dataType.simpleString():
            raise ValueError(f"{name}.{f.name}: {have[f.name].simpleString()} instead of {f.dataType.simpleString()}")
    return df.select(*[f.name for f in schema(name).fields])
