"""Types of many packages as one table, and keys that tell types of the same structure.

A package numbers its types for itself. Globally a type is named by its text (repr), so nothing is numbered anew: references become
texts, and of packages that describe one type the first by import path counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import light

UNKNOWN = "?"
#: Nesting beyond this is unknown.
DEPTH = 200


def imported(types: DataFrame) -> DataFrame:
    """repr, kind, name, elem, key, array_len, chan_dir, fields, params, results, variadic, with texts in place of numbers; types: the fact table, with
    import_path. A reference to what the package doesn't have is unknown."""
    first = types.groupBy("repr").agg(F.min(F.struct("import_path", "type_id")).alias("_f")).select("_f.*")  # merged before they move: every package has an int
    first = light(first, "first-types")
    types = types.join(first.select("import_path").distinct(), "import_path", "left_semi")  # of other packages no table is needed
    ids = types.groupBy("import_path").agg(F.map_from_entries(F.collect_set(F.struct("type_id", "repr"))).alias("_m"))
    ref = lambda c: F.when(F.coalesce(c, F.lit(0)) != 0, F.coalesce(F.try_element_at("_m", c), F.lit(UNKNOWN)))
    many = lambda c: F.transform(c, lambda x: F.coalesce(ref(x), F.lit(UNKNOWN))).alias(c)
    fields = F.transform("fields", lambda f: F.struct(f["name"].alias("name"), F.coalesce(ref(f["type"]), F.lit(UNKNOWN)).alias("type"), f["embedded"].alias("embedded"))).alias("fields")
    one = types.join(first, ["import_path", "type_id"], "left_semi").join(ids, "import_path")
    return one.select("repr", "kind", "name", ref(F.col("elem")).alias("elem"), ref(F.col("key")).alias("key"), "array_len", "chan_dir", fields, many("params"), many("results"), "variadic")


def key_of(by: dict[int, dict], start: int, cache: dict[int, str], path: set[int]) -> str:
    """The key of a type by the table of its package: names of named and basic types, otherwise structure alone; where a type is reached again on the way
    into itself the key says so, once per way in."""
    if start in cache:
        return cache[start]
    t = by.get(start)
    if t is None:
        return UNKNOWN
    if start in path or len(path) >= DEPTH:
        return "~"
    path.add(start)
    k = lambda i: key_of(by, i or 0, cache, path)
    each = lambda xs: ",".join(map(k, xs or ()))
    kind = t["kind"]
    if kind == "Basic":
        out = t["name"]
    elif kind == "Named":
        out = f"{t['name']}={k(t['elem'])}"
    elif kind == "Array":
        out = f"[{t['array_len']}]({k(t['elem'])})"
    elif kind in ("Pointer", "Slice"):
        out = f"{'*' if kind == 'Pointer' else '[]'}({k(t['elem'])})"
    elif kind == "Map":
        out = f"map({k(t['key'])},{k(t['elem'])})"
    elif kind == "Chan":
        out = f"chan:{t['chan_dir'] or ''}({k(t['elem'])})"
    elif kind == "Struct":
        out = "struct{" + ",".join(f"{'+' if f['embedded'] else ''}{f['name']}:{k(f['type'])}" for f in t["fields"] or ()) + "}"
    elif kind == "Signature":
        out = f"func({each(t['params'])})({each(t['results'])}){'...' if t['variadic'] else ''}"
    elif kind == "Tuple":
        out = f"({each(t['params'] or t['results'])})"
    else:
        out = {"Interface": "interface", "TypeParam": "param"}.get(kind, UNKNOWN)
    path.remove(start)
    cache[start] = out
    return out


def structural_keys(types: DataFrame) -> DataFrame:
    """import_path, type_id, skey. A package's table is closed, so packages are independent of each other."""
    cols = ["type_id", "kind", "name", "elem", "key", "array_len", "chan_dir", "fields", "params", "results", "variadic"]
    one = types.groupBy("import_path").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("ts"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for p, ts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by, cache = {t["type_id"]: t for t in ts}, {}
                out += [(p, t["type_id"], key_of(by, t["type_id"], cache, set())) for t in ts]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.string()))], ["import_path", "type_id", "skey"])

    return one.mapInArrow(run, "import_path string, type_id int, skey string")
