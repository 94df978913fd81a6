"""Java source files as tables: types with their extents, members, and calls that set up jobs.

Every file is read once, in its own task (``functions.javascan``), and its text never
shuffled. Names are looked up across files by joins on full names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shuffleworks.constants import MAIN_METHOD
from shuffleworks.functions.javascan import File
from shuffleworks.operators.corpus import classify_role
from shuffleworks.session import arrow_batches, durable

_FILES = 64  # files that are held as Python objects at once
BATCH_BYTES = "2m"  # of texts that a worker gets at once, where the scan is run here; Spark sends up to 64 MB otherwise

_TERMS = pa.list_(pa.struct([("text", pa.string()), ("name", pa.string())]))
_SCHEMA = pa.schema(
    [
        ("file_path", pa.string()),
        ("marks", pa.string()),
        ("package", pa.string()),
        ("imports", pa.list_(pa.string())),
        ("types", pa.list_(pa.struct([(n, pa.string()) for n in ("class_name", "qualified", "outer", "kind", "extends")] + [("implements", pa.list_(pa.string()))] + [(n, pa.int64()) for n in ("start", "body", "end")]))),
        ("methods", pa.list_(pa.struct([(n, pa.string()) for n in ("owner", "name")] + [(n, pa.int64()) for n in ("start", "body", "end")]))),
        ("fields", pa.list_(pa.struct([(n, pa.string()) for n in ("owner", "name", "java_type")] + [("is_static", pa.bool_()), ("is_final", pa.bool_()), ("terms", _TERMS)]))),
        (
            "calls",
            pa.list_(pa.struct([(n, pa.string()) for n in ("owner", "method", "var", "call")] + [("scope", pa.int64()), ("args", pa.list_(pa.struct([("class_name", pa.string()), ("terms", _TERMS)])))])),
        ),
    ]
)
_PLACE = "start:bigint,body:bigint,end:bigint"
_TERM = "array<struct<text:string,name:string>>"
_DDL = (
    "file_path string, marks string, package string, imports array<string>, "
    f"types array<struct<class_name:string,qualified:string,outer:string,kind:string,extends:string,implements:array<string>,{_PLACE}>>, "
    f"methods array<struct<owner:string,name:string,{_PLACE}>>, "
    f"fields array<struct<owner:string,name:string,java_type:string,is_static:boolean,is_final:boolean,terms:{_TERM}>>, "
    f"calls array<struct<owner:string,method:string,var:string,call:string,scope:bigint,args:array<struct<class_name:string,terms:{_TERM}>>>>"
)


def _pairs(terms) -> list[dict] | None:
    return None if terms is None else [{"text": text, "name": name} for text, name in terms]


def _scanned(path: str, marks: str, content: str) -> dict:
    file = File(content)
    owner = lambda number: file.types[number]["qualified"] if number is not None else ""
    of_method = lambda number: file.methods[number]
    return {
        "file_path": path,
        "marks": marks,
        "package": file.package,
        "imports": file.imports,
        "types": file.types,
        "methods": [m | {"owner": owner(m["type"])} for m in file.methods],
        "fields": [f | {"owner": owner(f["type"]), "terms": _pairs(f["terms"])} for f in file.fields],
        "calls": [
            {
                "owner": owner(of_method(c["method"])["type"]), "method": of_method(c["method"])["name"], "var": c["var"], "call": c["call"],
                # A variable of the method belongs to it, a field to the class.
                "scope": of_method(c["method"])["start"] if c["is_local"] else -1,
                "args": [{"class_name": name, "terms": _pairs(value)} for name, value in c["args"]],
            }
            for c in file.calls
        ],
    }


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is found goes out after a few files, so that a batch of long texts is never held a second time."""
    for batch in batches:
        for low in range(0, batch.num_rows, _FILES):
            files = batch.slice(low, _FILES)
            yield pa.RecordBatch.from_pylist([_scanned(*row) for row in zip(*[c.to_pylist() for c in files.columns])], _SCHEMA)


def scan(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row per file: package, imports (static ones begin with ``static``), types, methods, fields, calls.

    Extents are character offsets; ``owner`` is a type's name with those of its enclosing types. A null text has nothing in it.
    """
    text = F.coalesce(F.col(content), F.lit(""))
    marks = F.concat_ws(" ", F.when(text.contains(MAIN_METHOD), MAIN_METHOD), F.when(text.contains("Job"), "Job"))
    return files.select(F.col(path).alias("file_path"), marks.alias("marks"), text).mapInArrow(_scan, _DDL)


def scan_once(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``scan``, run now in small batches and kept, for results that are read several times."""
    with arrow_batches(files.sparkSession, BATCH_BYTES):
        return durable(scan(files, path, content))


def scan_classes(scanned: DataFrame) -> DataFrame:
    """One row per class, in the order in which they begin: the columns of ``extract_classes``, and

    ``qualified`` (with the enclosing types' names), ``outer``, and the extent ``start, body, end``. Interfaces,
    enums and records enclose classes but are none.
    """
    plain = F.filter("imports", lambda i: ~i.startswith("static "))
    types = scanned.select("file_path", "package", "marks", plain.alias("imports"), F.posexplode(F.filter("types", lambda t: t["kind"] == "class")).alias("class_pos", "t"))
    role = classify_role(F.col("t.class_name"), F.col("t.extends"), F.col("t.implements"), F.col("imports"), F.col("marks"))
    return types.select(
        "t.class_name", "file_path", "class_pos", "package", role.alias("role"), "imports", "t.extends", "t.implements", "t.qualified", "t.outer", "t.start", "t.body", "t.end"
    )


def scan_methods(scanned: DataFrame) -> DataFrame:
    """``file_path, package, class, method, start, body, end``; a class's methods are those of its own body."""
    return scanned.select("file_path", "package", F.explode("methods").alias("m")).select("file_path", "package", F.col("m.owner").alias("class"), F.col("m.name").alias("method"), "m.start", "m.body", "m.end")


def scan_fields(scanned: DataFrame) -> DataFrame:
    """``file_path, package, class, pos, name, java_type, is_static, is_final, terms``; fields of a class's own body, in order."""
    each = scanned.select("file_path", "package", "imports", F.posexplode("fields").alias("pos", "f"))
    return each.select("file_path", "package", "imports", F.col("f.owner").alias("class"), "pos", "f.name", "f.java_type", "f.is_static", "f.is_final", "f.terms")


def full_names(ref: Column, owner: Column, package: Column, imports: Column) -> Column:
    """Where a name used inside ``owner`` may be declared, the first that is there counts.

    In the enclosing types outwards, by the import of its first part, in the package, in the
    packages imported whole, and as it stands.
    """
    dotted = lambda *parts: F.concat_ws(".", *[F.when(p != "", p) for p in parts])
    package = F.coalesce(package, F.lit(""))
    levels = F.split(owner, r"\.")
    depth = F.size(levels)
    outwards = F.transform(F.sequence(F.lit(1), depth), lambda i: dotted(package, F.array_join(F.slice(levels, F.lit(1), depth + 1 - i), "."), ref))
    first, rest = F.substring_index(ref, ".", 1), F.regexp_extract(ref, r"^[^.]*\.(.*)$", 1)
    named = F.transform(imports, lambda i: F.regexp_replace(i, "^static ", ""))
    own = F.transform(F.filter(named, lambda i: i.endswith(F.concat(F.lit("."), first))), lambda i: dotted(i, rest))
    whole = F.transform(F.filter(named, lambda i: i.endswith(".*")), lambda i: dotted(F.regexp_replace(i, r"\.\*$", ""), ref))
    return F.array_distinct(F.concat(outwards, own, F.array(dotted(package, ref)), whole, F.array(ref)))


def names_left(terms: Column) -> Column:
    """Whether a value has names of constants in it; false for one that is not told."""
    return F.coalesce(F.exists(terms, lambda t: t["name"].isNotNull()), F.lit(False))


def _filled(rows: DataFrame, constants: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, terms`` of rows with names in their terms, these replaced by the terms of the constants they name."""
    each = rows.select(*keys, "owner", "package", "imports", F.posexplode("terms").alias("_at", "_t"))
    tried = each.select(*keys, "_at", "_t", F.explode_outer(F.when(F.col("_t.name").isNotNull(), F.transform(
        full_names(F.col("_t.name"), F.col("owner"), F.col("package"), F.col("imports")), lambda n, i: F.struct(i.alias("turn"), n.alias("_full"))
    ))).alias("_n")).select(*keys, "_at", "_t", "_n.turn", "_n._full")
    found = tried.join(constants.select(F.col("full").alias("_full"), "value"), "_full", "left")
    hit = F.min(F.when(F.col("value").isNotNull(), F.struct("turn", "value")))["value"]
    own = F.when(F.col("_t.text").isNotNull(), F.array("_t"))
    put = found.groupBy(*keys, "_at", "_t").agg(hit.alias("_hit")).select(*keys, F.struct("_at", F.coalesce(own, "_hit").alias("v")).alias("_p"))
    # A term that is known nowhere makes the whole unknown.
    parts = F.transform(F.array_sort(F.collect_list("_p")), lambda p: p["v"])
    return put.groupBy(*keys).agg(F.when(F.bool_and(F.col("_p.v").isNotNull()), F.flatten(parts)).alias("terms"))


def resolve_constants(scanned: DataFrame) -> DataFrame:
    """``full, value``: every constant's terms, names of other constants replaced, round by round.

    A constant that is defined by itself, or by a name that is nowhere declared, has no row. Of
    copies of a file the first by path counts.
    """
    fields = scan_fields(scanned).where("terms is not null")
    full = F.concat_ws(".", "package", F.when(F.col("class") != "", F.col("class")), "name")
    one = fields.groupBy(full.alias("full")).agg(F.min_by(F.struct(F.col("class").alias("owner"), "package", "imports", "terms"), F.struct("file_path", -F.col("pos"))).alias("f"))
    todo = one.select("full", "f.*")
    done = todo.where(~names_left(F.col("terms"))).select("full", F.col("terms").alias("value"))
    todo = todo.where(names_left(F.col("terms")))
    if todo.isEmpty():
        return done
    done, todo = durable(done), durable(todo)
    while True:
        now = _filled(todo, done, ["full"]).where("terms is not null").select("full", F.col("terms").alias("value"))
        now = durable(now)  # each round settles the constants whose names are all settled
        if now.isEmpty():
            return done
        done = done.unionByName(now)
        todo = durable(todo.join(now, "full", "left_anti"))


def texts(rows: DataFrame, constants: DataFrame | None, keys: list[str]) -> DataFrame:
    """``keys, text``: the text of each row's ``terms``, null if they do not tell it. Keys are unique and not null."""
    joined = lambda terms: F.array_join(F.transform(terms, lambda t: t["text"]), "")
    plain = rows.where(~names_left(F.col("terms"))).select(*keys, joined(F.col("terms")).alias("text"))
    if constants is None:
        return plain
    named = rows.where(names_left(F.col("terms")))
    return plain.unionByName(_filled(named, constants, keys).select(*keys, joined(F.col("terms")).alias("text")))
