"""Job tables: jobs from documents, jobs from driver sources, and chains of jobs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shuffleworks.constants import (
    DEFAULT_COMPLEXITY,
    DEFAULT_INPUT_FORMAT,
    DEFAULT_INPUT_PATHS,
    DEFAULT_OUTPUT_FORMAT,
    DEFAULT_OUTPUT_PATHS,
    JOB_CALLS,
    MISSING_JOBS_ERROR,
)
from shuffleworks.operators import javasource
from shuffleworks.session import arrow_batches, durable

_CLASS = "struct<class_name:string,role:string>"
_GRAPH_SCHEMA = "jobs array<string>, chain_count int, complexity string"
_JOB_SCHEMA = (
    f"job_name string, driver {_CLASS}, mapper {_CLASS}, reducer {_CLASS}, combiner {_CLASS}, "
    f"partitioner {_CLASS}, composite_keys array<{_CLASS}>, input_paths array<string>, "
    "output_paths array<string>, input_format string, output_format string, chained_after string"
)


def _has_key(document: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(document), key), F.lit(False))


def _job_list(document: Column) -> Column:
    """Whether the document has a list of jobs."""
    jobs = F.get_json_object(document, "$.jobs")
    return F.coalesce(_has_key(document, "jobs") & F.substring(F.ltrim(jobs), 1, 1).eqNullSafe("["), F.lit(False)) & (
        F.coalesce(F.from_json(document, _GRAPH_SCHEMA)["jobs"].isNotNull(), F.lit(False))
    )


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def normalise_jobs(df: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(one row per job, rows without a job list and the error: the key is missing, or not a list).

    A default stands in for a key that is missing; an explicit null stays null.
    The other columns of ``df`` are carried along.
    """
    document = F.col(raw)
    others = [c for c in df.columns if c != raw]
    has_jobs, is_list = _has_key(document, "jobs"), _job_list(document)
    reason = F.when(~has_jobs, MISSING_JOBS_ERROR).otherwise(F.lit("'jobs' is not a list"))
    errors = df.where(~is_list).select(*others, reason.alias("error"))
    each = df.where(is_list).select(
        *others, F.posexplode(F.from_json(document, _GRAPH_SCHEMA)["jobs"]).alias("job_pos", "_raw")
    )
    parsed = each.select(
        *others,
        "job_pos",
        F.from_json("_raw", _JOB_SCHEMA).alias("_j"),
        F.coalesce(F.json_object_keys("_raw"), F.array().cast("array<string>")).alias("_keys"),
    )

    def or_default(name: str, default: Column) -> Column:
        given = F.array_contains("_keys", name)
        return F.when(given, F.col(f"_j.{name}")).otherwise(default).alias(name)

    def name_of(role: str) -> Column:
        return F.col(f"_j.{role}.class_name").alias(role)

    jobs = parsed.select(
        *others,
        "job_pos",
        F.col("_j.job_name").alias("job_name"),
        *[name_of(r) for r in ("driver", "mapper", "reducer", "combiner", "partitioner")],
        F.when(F.array_contains("_keys", "composite_keys"), F.col("_j.composite_keys.class_name"))
        .otherwise(F.array().cast("array<string>"))
        .alias("composite_keys"),
        or_default("input_paths", _strings(DEFAULT_INPUT_PATHS)),
        or_default("output_paths", _strings(DEFAULT_OUTPUT_PATHS)),
        or_default("input_format", F.lit(DEFAULT_INPUT_FORMAT)),
        or_default("output_format", F.lit(DEFAULT_OUTPUT_FORMAT)),
        F.col("_j.chained_after").alias("chained_after"),
    )
    return jobs, errors


def graph_summary(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Per document with a job list: ``n_jobs, chain_count, complexity``, defaults for missing keys."""
    document = F.col(raw)
    others = [c for c in df.columns if c != raw]
    parsed = df.where(_job_list(document)).withColumn("_g", F.from_json(document, _GRAPH_SCHEMA))
    n_jobs = F.size("_g.jobs")
    return parsed.select(
        *others,
        n_jobs.alias("n_jobs"),
        F.when(_has_key(document, "chain_count"), F.col("_g.chain_count")).otherwise(n_jobs).alias("chain_count"),
        F.when(_has_key(document, "complexity"), F.col("_g.complexity"))
        .otherwise(F.lit(DEFAULT_COMPLEXITY))
        .alias("complexity"),
    )


_SLOTS = ["mapper", "combiner", "reducer", "partitioner"]
_FORMATS = {"input_format": DEFAULT_INPUT_FORMAT, "output_format": DEFAULT_OUTPUT_FORMAT}
_SETTER = r"\.\s*set(?:Mapper|Combiner|Reducer|Partitioner)Class\b"
_JOB = ["file_path", "owner", "scope", "var"]


def _settings(scanned: DataFrame) -> DataFrame:
    """One row per value a job is given: its file, type, method and variable, where, what for, and the argument."""
    calls = scanned.select("file_path", "package", "imports", F.posexplode("calls").alias("at", "c"))
    slot = F.lit(None).cast("string")
    for call, name in JOB_CALLS.items():
        slot = F.when(F.col("c.call") == call, name).otherwise(slot)
    args = F.when(F.col("c.call") == "setInputPaths", F.col("c.args")).otherwise(F.slice("c.args", 1, 1))
    each = calls.select(*_JOB[:1], "package", "imports", "c.owner", "c.scope", "c.method", "c.var", "c.call", slot.alias("slot"), "at", F.posexplode(args).alias("arg", "a"))
    return each.select(*_JOB, "package", "imports", "method", "call", "slot", "at", "arg", F.col("a.class_name").alias("ref"), "a.terms")


def assemble_jobs(files: DataFrame, classes: DataFrame, path: str = "path", content: str = "content", constants: DataFrame | None = None, scanned: DataFrame | None = None) -> DataFrame:
    """One row per job: per variable on which a class sets job classes.

    A job belongs to the type whose body the calls stand in, and to the method that declares its
    variable (to the type, if the variable is a field). ``job_name, package, driver, method, job_var,
    title, file_path``; for mapper, combiner, reducer and partitioner the class the driver names and
    the file it is declared in (null when unknown); ``input_paths, output_paths, input_format,
    output_format, chained_after``. A setter overwrites; paths are added unless set. Paths, formats
    and titles are followed through local variables and constants of any file (``constants``, by
    default those of ``files``); what the text does not tell is null, a format that is never set is
    the default. A driver's only job has the driver's name, several have the variable's added, and
    the method's where that is not enough. ``chained_after`` is another job that writes one of the input
    paths, the first by file and name. Names are looked up in the enclosing types, by import and
    package; copies of a class count once, by first path. ``scanned``, if there is one, is that of
    ``files`` by ``javasource.scan``; the files are not read again then. Paths of files are not null.
    """
    found = scanned if scanned is not None else javasource.scan(files.where(F.col(content).rlike(_SETTER)), path, content)
    with arrow_batches(files.sparkSession, javasource.BATCH_BYTES):
        settings = durable(_settings(found))  # small: file texts are gone
    jobs = settings.where(F.col("slot").isin(_SLOTS)).select(*_JOB).distinct()
    settings = settings.join(jobs, _JOB, "left_semi")

    # Classes: the last call per slot, looked up by full name.
    classed = settings.where(F.col("slot").isin(_SLOTS + list(_FORMATS)))
    last = classed.groupBy(*_JOB, "slot").agg(F.max_by(F.struct("ref", "package", "imports"), F.struct("at", -F.col("arg"))).alias("s")).select(*_JOB, "slot", "s.*")
    places = javasource.full_names(F.col("ref"), F.col("owner"), F.col("package"), F.col("imports"))
    tried = last.select(*_JOB, "slot", F.substring_index("ref", ".", -1).alias("name"), F.posexplode_outer(places).alias("_turn", "_full"))
    name = F.col("qualified") if "qualified" in classes.columns else F.col("class_name")
    declared = classes.groupBy(F.concat_ws(".", "package", name).alias("_full")).agg(F.min("file_path").alias("_declared_in"))
    found = tried.join(declared, "_full", "left")

    def of(slot: str, value: Column) -> Column:
        return F.min(F.when(F.col("slot") == slot, value))

    # A struct that begins with the turn: its least value is the first name that is declared.
    hit = F.when(F.col("_declared_in").isNotNull(), F.struct("_turn", "_declared_in"))
    wide = found.groupBy(*_JOB).agg(
        *[of(s, F.col("name")).alias(s) for s in [*_SLOTS, *_FORMATS]],
        *[of(s, hit).alias(f"_{s}") for s in _SLOTS],
        *[F.bool_or(F.col("slot") == s).alias(f"_{s}") for s in _FORMATS],
    )

    # Paths and titles: texts, in the order of the calls.
    told = settings.where(F.col("slot").isin("input_path", "output_path", "title"))
    if constants is None and not told.where(javasource.names_left(F.col("terms"))).isEmpty():
        with arrow_batches(files.sparkSession, javasource.BATCH_BYTES):
            everything = scanned if scanned is not None else durable(javasource.scan(files, path, content).select("file_path", "package", "imports", "fields"))
        constants = javasource.resolve_constants(everything)
    values = javasource.texts(told, constants, [*_JOB, "slot", "call", "at", "arg"])
    # One call may name several paths, and one that sets them drops those before it.
    many = F.when(F.col("call").isin("addInputPaths", "setInputPaths") & F.col("text").contains(","), F.split("text", ",")).otherwise(F.array("text"))
    said = values.groupBy(*_JOB).agg(F.array_sort(F.collect_list(F.struct("at", "arg", "slot", "call", many.alias("texts")))).alias("said"))

    def listed(slot: str) -> Column:
        own = F.filter("said", lambda v: v["slot"] == slot)
        set_at = F.array_max(F.transform(F.filter(own, lambda v: v["call"] == "setInputPaths"), lambda v: v["at"]))
        kept = F.filter(own, lambda v: v["at"] >= F.coalesce(set_at, F.lit(0)))
        return F.coalesce(F.flatten(F.transform(kept, lambda v: v["texts"])), F.array().cast("array<string>"))

    outputs = listed("output_path")
    said = said.select(
        *_JOB, listed("input_path").alias("input_paths"),
        F.slice(outputs, F.greatest(F.size(outputs), F.lit(1)), F.lit(1)).alias("output_paths"),  # the last one set
        F.try_element_at(listed("title"), F.lit(-1)).alias("title"),
    )
    places = settings.groupBy(*_JOB).agg(F.min("package").alias("package"), F.min(F.struct("at", "method"))["method"].alias("method"))
    rows = wide.join(said, _JOB, "left").join(places, _JOB)

    driver = F.substring_index("owner", ".", -1)
    per_type, per_var = [F.count(F.lit(1)).over(Window.partitionBy("file_path", "owner", *more)) for more in ([], ["var"])]
    local = F.when(F.col("scope") >= 0, F.col("method"))
    several = F.row_number().over(Window.partitionBy("file_path", "owner", local, "var").orderBy("scope"))  # overloads
    job_name = F.when(per_type == 1, driver).when(per_var == 1, F.concat_ws(".", driver, "var")).otherwise(F.concat_ws(".", driver, local, "var"))
    empty = F.array().cast("array<string>")
    named = rows.select(
        F.concat(job_name, F.when(several > 1, F.concat(F.lit("#"), several.cast("string"))).otherwise("")).alias("job_name"),
        "package", driver.alias("driver"), local.alias("method"), F.col("var").alias("job_var"), "title", "file_path", *_SLOTS,
        *[F.col(f"_{s}._declared_in").alias(f"{s}_path") for s in _SLOTS],
        F.coalesce("input_paths", empty).alias("input_paths"), F.coalesce("output_paths", empty).alias("output_paths"),
        *[F.when(F.coalesce(f"_{s}", F.lit(False)), F.col(s)).otherwise(default).alias(s) for s, default in _FORMATS.items()],
    )
    return _chained(durable(named))


def _chained(jobs: DataFrame) -> DataFrame:
    """``chained_after``: of the jobs that write a path the job reads, the first; the last, if the first is the job itself."""
    me = F.struct("file_path", "job_name")
    folder = F.regexp_replace("p", "(.)/+$", "$1").alias("p")
    paths = lambda c: jobs.select(me.alias("me"), F.explode(c).alias("p")).where("p is not null").select("me", folder)
    writers = paths("output_paths").groupBy("p").agg(F.min("me").alias("first"), F.max("me").alias("last"))
    met = paths("input_paths").join(writers, "p")
    other = F.when(F.col("first") != F.col("me"), F.col("first")).when(F.col("last") != F.col("me"), F.col("last"))
    after = met.groupBy("me").agg(F.min(other)["job_name"].alias("chained_after"))
    return jobs.withColumn("me", me).join(after, "me", "left").drop("me")


def resolve_chains(jobs: DataFrame, job: str = "job_name", after: str = "chained_after") -> tuple[DataFrame, DataFrame]:
    """(``job, root, depth`` of every job that can run, ``job, reason`` of the others).

    Every round doubles the distance a job looks back, so a chain of length d
    takes about log2(d) rounds; each round is one join against unique job names
    and ends in a checkpoint of the jobs that were still open; a finished one is written once. What is still open after log2(jobs) + 1 rounds
    goes round in a cycle. Jobs behind a broken one are broken too, and a name
    with two predecessors is ambiguous. A job without a name cannot be found by
    others; each such row is reported.
    """
    named = jobs.where(F.col(job).isNotNull()).groupBy(F.col(job).alias("job")).agg(
        F.min(after).alias("_low"),
        F.max(after).alias("_high"),
        F.bool_or(F.col(after).isNull()).alias("_starts"),
    )
    clash = (F.col("_low") != F.col("_high")) | (F.col("_low").isNotNull() & F.col("_starts"))
    status = (
        F.when(F.coalesce(clash, F.lit(False)), "ambiguous").when(F.col("_low").isNull(), "done").otherwise("open")
    )
    # A root points to itself at distance 0.
    state = durable(
        named.select(
            "job",
            F.coalesce("_low", "job").alias("at"),
            F.when(F.col("_low").isNull(), 0).otherwise(1).cast("bigint").alias("dist"),
            status.alias("status"),
        )
    )
    total, pending = state.agg(F.count(F.lit(1)), F.count_if(F.col("status") == "open")).first()
    ended, open_jobs = state.where(F.col("status") != "open"), state.where(F.col("status") == "open")
    for _ in range(math.ceil(math.log2(max(total, 2))) + 1):
        if not pending:
            break
        far = ended.unionByName(open_jobs).select(
            F.col("job").alias("_job"),
            F.col("at").alias("_at"),
            F.col("dist").alias("_dist"),
            F.col("status").alias("_status"),
        )
        moved = durable(
            open_jobs.join(far, F.col("at") == F.col("_job"), "left").select(
                "job",
                F.coalesce("_at", "at").alias("at"),
                (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist"),
                F.when(F.col("_job").isNull() | F.col("_status").isin("broken", "ambiguous"), "broken")
                .otherwise(F.col("_status"))
                .alias("status"),
            )
        )
        ended, open_jobs = ended.unionByName(moved.where(F.col("status") != "open")), moved.where(F.col("status") == "open")
        pending = open_jobs.count()
    state = ended.unionByName(open_jobs)
    chains = state.where(F.col("status") == "done").select(
        "job", F.col("at").alias("root"), F.col("dist").alias("depth")
    )
    reason = F.when(F.col("status") == "open", "cycle").otherwise(F.col("status"))
    nameless = jobs.where(F.col(job).isNull()).select(F.col(job).alias("job"), F.lit("no name").alias("reason"))
    return chains, state.where(F.col("status") != "done").select("job", reason.alias("reason")).unionByName(nameless)
