"""Relations by name, composed into one statement with the relations it needs."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .dialect import DuckDB, Spark
from .store import bucketed, exists, stamp, stored

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Relations that several others read: Spark writes them once for all readers of a session.
CUT = frozenset({"slots", "doc_pages", "lines", "drawings", "line_captions", "anchors", "common_all", "commons", "table_groups", "sided", "zones", "zone_drawings", "core_members", "zone_lines", "cores", "placed", "objects", "truth", "truth_regions", "truth_fields", "detected", "found_regions", "found_fields", "diff", "region_checks", "field_checks", "compared", "case_specs", "hf_cases", "target_specs", "spec_truth", "tags", "editor_objects", "overlay_boxes", "edit_checks", "edited_boxes", "package_objects", "cases_of_json", "det_roots", "scenario_texts", "sc_parsed", "sc_heads", "sc_roots", "scenario_errors", "sx_valid", "sx_targets", "sx_contexts", "sx_columns", "sx_free", "hf_specs"})
#: They lie in buckets by the first of these that they have: the document, text or case that all of their joins, groups and windows go by.
KEYS = ("doc_id", "doc", "k", "case_id")
#: Of these, the ones whose rows stay where they are: made from written relations by steps that all go by the key, so they are written without a shuffle.
SETTLED = frozenset({"lines", "drawings", "line_captions", "anchors", "common_all", "commons", "table_groups", "sided", "zones", "zone_drawings", "core_members", "zone_lines", "cores", "placed", "objects", "truth", "truth_regions", "truth_fields", "detected", "found_regions", "found_fields", "diff", "region_checks", "field_checks", "compared", "editor_objects", "overlay_boxes", "edited_boxes", "package_objects", "det_roots", "scenario_texts", "sc_parsed", "sc_heads", "sc_roots"})
#: The tables that every page comes from: their size tells the buckets of all that derives from them, so that these match.
PAGES = ("orders", "lineitem")
#: Joins by (document, page, ...) take buckets by document as they are.
BY_PART_OF_KEY = "spark.sql.requireAllClusterKeysForCoPartition"
EVERY_BUCKET = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
#: Parsed texts are written as they are: shredded values don't tell 2 from 2.0.
SHREDDED = "spark.sql.variant.writeShredding.enabled"
#: Buckets of such a relation: one for so many bytes of its source tables, but not fewer, nor more than Spark allows.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 8 << 20, 8, 1 << 15
#: JSON texts are longer than the rows they derive from: so many times the size counts.
TEXT_TIMES = 8
#: Written relations by application, source folder, name and definition, with what tells whether the sources are still the same, and its buckets.
_WRITTEN: dict[tuple[str, str, str], tuple[DataFrame, tuple, int]] = {}
_NAME = re.compile(r"\b[a-z_0-9]+\b")


def forget() -> None:
    """Lets go of all written relations; their files go when nothing reads them any more."""
    _WRITTEN.clear()


def needed(sql: str, known: dict[str, str]) -> list[str]:
    """Names of the relations that a statement needs, each after its own needs."""
    order: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(_NAME.findall(re.sub(r"'(?:[^']|'')*'", "''", text))):
            if word in known and word not in order and re.search(rf"\b(FROM|JOIN)\s+{word}\b", text):
                visit(known[word])
                if word not in order:
                    order.append(word)

    visit(sql)
    return order


def duckdb_sql(sql: str, known: dict[str, str]) -> str:
    parts = [f"{n} AS MATERIALIZED ({known[n]})" for n in needed(sql, known)]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql


def direct(sql: str, known: dict[str, str]) -> list[str]:
    """Relations that a statement reads itself."""
    return [n for n in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)\b", sql)) if n in known]


def buckets(spark: SparkSession, sizes: list[int]) -> int:
    """How many buckets hold a relation that comes from source tables of these sizes; the session's shuffle partitions where none is known."""
    wanted = -(-sum(sizes) // BUCKET_BYTES) if sizes else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, wanted))


def run(spark: SparkSession, sql: str, known: dict[str, str], sources: dict[str, DataFrame], place: str | None = None, stamps: dict[str, tuple] | None = None) -> DataFrame:
    """The statement over source tables (by name) and relations; a source of a relation's name replaces it.

    Relations that many statements read are written in the shared folder. With a place (the
    folder of the sources), later statements of the session over that folder read them again,
    as long as the stamps of the sources they come from are unchanged and the written files are there.
    Views that the statement needs have names of its own and are gone when this returns.
    """
    known = {n: s for n, s in known.items() if n not in sources}
    views: dict[str, str] = {}
    dealt: dict[str, int] = {}
    written: dict = _WRITTEN if place else {}
    mark = uuid.uuid4().hex[:12]
    spark.conf.set(BY_PART_OF_KEY, "false")

    def renamed(text: str) -> str:
        return re.sub(r"\b(FROM|JOIN)\s+([a-z_0-9]+)\b( AS [a-z]\b)?", lambda m: f"{m[1]} {views[m[2]]}{m[3] or ('' if _aliased(text, m.end()) else ' AS ' + m[2])}" if m[2] in views else m[0], text)

    def view(n: str, df: DataFrame) -> None:
        views[n] = f"pq_{n}_{mark}"
        df.createOrReplaceTempView(views[n])

    def state(n: str) -> tuple:
        return tuple((t, stamps[t]) for t in read(known[n], known) if t in (stamps or {}))

    def files(n: str) -> int:
        from_tables = read(known[n], known)
        of = PAGES if set(PAGES) & set(from_tables) else from_tables
        times = TEXT_TIMES if {"cases_of_json", "scenario_texts"} & {n, *needed(known[n], known)} else 1
        return buckets(spark, [times * stamps[t][0] for t in of if t in (stamps or {})])

    def origins(n: str) -> set[str]:
        """The written relations and given tables that a relation comes from."""
        found: set[str] = set()
        for x in direct(known[n], known | dict.fromkeys(sources, "")):
            found |= {x} if x in CUT or x in sources else origins(x)
        return found

    def write(n: str, df: DataFrame) -> DataFrame:
        key = next((c for c in KEYS if c in df.columns), None)
        if key is None:
            return stored(df, n)
        dealt[n] = files(n)
        settled = n in SETTLED and all(dealt.get(x) == dealt[n] for x in origins(n))
        before = {name: spark.conf.get(name) for name in (EVERY_BUCKET, SHREDDED)}
        spark.conf.set(EVERY_BUCKET, str(not settled).lower())
        spark.conf.set(SHREDDED, "false")
        try:
            return bucketed(df, n, [key], dealt[n], shuffle=not settled)
        finally:
            for name, value in before.items():
                spark.conf.set(name, value)

    def old(n: str, key: tuple[str, str, str]) -> DataFrame | None:
        df, seen, dealt_in = written.get(key, (None, None, 0))
        if df is None or seen != state(n) or not all(exists(spark, f) for f in df.inputFiles()[:1]):
            return None
        dealt[n] = dealt_in
        return df

    def build(n: str) -> None:
        if n in views:
            return
        key = (spark.sparkContext.applicationId, place or "", f"{n} {hash(tuple(known[x] for x in [*needed(known[n], known), n]))}")
        df = old(n, key) if n in CUT else None
        if df is None:
            for need in direct(known[n], known):
                build(need)
            df = spark.sql(renamed(known[n]))
            if n in CUT:
                df = write(n, df)
                written[key] = (df, state(n), dealt.get(n, 0))
        # files compress so well that their size says nothing of the rows: what comes from written relations is never broadcast, lists of values always
        of_rows = n in CUT or any(x in CUT for x in needed(known[n], known))
        view(n, df.hint("merge") if of_rows else df.hint("broadcast") if known[n].startswith("SELECT * FROM (VALUES") else df)

    try:
        for n, df in sources.items():
            view(n, df)
        for n in direct(sql, known):
            build(n)
        return spark.sql(renamed(sql))
    finally:
        for name in views.values():
            spark.catalog.dropTempView(name)


_KEYWORDS = {"WHERE", "GROUP", "JOIN", "LEFT", "RIGHT", "FULL", "CROSS", "ON", "ORDER", "UNION", "LATERAL", "WINDOW", "INNER", "HAVING", "LIMIT"}


def _aliased(text: str, end: int) -> bool:
    m = re.match(r"\s+(?:AS\s+)?([A-Za-z_]+)", text[end:])
    return bool(m and m[1].upper() not in _KEYWORDS)


def read(sql: str, known: dict[str, str]) -> list[str]:
    """Source tables that a statement reads, by itself or by the relations it needs."""
    every = " ".join([sql, *(known[n] for n in needed(sql, known))])
    return [t for t in TABLES if re.search(rf"\b(FROM|JOIN)\s+{t}\b", every)]


def tables(spark: SparkSession, sf_dir: str, sql: str, known: dict[str, str]) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in read(sql, known)}


def stamps(spark: SparkSession, sf_dir: str, sql: str, known: dict[str, str]) -> dict[str, tuple]:
    """What tells whether the source tables of a statement are still the same."""
    of = read(sql, known)
    sizes = [t for t in PAGES if set(PAGES) & set(of) and t not in of and exists(spark, f"{sf_dir}/{t}.parquet")]
    return {t: stamp(spark, f"{sf_dir}/{t}.parquet") for t in of + sizes}


def query(statement: Callable[[object], str], relations: Callable[[object], dict[str, str]]):
    """(Spark query, DuckDB SQL) of a statement that is given the dialect."""

    def on_spark(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = Spark()
        sql, known = statement(d), relations(d)
        return run(spark, sql, known, tables(spark, sf_dir, sql, known), sf_dir, stamps(spark, sf_dir, sql, known))

    return on_spark, duckdb_sql(statement(DuckDB()), relations(DuckDB()))
