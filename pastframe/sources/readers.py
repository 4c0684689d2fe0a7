"""Readers: season files, aligned daily legs, pruned scans, tick scans, nested events, schema conformance, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_season_csv(spark: SparkSession, root: str, schema: T.StructType, season_glob: str = "*", columns: list[str] | None = None, season_col: str = "season") -> DataFrame:
    """A tree root/<season>/.../*.csv with an explicit schema; fields that can't be read are null, the folder is the season."""
    df = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").csv(f"{root}/{season_glob}")
    # up to the folder under the root, however deep the file lies
    tail = root.rstrip("/").rsplit("/", 1)[-1]
    df = df.withColumn(season_col, F.regexp_extract(F.input_file_name(), rf"/{tail}/([^/]+)/", 1))
    return df.select(*(columns or schema.fieldNames()), season_col)


def align_daily_legs(legs: dict[str, DataFrame], keys: list[str], day: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Legs joined in full on their keys, and a day-by-day audit of which legs are there; strict keeps days with all of them."""
    days = None
    for name, df in legs.items():
        one = df.groupBy(day).agg(F.count("*").alias("rows")).withColumn("leg", F.lit(name))
        days = one if days is None else days.unionByName(one)
    audit = days.groupBy(day).agg(F.array_sort(F.collect_set("leg")).alias("legs"), F.sum("rows").alias("rows")).withColumn("complete", F.size("legs") == len(legs))
    out = None
    for df in legs.values():
        out = df if out is None else out.join(df, keys, "full")
    return (out.join(audit.where("complete").select(day), day, "left_semi") if strict else out), audit


def scan_seasons(spark: SparkSession, table: str | DataFrame, seasons: list, extra_ids: list | DataFrame | None = None, season_col: str = "season_year", id_col: str = "game_id") -> DataFrame:
    """S3: rows of the seasons, or with one of the extra ids. Short id lists are pushed to the scan; a frame of ids is semi-joined."""
    df = spark.read.parquet(table) if isinstance(table, str) else table
    wanted = F.col(season_col).isin(list(seasons))
    if extra_ids is None:
        return df.where(wanted)
    if not isinstance(extra_ids, DataFrame):
        return df.where(wanted | F.col(id_col).isin(list(extra_ids)))
    rest = df.where(~F.coalesce(wanted, F.lit(False))).join(extra_ids.select(id_col).distinct(), id_col, "left_semi")
    return df.where(wanted).unionByName(rest)


def read_pregame_ticks(ticks: DataFrame, markets_dim: DataFrame, books_dim: DataFrame, seasons: list, markets: list[str], exclude_books: list[str] = (), min_minutes: float = 5) -> DataFrame:
    """Star join of ticks with the market and book dimensions; only quotes at least min_minutes before the start, lines decoded."""
    m = markets_dim.where(F.col("market").isin(list(markets)))
    b = books_dim.where(~F.col("book").isin(list(exclude_books))) if exclude_books else books_dim
    t = ticks.where(F.col("season_year").isin(list(seasons)) & F.col("is_pregame") & (F.col("mins_to_tip") <= -min_minutes))
    out = t.join(m, "market_id").join(b, "book_id")
    lines = [c for c in out.columns if c.endswith("_line")]
    return out.withColumns({c: F.col(c) / 2 for c in lines}).withColumn("minutes_before_tip", -F.col("mins_to_tip"))


def flatten_event_json(df: DataFrame, column: str, schema: str, fields: dict[str, str]) -> DataFrame:
    """JSON text to columns by paths; a path that isn't there, or broken JSON, is null."""
    parsed = df.withColumn("__j", F.from_json(column, schema))
    return parsed.select("*", *[F.expr(f"__j.{path}").alias(name) for name, path in fields.items()]).drop("__j")


def explode_events(df: DataFrame, column: str, element: str, keep: list[str]) -> DataFrame:
    """V4: JSON text that holds a list, one row per element; empty and broken lists keep one row of nulls."""
    return df.select(*keep, F.explode_outer(F.from_json(column, f"array<{element}>")).alias("event"))


def source_presence(df: DataFrame, event_id: str, source: Column | str) -> DataFrame:
    """The share of events that each source covers."""
    src = F.col(source) if isinstance(source, str) else source
    total = df.agg(F.count_distinct(event_id).alias("total"))
    per = df.select(event_id, src.alias("source")).where("source is not null").distinct().groupBy("source").agg(F.count("*").alias("events"))
    return per.crossJoin(F.broadcast(total)).select("source", "events", (F.col("events") / F.col("total")).alias("share"))  # total: one row


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns: absent ones null, values that don't fit null."""
    return df.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def coalesce_duplicates(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Columns that mean the same become one, the first non-null of them in order."""
    gone = {c for cs in groups.values() for c in cs}
    return df.select(*[c for c in df.columns if c not in gone], *[F.coalesce(*[F.col(f"`{c}`") for c in cs if c in df.columns]).alias(n) for n, cs in groups.items()])


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows and an order-free hash of the contents (repeated rows count)."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("total"))


def assert_fingerprint(df: DataFrame, expected: tuple[int, int, int]) -> None:
    """Fails if the contents aren't the expected ones."""
    got = tuple(map(int, dataset_fingerprint(df).first()))
    if got != tuple(expected):
        raise ValueError(f"the data have changed: {got}, expected {tuple(expected)}")
