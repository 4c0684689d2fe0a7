"""Raw quotes to ticks (F10): ids, UTC, flags, repairs, encoding, one row per key, and why rows were lost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pastframe.functions.scalar import encode_line, localize_strict, standardize
from pastframe.operators.filters import drop_reasons, null_out_of_bounds, repair_spread_price_bleed
from pastframe.operators.topk import latest_per_key

#: What a pre-game line can be.
TOTAL_BOUNDS, SPREAD_BOUNDS = (150.0, 300.0), (-30.0, 30.0)


def transform_ticks(raw: DataFrame, games: DataFrame, schedule: DataFrame, books: DataFrame, markets: DataFrame, names: dict[str, str] = {}, tz: str = "Europe/Madrid") -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: B006
    """(ticks, game dimension, rows by drop reason).

    raw: game_date, season_year, event_id, team_home, team_away, bookmaker_slug, market, row_kind, timestamp (local wall
    time), left_line, left_price, right_line, right_price. games: game_id, game_date, team_home, team_away. schedule:
    game_id, tipoff_utc. books: book_id, bookmaker_slug. markets: market_id, market. Names are standardised on both sides.
    A time that the clock skips or shows twice has no UTC and is dropped; of rows with one key the last event stays.
    """
    fix = lambda d: d.withColumns({c: standardize(F.col(c), names) for c in ("team_home", "team_away")})
    r = fix(raw).join(fix(games).dropDuplicates(["game_date", "team_home", "team_away"]), ["game_date", "team_home", "team_away"], "left")
    r = r.join(schedule.select("game_id", "tipoff_utc"), "game_id", "left").join(books, "bookmaker_slug", "left").join(markets, "market", "left")
    r = r.withColumn("line_ts", localize_strict(F.col("timestamp"), tz))
    kept, stats = drop_reasons(r, {"no time": F.col("line_ts").isNull(), "no game": F.col("game_id").isNull(), "no tip-off": F.col("tipoff_utc").isNull(), "no book": F.col("book_id").isNull(), "no market": F.col("market_id").isNull()})
    mins = (F.unix_micros("line_ts") - F.unix_micros(F.col("tipoff_utc").cast("timestamp"))) / 6e7
    t = kept.withColumns({"mins_to_tip": mins, "is_pregame": mins < 0, "is_opener": F.coalesce(F.col("row_kind") == "opener", F.lit(False))})
    t = repair_spread_price_bleed(t, F.col("market") == "spread")
    t = null_out_of_bounds(t, {"left_line": TOTAL_BOUNDS, "right_line": TOTAL_BOUNDS}, F.col("is_pregame") & (F.col("market") == "total"))
    t = null_out_of_bounds(t, {"left_line": SPREAD_BOUNDS, "right_line": SPREAD_BOUNDS}, F.col("is_pregame") & (F.col("market") == "spread"))
    t = t.withColumns({c: encode_line(F.col(c)) for c in ("left_line", "right_line")})
    t = latest_per_key(t.drop("repaired"), ["game_id", "market_id", "book_id", "line_ts"], ["event_id"])
    dim = kept.groupBy("game_id").agg(F.max("season_year").alias("season_year"), F.max("game_date").alias("game_date"), F.max("tipoff_utc").alias("tipoff_utc"), F.max("team_home").alias("team_home"), F.max("team_away").alias("team_away"))
    cols = ["season_year", "game_id", "market_id", "book_id", "line_ts", "mins_to_tip", "is_opener", "is_pregame", "left_line", "left_price", "right_line", "right_price"]
    return t.select(*cols), dim, stats
