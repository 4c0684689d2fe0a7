"""Compositions: the leakage-safe game frame and the full feature frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pastframe.functions.scalar import season_year
from pastframe.operators import filters, joins, market, players, sets, windows


def team_history(team_rows: DataFrame, measures: list[str], team: str = "team_id", date: str = "game_date", game: str = "game_id", windows_: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Team rows with everything that was known before each game: rolling means, season means, slopes, rest."""
    t = team_rows.withColumn("season_year", season_year(F.col(date)))
    order = [date, game]
    t = windows.build_rolling_features(t, measures, [team], order, windows_, "season_year")
    for m in measures:
        t = windows.rolling_slope(t, m, max(windows_), [team], order)
    return windows.gap_days(t, [team, "season_year"], date, order)


def player_families(games: DataFrame, rows: DataFrame, injuries: DataFrame, votes: DataFrame | None, value: str, pace: str) -> dict[str, DataFrame]:
    """The families of a team's game that players make, each a row per (game_id, team_id): who is available and how long the others
    have been out, the bench, how much of the roster stayed and came, and the votes of its candidates.

    games: season_year, game_id, team_id, game_date. rows: players' rows with season_year, game_id, game_date, team_id,
    player_id, minutes, value, pace and scheduled. injuries: game_id, team_id, player_id of those listed before the game.
    """
    listed = injuries.select("game_id", "team_id", "player_id").dropna().distinct()
    past = rows.where(~F.coalesce("scheduled", F.lit(False)))
    days = past.groupBy("season_year", "player_id", "game_date").agg(F.max_by("team_id", "game_id").alias("team_id"))
    roster = joins.roster_asof(days, games, listed, "season_year").join(games.select("game_id", "team_id", "game_date"), ["game_id", "team_id"])
    slots = players.player_availability_features(past, roster, listed, value)
    hurt = listed.join(games, ["game_id", "team_id"]).select("season_year", "game_date", "team_id", "player_id")
    out = {
        "slots": players.with_streaks(slots, players.absence_streaks(games, listed), value),
        "bench": players.bench_features(past, roster, listed, value, pace),
        "roster": players.roster_windows(rows, games, hurt),
    }
    if votes is not None:
        out["votes"] = players.vote_features(games, rows, votes, listed, roster.select("game_id", "team_id", "player_id"))
    return out


def team_frame(team_rows: DataFrame, measures: list[str], families: dict[str, DataFrame] = {}, by_game: dict[str, DataFrame] = {}, team: str = "team_id", date: str = "game_date", game: str = "game_id") -> DataFrame:  # noqa: B006
    """B0 before pairing: a team's games with its history and the families of others, their columns named <family>_<column>_BEFORE.

    families: a row per (game, team), as player_families gives them; by_game: a row per game, such as officials, travel or
    the market's regime. Families end in an aggregation by game and team, so all of them meet where one shuffle of the
    team's rows by that key puts them; those by game are joined last.
    """
    t = team_history(team_rows, measures, team, date, game)
    for keys, dfs in (([game, team], families), ([game], by_game)):
        for name, df in dfs.items():
            t = t.join(df.select(*keys, *[F.col(f"`{c}`").alias(f"{name}_{c}_BEFORE") for c in df.columns if c not in (game, team)]), keys, "left")
    return t


def base_game_features(team_rows: DataFrame, measures: list[str], outcome: str, team: str = "team_id", date: str = "game_date", game: str = "game_id", home: str = "home", families: dict[str, DataFrame] = {}, by_game: dict[str, DataFrame] = {}) -> DataFrame:  # noqa: B006
    """One row per game with both sides' history and families and the total as target, and no closing market data."""
    t = filters.keep_complete_groups(team_frame(team_rows, measures, families, {}, team, date, game), game)
    known = [c for c in t.columns if c.endswith("_BEFORE")]
    wide = joins.pair_sides(t.select(game, date, "season_year", home, team, F.col(outcome).alias("__y"), *known), [game, date, "season_year"], home)
    wide = market.side_differences(wide, [r"^(?!.*_id_).*_BEFORE$"])  # ids have no difference
    total = F.col("__y_TEAM_HOME") + F.col("__y_TEAM_AWAY")
    out = wide.withColumn("TOTAL", total).drop("__y_TEAM_HOME", "__y_TEAM_AWAY")
    for name, df in by_game.items():
        out = out.join(df.select(game, *[F.col(f"`{c}`").alias(f"{name}_{c}_BEFORE") for c in df.columns if c != game]), game, "left")
    return windows.calendar_features(out, date)


def build_feature_frame(history: DataFrame, scheduled: DataFrame, measures: list[str], outcome: str, odds: DataFrame | None = None, derived: dict[str, str] = market.DERIVED, families: dict[str, DataFrame] = {}, by_game: dict[str, DataFrame] = {}) -> DataFrame:  # noqa: B006
    """B1: history and scheduled games in one frame: scheduled rows receive history and never enter it, as their measures are null."""
    rows = sets.union_all(history, scheduled.drop(*[c for c in measures if c in scheduled.columns]))
    base = base_game_features(rows, measures, outcome, families=families, by_game=by_game)
    if odds is not None:
        base = base.join(market.market_features(odds), "game_id", "left")
    return market.derived_features(base, derived)
