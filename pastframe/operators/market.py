"""Market and matchup feature families."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pastframe.functions.scalar import SIGMA_TOTAL, center_line, log_ratio, pair_mean, round_half_away, safe_div, to_decimal
from pastframe.operators.aggregates import with_row_stats

#: Fixed value: the price at which a side counts as standard, in decimal form to two places.
STANDARD_PRICE = 1.91


def books_in(columns: list[str], market: str, suffix: str) -> list[str]:
    """The books that a wide frame has, by the pattern <market>_<book>_<suffix>."""
    return sorted({m[1] for c in columns if (m := re.fullmatch(rf"{market}_(.+)_{suffix}", c))})


def market_features(df: DataFrame, books: list[str] | None = None, ref: str | None = None) -> DataFrame:
    """O1: per book mid line, probability difference, margin and log price ratio; how many books quote; row statistics across books;
    favourite and implied team totals from a spread if there is one. A missing spread is no favourite (0), not null. From
    moneylines per book the home side's probability without the margin, and the margin; of their means over the books
    that quote both sides, the favourite's probability, the gap between the sides, and the mean margin.

    Reads <market>_<book>_line_over, line_under, price_over, price_under of totals, spread_<book>_line_home, and
    ml_<book>_price_home and price_away.
    """
    books = books or books_in(df.columns, "total", "line_over")
    cols: dict[str, Column] = {}
    for b in books:
        over, under = (to_decimal(F.col(f"total_{b}_price_{s}")) for s in ("over", "under"))
        p, q = 1 / over, 1 / under
        cols |= {f"odds_total_{b}_mid": pair_mean(F.col(f"total_{b}_line_over"), F.col(f"total_{b}_line_under")), f"odds_total_{b}_prob_diff": p - q, f"odds_total_{b}_vig": p + q - 1, f"odds_total_{b}_log_ratio": log_ratio(over, under)}
    out = df.withColumns(cols)
    for kind in ("mid", "prob_diff", "vig", "log_ratio"):
        out = with_row_stats(out, [f"odds_total_{b}_{kind}" for b in books], f"odds_total_{kind}")
    ref = ref or books[0]
    line = F.col(f"odds_total_{ref}_mid")
    spread = f"spread_{ref}_line_home"
    if spread in df.columns:
        s = F.col(spread)
        out = out.withColumns({"odds_is_fav_home": F.coalesce(s < 0, F.lit(False)).cast("int"), "odds_abs_spread": F.abs(s), "odds_implied_home": line / 2 - s / 2, "odds_implied_away": line / 2 + s / 2, "odds_line_x_spread": line * F.abs(s)})
    sides = {b: [1 / to_decimal(F.col(f"ml_{b}_price_{x}")) for x in ("home", "away")] for b in books_in(df.columns, "ml", "price_home") if f"ml_{b}_price_away" in df.columns}
    if sides:
        out = out.withColumns({c: x for b, (p, q) in sides.items() for c, x in ((f"odds_ml_{b}_home_prob", safe_div(p, p + q)), (f"odds_ml_{b}_vig", p + q - 1))})
        mean = lambda kind: F.try_divide(reduce(Column.__add__, [F.coalesce(f"odds_ml_{b}_{kind}", F.lit(0.0)) for b in sides]), reduce(Column.__add__, [F.col(f"odds_ml_{b}_{kind}").isNotNull().cast("int") for b in sides]))
        home = mean("home_prob")
        out = out.withColumns({"odds_ml_favorite_prob": F.when(home.isNotNull(), F.greatest(home, 1 - home)), "odds_ml_prob_gap": F.abs(2 * home - 1), "odds_ml_vig_mean": mean("vig")})
    return out


def side_differences(df: DataFrame, patterns: list[str], suffixes: tuple[str, str] = ("_TEAM_HOME", "_TEAM_AWAY")) -> DataFrame:
    """O2: home less away for every numeric column whose name before the side fits a pattern and that has both sides; a difference that is there already is replaced."""
    stems = [c.removesuffix(suffixes[0]) for c in df.columns if c.endswith(suffixes[0])]
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    stems = [s for s in stems if s + suffixes[0] in numeric and any(re.search(p, s) for p in patterns)]
    return df.withColumns({f"{s}_DIFF": F.col(s + suffixes[0]) - F.col(s + suffixes[1]) for s in stems if s + suffixes[1] in df.columns})


def derived_features(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """O3: SQL expressions by name; those that read a column that isn't there are left out."""
    have = {c.lower() for c in df.columns}
    words = lambda e: {w.lower() for w in re.findall(r"(?<![\w'])[A-Za-z_]\w*(?!\s*\()(?![\w'])", re.sub(r"'[^']*'", "", e))}
    reserved = {"case", "when", "then", "else", "end", "and", "or", "not", "is", "null", "as", "double", "int", "in", "between", "like", "true", "false"}
    for name, e in spec.items():
        if words(e) - reserved <= have:
            df = df.withColumn(name, F.expr(e))
            have.add(name.lower())
    return df


#: The derived features of a game frame, by name: what is expected of pace and points, form, mismatch, trends, travel.
DERIVED = {
    "EXPECTED_POSS_BEFORE": "(POSS_BEFORE_TEAM_HOME + POSS_BEFORE_TEAM_AWAY) / 2",
    "EXPECTED_POINTS_HOME_BEFORE": "EXPECTED_POSS_BEFORE * (OFF_RATING_BEFORE_TEAM_HOME + DEF_RATING_BEFORE_TEAM_AWAY) / 200",
    "EXPECTED_POINTS_AWAY_BEFORE": "EXPECTED_POSS_BEFORE * (OFF_RATING_BEFORE_TEAM_AWAY + DEF_RATING_BEFORE_TEAM_HOME) / 200",
    "EXPECTED_TOTAL_BEFORE": "EXPECTED_POINTS_HOME_BEFORE + EXPECTED_POINTS_AWAY_BEFORE",
    "MISMATCH_BEFORE": "abs(EXPECTED_POINTS_HOME_BEFORE - EXPECTED_POINTS_AWAY_BEFORE)",
    "FORM_Z_HOME_BEFORE": "try_divide(PTS_LAST_5_BEFORE_TEAM_HOME - PTS_SEASON_BEFORE_TEAM_HOME, PTS_STD_BEFORE_TEAM_HOME)",
    "FORM_Z_AWAY_BEFORE": "try_divide(PTS_LAST_5_BEFORE_TEAM_AWAY - PTS_SEASON_BEFORE_TEAM_AWAY, PTS_STD_BEFORE_TEAM_AWAY)",
    "TREND_SUM_BEFORE": "PTS_SLOPE_BEFORE_TEAM_HOME + PTS_SLOPE_BEFORE_TEAM_AWAY",
    "TREND_DIFF_BEFORE": "PTS_SLOPE_BEFORE_TEAM_HOME - PTS_SLOPE_BEFORE_TEAM_AWAY",
    "TRAVEL_INTENSITY_BEFORE": "try_divide(TRAVEL_KM_7D_TEAM_AWAY, REST_DAYS_BEFORE_TEAM_AWAY)",
}


def style_matchups(df: DataFrame, rates: list[str], possessions: str | None = None) -> DataFrame:
    """A side's expected rate is the mean of its own season rate and what its opponent allows; the expected count, times possessions.

    Reads <rate>_BEFORE_TEAM_HOME/AWAY and <rate>_opp_BEFORE_TEAM_HOME/AWAY.
    """
    out: dict[str, Column] = {}
    for r in rates:
        for a, b in (("HOME", "AWAY"), ("AWAY", "HOME")):
            e = (F.col(f"{r}_BEFORE_TEAM_{a}") + F.col(f"{r}_opp_BEFORE_TEAM_{b}")) / 2
            out[f"{r}_EXPECTED_{a}_BEFORE"] = e
            if possessions:
                out[f"{r}_EXPECTED_COUNT_{a}_BEFORE"] = e * F.col(possessions)
    return df.withColumns(out)


def safe_ratios(df: DataFrame, ratios: dict[str, tuple[str, str]]) -> DataFrame:
    """W25's rates: out -> (numerator, denominator), null where the denominator is 0."""
    return df.withColumns({n: safe_div(F.col(a), F.col(b)) for n, (a, b) in ratios.items()})


def normalize_lines(df: DataFrame, enabled: bool = True, market: str = "total", sigma: float = SIGMA_TOTAL) -> DataFrame:
    """Every book's complete quote moved to the line at which both sides are even, at the standard price.

    Only where the rounded prices differ and neither is the standard one; prices are rounded on every row. The new line is
    a half point.
    """
    if not enabled:
        return df
    for b in books_in(df.columns, market, "line_over"):
        lo, lu, po, pu = (f"{market}_{b}_{c}" for c in ("line_over", "line_under", "price_over", "price_under"))
        prices = {c: F.round(to_decimal(F.col(c)), 2) for c in (po, pu)}
        df = df.withColumns(prices)
        move = F.coalesce(reduce(lambda x, y: x & y, [F.col(lo).isNotNull(), F.col(lo) == F.col(lu), F.col(po) != F.col(pu), F.col(po) != STANDARD_PRICE, F.col(pu) != STANDARD_PRICE]), F.lit(False))
        df = df.withColumn("__fair", round_half_away(center_line(F.col(lo), F.col(po), F.col(pu), sigma))).withColumn("__move", move & F.col("__fair").isNotNull())
        df = df.withColumns({c: F.when(F.col("__move"), v).otherwise(F.col(c)) for c, v in ((lo, F.col("__fair")), (lu, F.col("__fair")), (po, F.lit(STANDARD_PRICE)), (pu, F.lit(STANDARD_PRICE)))}).drop("__fair", "__move")
    return df
