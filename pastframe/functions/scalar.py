"""Column functions: prices, lines, names, ids, seasons, times, safe arithmetic (X1-X18). Null in, null out unless said otherwise."""

from __future__ import annotations

import math
import unicodedata
from functools import cache, reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def american_to_decimal(c: Column) -> Column:
    """+150 is 2.5, -200 is 1.5; zero is no price."""
    return F.when(c > 0, 1 + c / 100).when(c < 0, 1 + 100 / F.abs(c))


def to_decimal(c: Column) -> Column:
    """Values of 100 or more either way are American prices, those above 1 decimal ones, the rest invalid."""
    return F.when(F.abs(c) >= 100, american_to_decimal(c)).when(c > 1, c.cast("double"))


def decimal_to_american(c: Column) -> Column:
    """X1, the other way."""
    return F.when(c >= 2, (c - 1) * 100).when(c > 1, -100 / (c - 1))


def implied_prob(c: Column) -> Column:
    """1 / decimal price."""
    return F.when(c > 0, 1 / c)


def devig(left: Column, right: Column) -> Column:
    """Struct of the left probability without the margin, and the overround; null if either price is."""
    p, q = implied_prob(left), implied_prob(right)
    return F.when((p + q).isNotNull(), F.struct((p / (p + q)).alias("p"), (p + q).alias("overround")))


def round_half_away(c: Column, inc: float = 0.5) -> Column:
    """To the nearest multiple of inc, halves away from zero."""
    return F.signum(c) * F.floor(F.abs(c) / inc + 0.5) * inc


def round_half_up(c: Column, inc: float = 0.5) -> Column:
    """To the nearest multiple of inc, halves up."""
    return F.floor(c / inc + 0.5) * inc


#: Spread of the final total and of the final margin around their lines.
SIGMA_TOTAL, SIGMA_MARGIN = 15.7, 13.46

_ERF = np.vectorize(math.erf, otypes=[float])


def _phi(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _ERF(x / math.sqrt(2)))


def fair_line(line: np.ndarray, left: np.ndarray, right: np.ndarray, sigma: float, left_above: bool, steps: int = 100) -> np.ndarray:
    """The line at which both sides would be even, from decimal prices of the two sides at `line`.

    Half-point lines: line + sigma * inverse normal of the side's probability. Whole lines can push; there the mean m solves
    P(above) / (P(above) + P(below)) = p by bisection within ten sigma.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        p = (1 / left) / (1 / left + 1 / right)
    out = np.full(len(line), np.nan)
    ok = np.isfinite(line) & np.isfinite(p) & (p > 0) & (p < 1) & (left > 1) & (right > 1)
    side = 1.0 if left_above else -1.0
    half = ok & (np.floor(line) != line)
    inv = np.vectorize(NormalDist().inv_cdf, otypes=[float])
    if half.any():
        out[half] = line[half] + side * sigma * inv(p[half])
    whole = ok & ~half
    if whole.any():
        l, want = line[whole], np.where(left_above, p[whole], 1 - p[whole])
        lo, hi = l - 10 * sigma, l + 10 * sigma
        for _ in range(steps):
            m = (lo + hi) / 2
            above, below = 1 - _phi((l + 0.5 - m) / sigma), _phi((l - 0.5 - m) / sigma)
            with np.errstate(divide="ignore", invalid="ignore"):
                low = np.nan_to_num(above / (above + below), nan=0.5) < want
            lo, hi = np.where(low, m, lo), np.where(low, hi, m)
        out[whole] = (lo + hi) / 2
    return out


def center_line(line: Column, left_price: Column, right_price: Column, sigma: float = SIGMA_TOTAL, left_above: bool = True) -> Column:
    """The fair line per row, in Arrow batches; null where a side has no valid price."""

    @F.pandas_udf("double")
    def solve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        got = fair_line(a.to_numpy(float), b.to_numpy(float), c.to_numpy(float), sigma, left_above)
        return pd.Series(got).astype(object).where(np.isfinite(got), None)

    return solve(line.cast("double"), to_decimal(left_price), to_decimal(right_price))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    """Great-circle distance."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


#: Letters that are written out, beside what Unicode decomposes, and name suffixes that do not count.
WRITTEN_OUT = {"ё": "e", "Ё": "E", "đ": "dj", "Đ": "Dj"}
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")


@cache
def _plain_letters() -> tuple[str, str, dict[str, str]]:
    """For translate: characters and their base letters, by Unicode's compatibility decomposition, then the marks, which go; and what has several letters."""
    one, more = {}, {}
    for c in map(chr, range(0x80, 0x10000)):
        if "\ud800" <= c <= "\udfff" or unicodedata.combining(c) or c in WRITTEN_OUT:
            continue
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        base = "".join(x if x.isascii() else " " for x in base) if base != c else ""
        if base.strip():
            (one if len(base) == 1 else more)[c] = base
    latin = {c: b for c, b in more.items() if not "\u2000" <= c <= "\uf000" and c < "\ufb10"} | WRITTEN_OUT
    marks = "".join(c for c in map(chr, range(0x300, 0x370)) if unicodedata.combining(c))
    return "".join(one) + marks, "".join(one.values()), latin


def canonical_name(c: Column, sort_tokens: bool = False) -> Column:
    """Lower case without accents, signs, shirt numbers and the suffixes at its end; with sort_tokens, tokens in order.

    Letters that don't decompose into plain ones, of whatever script, count as gaps.
    """
    marked, plain, several = _plain_letters()
    s = F.regexp_replace(c, r"\(#\d+\)", " ")
    for letter, by in several.items():
        s = F.replace(s, F.lit(letter), F.lit(by))
    s = F.lower(F.translate(s, marked, plain))
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"[.']", ""), r"[^a-z0-9]+", " "))
    s = F.regexp_replace(s, rf"(?:(?:^| )(?:{'|'.join(SUFFIXES)}))+$", "")
    return F.array_join(F.array_sort(F.split(s, " ")), " ") if sort_tokens else s


def standardize(c: Column, names: dict[str, str]) -> Column:
    """The standard name of a known spelling, else the value as it is."""
    if not names:
        return c
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.trim(c)), F.trim(c))


def canonical_id(c: Column, width: int = 10) -> Column:
    """Ids that came as numbers or text in one form: no trailing .0, digits padded with zeros to `width`."""
    s = F.regexp_replace(F.trim(c.cast("string")), r"\.0+$", "")
    return F.when(s.rlike(r"^\d+$") & (F.length(s) < width), F.lpad(s, width, "0")).otherwise(s)


def season_year(c: Column, first_month: int = 8) -> Column:
    """The year in which the season of a date began."""
    return F.year(c) - (F.month(c) < first_month).cast("int")


def season_label(year: Column) -> Column:
    """2023 is 2023-24."""
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(((year + 1) % 100).cast("string"), 2, "0"))


def season_labels_between(lo: Column, hi: Column, first_month: int = 8) -> Column:
    """The labels of all seasons that the dates from lo to hi touch."""
    return F.transform(F.sequence(season_year(lo, first_month), season_year(hi, first_month)), season_label)


def season_type(id_: Column, types: dict[str, str]) -> Column:
    """By the prefix of a game id; unknown prefixes are null."""
    n = len(next(iter(types)))
    return reduce(lambda a, kv: a.when(F.substring(id_, 1, n) == kv[0], kv[1]), list(types.items())[1:], F.when(F.substring(id_, 1, n) == next(iter(types)), types[next(iter(types))]))


def parse_utc(c: Column) -> Column:
    """An offset-aware time; what can't be read is null."""
    return F.try_to_timestamp(c)


def localize_strict(c: Column, tz: str) -> Column:
    """Local wall time to UTC; times that the clock skips or shows twice are null. Needs a session in UTC."""
    utc = F.to_utc_timestamp(c, tz)
    gap = F.from_utc_timestamp(utc, tz) != c
    twice = (F.from_utc_timestamp(utc - F.expr("interval 1 hour"), tz) == c) | (F.from_utc_timestamp(utc + F.expr("interval 1 hour"), tz) == c)
    return F.when(~gap & ~twice, utc)


def minutes_between(a: Column, b: Column) -> Column:
    """A - b in minutes."""
    return (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 6e7


def timing_bucket(minutes: Column, edges: tuple[float, ...] = (30, 60, 120, 360, 720)) -> Column:
    """How long before the event, as '<=30', ..., '>720'."""
    out = reduce(lambda a, e: a.when(minutes <= e, f"<={e:g}"), edges[1:], F.when(minutes <= edges[0], f"<={edges[0]:g}"))
    return out.when(minutes > edges[-1], f">{edges[-1]:g}")


def encode_line(c: Column) -> Column:
    """X11: half points as a small integer."""
    return F.round(c * 2).cast("short")


def decode_line(c: Column) -> Column:
    """X11, the other way."""
    return c / 2


def safe_div(a: Column, b: Column) -> Column:
    """Null if the divisor is zero."""
    return F.try_divide(a, b)


def pair_mean(a: Column, b: Column) -> Column:
    """The mean of the two that are there."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise((a + b) / 2)


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b) of positive values."""
    return F.when((a > 0) & (b > 0), F.log(a / b))


def clamp(c: Column, lo: float, hi: float) -> Column:
    """Null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def entropy(*counts: Column) -> Column:
    """Shannon entropy in bits of vote counts; zero counts add nothing, no votes give 0."""
    total = reduce(lambda a, b: a + b, counts)
    parts = [F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(0.0) for c in counts]
    return F.when(total > 0, reduce(lambda a, b: a + b, parts)).otherwise(F.lit(0.0))


#: Spellings of a pick's side.
OVER_WORDS, UNDER_WORDS = ("over", "o", "1", "true", "yes"), ("under", "u", "0", "false", "no")


def normalize_side(c: Column) -> Column:
    """Over, under or null."""
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin(*OVER_WORDS), "over").when(s.isin(*UNDER_WORDS), "under")


def bucket(c: Column, edges: list[float], right: bool = True) -> Column:
    """Number of the interval between sorted edges (0: below the first); right: intervals hold their upper edge."""
    past = [(c > e) if right else (c >= e) for e in edges]
    return F.when(c.isNotNull(), reduce(lambda a, b: a + b, [p.cast("int") for p in past]))


CONTRIBUTION = "array<struct<feature:string,value:double,contribution:double>>"


def parse_contributions(c: Column) -> Column:
    """A JSON list of contributions, largest size first, then by feature; broken JSON is null."""
    order = lambda a, b: F.when(F.abs(a["contribution"]) > F.abs(b["contribution"]), -1).when(F.abs(a["contribution"]) < F.abs(b["contribution"]), 1).when(a["feature"] < b["feature"], -1).otherwise(1)
    return F.array_sort(F.from_json(c, CONTRIBUTION), order)


def one_hot(col: str, values: list[str], prefix: str) -> list[Column]:
    """One 0/1 column per value; null is 0 everywhere."""
    return [F.coalesce((F.col(col) == v), F.lit(False)).cast("byte").alias(f"{prefix}_{v}") for v in values]


def is_unavailable(status: Column) -> Column:
    """Statuses that keep a player out."""
    return F.coalesce(F.lower(F.trim(status)).isin("out", "doubtful"), F.lit(False))


def mentions_injury(text: Column) -> Column:
    """A comment that speaks of an injury, a common misspelling included."""
    return F.coalesce(text.rlike(r"(?i)injur|injry"), F.lit(False))
