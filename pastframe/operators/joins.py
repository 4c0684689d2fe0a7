"""Joins: pairing, merging, missing work, as-of membership, name resolution.

The physical kind is left to Catalyst and AQE; a side is only broadcast where its size is a dimension's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pastframe.functions.scalar import canonical_name, is_unavailable, mentions_injury, standardize
from pastframe.operators.topk import latest_per_key


class NotUnique(ValueError):
    """A join key that must be unique isn't."""


def require_unique(df: DataFrame, keys: list[str], what: str = "rows") -> None:
    """Fails if a key occurs twice; stops at the first."""
    if bad := df.groupBy(*keys).count().where("count > 1").limit(1).collect():
        raise NotUnique(f"{what}: key {bad[0].asDict()} is not unique")


def pair_sides(df: DataFrame, keys: list[str], side: str, shared: tuple[str, ...] = (), suffixes: tuple[str, str] = ("_TEAM_HOME", "_TEAM_AWAY"), validate: bool = True) -> DataFrame:
    """Two rows per game, told apart by a boolean, as one wide row: one aggregation, not a self join. Games without both sides go."""
    if validate:
        require_unique(df, [*keys, side], "sides")
    cols = [c for c in df.columns if c not in (*keys, side, *shared)]
    row = F.struct(*cols)
    home, away = F.max_by(row, F.when(F.col(side), 1)), F.max_by(row, F.when(~F.col(side), 1))
    one = df.groupBy(*keys).agg(home.alias("__h"), away.alias("__a"), *[F.max(c).alias(c) for c in shared]).where("__h is not null and __a is not null")
    return one.select(*keys, *shared, *[F.col(p)[c].alias(c + s) for p, s in zip(("__h", "__a"), suffixes, strict=True) for c in cols])


def attach_side_values(df: DataFrame, odds: DataFrame, key: str, side: str, triples: dict[str, tuple[str, str]], shared: tuple[str, ...] = ()) -> DataFrame:
    """Odds of a game to each side's row: out column -> (home column, away column); shared columns as they are."""
    got = df.join(odds.select(key, *dict.fromkeys([c for t in triples.values() for c in t] + list(shared))), key, "left")
    out = [F.when(F.col(side), F.col(h)).otherwise(F.col(a)).alias(n) for n, (h, a) in triples.items()]
    return got.select(*df.columns, *shared, *out)


def resolve_ids(df: DataFrame, games: DataFrame, on: list[str], id_col: str, names: tuple[str, ...] = (), name_map: dict[str, str] = {}) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """The game's id by natural key, names standardised on both sides; and one row: how many found none."""
    fix = lambda d: d.withColumns({c: standardize(F.col(c), name_map) for c in names}) if names else d
    got = fix(df).join(fix(games).select(*on, id_col).dropDuplicates(on), on, "left")
    return got, got.agg(F.count_if(F.col(id_col).isNull()).alias("unmatched"), F.count("*").alias("rows"))


def backfill_from(df: DataFrame, other: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Missing values from the other source where it has exactly one candidate for the key."""
    one = other.groupBy(*keys).agg(F.count("*").alias("__n"), *[F.max(c).alias(f"__{c}") for c in cols]).where("__n = 1")
    return df.join(one, keys, "left").select(*[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in cols else F.col(c) for c in df.columns])


def outer_coalesce(a: DataFrame, b: DataFrame, key: list[str], fills: dict[str, list[str]]) -> DataFrame:
    """Full join of two sources; out column -> columns in order of trust (a's, then b's renamed with a b_ in front if they clash)."""
    clash = [c for c in b.columns if c in a.columns and c not in key]
    got = a.join(b.withColumnsRenamed({c: f"b_{c}" for c in clash}), key, "full")
    used = {c for cs in fills.values() for c in cs}
    return got.select(*[c for c in got.columns if c not in used or c in key], *[F.coalesce(*[F.col(c) for c in cs]).alias(n) for n, cs in fills.items()])


def append_scheduled(hist: DataFrame, sched: DataFrame, strict: int = 2, required: list[str] | None = None) -> DataFrame:
    """Scheduled rows under the history with its schema; fails if more than `strict` of the required columns are null in some row."""
    cols = [F.col(c).cast(hist.schema[c].dataType).alias(c) for c in sched.columns if c in hist.columns]
    add = sched.select(*cols)
    need = required or [c for c in add.columns]
    nulls = reduce(lambda x, y: x + y, [(F.col(c).isNull() if c in add.columns else F.lit(True)).cast("int") for c in need])
    if (worst := add.agg(F.max(nulls)).first()[0]) is not None and worst > strict:
        raise ValueError(f"a scheduled row lacks {worst} of the required columns; {strict} are allowed")
    return hist.unionByName(add, allowMissingColumns=True)


def missing_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of a that b lacks."""
    return a.select(*keys).distinct().join(b.select(*keys), keys, "left_anti")


def missing_dates(a: DataFrame, b: DataFrame, keys: list[str], date: str, pad_days: int = 1) -> DataFrame:
    """The dates to fetch for what is missing: each date, and pad_days more for sources in another zone."""
    gone = a.join(b.select(*keys), keys, "left_anti").select(F.to_date(date).alias("d"))
    return gone.select(F.explode(F.sequence("d", F.date_add("d", pad_days))).alias(date)).distinct()


def find_incomplete(fact: DataFrame, games: DataFrame, item: str, game: str, date: str, min_share: float = 0.5) -> DataFrame:
    """(game, item) that lack data though the item covers at least min_share of that date's games."""
    have = fact.select(game, item).distinct().join(games.select(game, date), game)
    size = games.groupBy(date).agg(F.count_distinct(game).alias("__games"))
    expect = have.groupBy(date, item).agg(F.count_distinct(game).alias("__have")).join(size, date).where(F.col("__have") >= F.col("__games") * min_share)
    return games.select(game, date).join(expect.select(date, item), date).join(have.select(game, item), [game, item], "left_anti").select(date, game, item)


def history_join(df: DataFrame, hist: DataFrame, key: str, date: str, season: str, id_col: str, seasons_back: int = 1) -> DataFrame:
    """Each row with the earlier rows of its key in this and the last seasons_back seasons, as (id, hist_*).

    Joined on key and season, so that only the date is a range. For aggregates of the history use the windows instead.
    """
    h = hist.select(F.col(key), F.explode(F.sequence(F.col(season), F.col(season) + seasons_back)).alias(season), *[F.col(c).alias(f"hist_{c}") for c in hist.columns if c != key])
    return df.select(id_col, key, date, season).join(h, [key, season]).where(F.col(f"hist_{date}") < F.col(date)).drop(season)


def prior_matchups(games: DataFrame, pairs: DataFrame, home: str, away: str, date: str, before: str, id_col: str, min_season: int | None = None, season: str = "season_year") -> DataFrame:
    """Ids of earlier games of exactly these (home, away) pairs."""
    g = games if min_season is None else games.where(F.col(season) >= min_season)
    return g.where(F.col(date) < F.lit(before)).join(pairs.select(home, away).distinct(), [home, away], "left_semi").select(id_col, home, away, date)


def last_value_asof(events: DataFrame, probes: DataFrame, key: list[str], ts: str, values: list[str], strict: bool = True, parts: int | None = None) -> DataFrame:
    """For each probe the last event of its key before (strict) or up to its time: one union and one window, no range join.

    parts: how many tasks share events and probes; by default Spark's own number.
    """
    kind = {"e": 1, "p": 0} if strict else {"e": 0, "p": 1}
    e = events.select(*key, ts, F.struct(*values).alias("__v"), F.lit(kind["e"]).alias("__k"), F.lit(None).alias("__row"))
    p = probes.select(*key, ts, F.lit(None).alias("__v"), F.lit(kind["p"]).alias("__k"), F.struct(*[F.col(c) for c in probes.columns]).alias("__row"))
    w = Window.partitionBy(*key).orderBy(ts, "__k").rowsBetween(Window.unboundedPreceding, 0)
    both = e.unionByName(p).repartition(parts, *key) if parts else e.unionByName(p)
    got = both.withColumn("__last", F.last("__v", ignorenulls=True).over(w)).where("__row is not null")
    return got.select("__row.*", *[F.col("__last")[v].alias(f"last_{v}" if v in probes.columns else v) for v in values])


def members_asof(probes: DataFrame, sources: list[tuple[DataFrame, str]], keys: list[str], date: str, tie: str = "tie", member: str = "member", out: str = "members") -> DataFrame:
    """Probes with what the first source that knows says a key belonged to at a date: an array, null if none knows.

    sources, the one to be heard first first: (keys, date, member, tie) and how close: "before" is the last row of an
    earlier date, "upto" the last up to the date, "on" all rows of that very date. Of rows of one date the one of the
    largest tie is the last. Rows without a key, date or member don't count. One union and one window over it, whatever
    the number of sources: those of a day are gathered first, so a day is a row a source.
    """
    told, cases = [], []
    for i, (df, close) in enumerate(sources):
        rows = df.select(*keys, date, F.col(member).alias("m"), (F.col(tie) if tie in df.columns else F.lit(None)).cast("string").alias("t")).dropna(subset=[*keys, date, "m"])
        last = F.array(F.max_by("m", F.struct("t", "m"))) if close != "on" else F.array_sort(F.collect_set("m"))
        told.append(rows.groupBy(*keys, date).agg(last.alias("__m")).select(*keys, date, F.lit(i).alias("__i"), F.lit(2 if close == "before" else 0).alias("__k"), F.struct(F.col(date).alias("d"), F.col("__m").alias("m")).alias("__told")))
    kind = told[0].schema["__told"].dataType
    asked = probes.select(*keys, date, F.lit(-1).alias("__i"), F.lit(1).alias("__k"), F.lit(None).cast(kind).alias("__told"), F.struct(*[F.col(f"`{c}`") for c in probes.columns]).alias("__row"))
    w = Window.partitionBy(*keys).orderBy(date, "__k").rowsBetween(Window.unboundedPreceding, 0)
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), told, asked)
    for i, (_, close) in enumerate(sources):
        both = both.withColumn(f"__{i}", F.last(F.when(F.col("__i") == i, F.col("__told")), ignorenulls=True).over(w))
        cases.append(F.when((F.col(f"__{i}.d") == F.col(date)) if close == "on" else F.lit(True), F.col(f"__{i}.m")))
    return both.where("__i = -1").select("__row.*", F.coalesce(*cases).alias(out))


def single_dated(games: DataFrame, keys: list[str], dates: list[str]) -> tuple[DataFrame, DataFrame]:
    """The games (keys, dates) whose keys have one row, repeats aside, and the rows of those that have several.

    What the first meet needs no distinct after a join, if what they meet has none twice.
    """
    each = games.groupBy(*keys).agg(F.min(F.struct(*dates)).alias("__lo"), F.max(F.struct(*dates)).alias("__hi"))
    pick = lambda df, c: df.select(*keys, *[F.col(c)[d].alias(d) for d in dates])
    more = each.where("__lo <> __hi").select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return pick(each.where("__lo = __hi"), "__lo"), games.join(more, same, "left_semi").select(*keys, *dates).distinct()


#: Games of a run: a team's games in the order of their dates meet its spans by so many at once.
GAMES_OF_RUN = 256


def roster_asof(players: DataFrame, games: DataFrame, injuries: DataFrame, season: str = "season") -> DataFrame:
    """(game_id, team_id, player_id): players with any row for the team in the season whose last row before the date is this team.

    players: season, player_id, team_id, game_date. games: season, game_id, team_id, game_date. injuries: game_id, team_id,
    player_id of those listed unavailable; a listing by another team in the same game takes the player out, one by this
    team in. Of a player's rows of one date the largest team counts.

    A player is of a team from the day after a row to his next row's day. A team's games lie in runs by date, and runs, not
    games, meet these spans; games carry who is listed in them. So each member comes out once, as he is found: neither
    candidates nor members are shuffled. A player's games of a run come one after the other, and the next player has much
    the same ones, which columns of files keep in little room however many members there are.
    """
    key = ["game_id", "team_id", "player_id"]
    listed = injuries.select(*key)
    day = players.where(F.col(season).isNotNull() & F.col("player_id").isNotNull()).groupBy(season, "player_id", "game_date").agg(F.max("team_id").alias("team_id"))
    until = F.lead("game_date").over(Window.partitionBy(season, "player_id").orderBy("game_date"))
    spans = day.select(season, "team_id", "player_id", F.col("game_date").alias("__from"), until.alias("__until"))
    out = listed.where("team_id is not null").groupBy("game_id").agg(F.collect_set("player_id").alias("__out"))  # a game's listed players
    once, more = single_dated(games.select(season, "game_id", "team_id", "game_date"), ["game_id", "team_id"], [season, "game_date"])

    def members(g: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(season, "team_id").orderBy("game_date", "game_id")) - 1
        runs = g.join(out, "game_id", "left").withColumn("__run", F.floor(place / GAMES_OF_RUN)).groupBy(season, "team_id", "__run")
        runs = runs.agg(F.min("game_date").alias("__lo"), F.max("game_date").alias("__hi"), F.sort_array(F.collect_list(F.struct("game_date", "game_id", "__out"))).alias("__games"))
        holds = lambda lo, hi: (F.col("__from") < F.col(hi)) & (F.col("__until").isNull() | (F.col("__until") >= F.col(lo)))
        met = runs.join(spans, [season, "team_id"]).where(holds("__lo", "__hi")).select("team_id", "player_id", "__from", "__until", F.inline("__games"))
        return met.where(holds("game_date", "game_date") & (F.col("__out").isNull() | ~F.array_contains("__out", F.col("player_id")))).select(*key)

    return members(once).unionByName(members(more).distinct()).unionByName(listed.distinct())


def resolve_names(names: DataFrame, index: DataFrame, name: str = "name", recency: str = "last_date") -> tuple[DataFrame, DataFrame]:
    """Player ids by full name, then display name, then reversed name; of several the one seen last; and the names that stay unresolved.

    index: player_id, full_name, display_name, and a date of the last appearance.
    """
    plain, turned = canonical_name(F.col(name)), canonical_name(F.col(name), sort_tokens=True)
    want = names.select(name).distinct().select(name, plain.alias("__plain"), turned.alias("__turned"))
    rules = [("__plain", canonical_name(F.col("full_name"))), ("__plain", canonical_name(F.col("display_name"))), ("__turned", canonical_name(F.col("full_name"), sort_tokens=True))]
    hits = reduce(DataFrame.unionByName, [want.join(index.select(k.alias(c), "player_id", recency), c).select(name, "player_id", recency, F.lit(i).alias("rule")) for i, (c, k) in enumerate(rules)])
    w = Window.partitionBy(name).orderBy("rule", F.col(recency).desc_nulls_last(), "player_id")
    best = hits.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(name, "player_id", "rule")
    return names.join(best, name, "left"), want.join(best, name, "left_anti").select(name)


def team_at_cutoff(players: DataFrame, cutoffs: DataFrame, season: str = "season", date: str = "game_date", injuries: DataFrame | None = None, known: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Each player's team at the season's cut-off date: that of the last row up to it.

    With injuries (season, player_id, team_id, date) a player without such a row is of the team that last listed him up to
    then, and with known (season, player_id, team_id) else of the team given there. asked: (season, player_id) to be told
    of, with null where no source knows; without it, those whom one does.
    """
    upto = players.join(F.broadcast(cutoffs), season).where(F.col(date) <= F.col("cutoff"))  # one row per season
    if injuries is None and known is None and asked is None:
        return upto.groupBy(season, "player_id").agg(F.max_by("team_id", F.struct(date, "team_id")).alias("team_id"))
    key = [season, "player_id"]
    said = lambda df, day: df.select(*key, day.cast("date").alias("__day"), F.col("team_id").alias("member"), F.col("team_id").cast("string").alias("tie"))
    sources = [(said(players, F.col(date)), "upto")]
    sources += [(said(injuries, F.col(date)), "upto")] if injuries is not None else []
    sources += [(said(known, F.lit("0001-01-01")), "upto")] if known is not None else []
    probes = (asked.select(*key) if asked is not None else reduce(DataFrame.unionByName, [df.select(*key) for df, _ in sources])).distinct()
    probes = probes.join(F.broadcast(cutoffs), season).select(*key, F.col("cutoff").alias("__day"))
    got = members_asof(probes, sources, key, "__day").select(*key, F.col("members")[0].alias("team_id"))
    return got if asked is not None else got.where("team_id is not null")


def safe_join(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner", validate: str = "one_to_one") -> DataFrame:
    """Fails where the key isn't unique on a side that must have it once."""
    left, right = validate.split("_to_")
    if left == "one":
        require_unique(a, on, "left side")
    if right == "one":
        require_unique(b, on, "right side")
    return a.join(b, on, how)


def assemble_dataset(base: DataFrame, snaps: DataFrame, history: DataFrame, game: str = "game_id", snapshot: str = "snapshot", sidecar: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Snapshots with their game's base and history features, and the columns for scoring apart, joinable by (game, snapshot)."""
    full = snaps.join(base, game).join(history, game, "left")
    return full.drop(*sidecar), full.select(game, snapshot, *sidecar)


def merge_measures(a: DataFrame, b: DataFrame, keys: list[str], rename: dict[str, str] = {}) -> DataFrame:  # noqa: B006
    """Two measurement sets of the same rows; columns that both have come from a."""
    b = b.withColumnsRenamed(rename)
    return a.join(b.drop(*[c for c in b.columns if c in a.columns and c not in keys]), keys)


def listed_unavailable(report: DataFrame, players: DataFrame, games: DataFrame) -> DataFrame:
    """(game_id, team_id, player_id) of those that a report lists as unavailable, matched by name inside the named team.

    A day's listed players are told once and so are games, so what they make is never shuffled to find repeats.
    """
    r = report.where(is_unavailable(F.col("status"))).select("team_id", "game_date", canonical_name(F.col("player_name")).alias("__n"))
    p = latest_per_key(players.select("team_id", "player_id", canonical_name(F.col("player_name")).alias("__n"), "game_date"), ["team_id", "__n"], ["game_date", "player_id"]).drop("game_date")
    out = r.join(p, ["team_id", "__n"]).select("team_id", "game_date", "player_id").distinct()
    once, more = single_dated(games.select("game_id", "team_id", "game_date"), ["game_id", "team_id"], ["game_date"])
    found = lambda g: g.join(out, ["team_id", "game_date"]).select("game_id", "team_id", "player_id")
    return found(once).unionByName(found(more).distinct())


def unavailable(injuries: DataFrame, players: DataFrame) -> DataFrame:
    """(game_id, team_id, player_id) from the injury table and from comments that speak of an injury."""
    said = players.where(mentions_injury(F.col("comment")))
    keys = ["game_id", "team_id", "player_id"]
    return injuries.select(*keys).unionByName(said.select(*keys)).distinct()


def membership_between(probes: DataFrame, events: DataFrame, keys: list[str], probe_date: str, event_date: str, days: int) -> DataFrame:
    """Rows of events within `days` before each probe, joined on the key and a day bucket, so that only neighbours meet."""
    b = lambda c: F.floor(F.unix_date(F.to_date(c)) / days)
    e = events.select(*keys, event_date, F.explode(F.array(b(event_date), b(event_date) + 1)).alias("__b"), *[c for c in events.columns if c not in (*keys, event_date)])
    got = probes.withColumn("__b", b(probe_date)).join(e, [*keys, "__b"]).drop("__b")
    return got.where((F.col(event_date) < F.col(probe_date)) & (F.datediff(probe_date, event_date) <= days))
