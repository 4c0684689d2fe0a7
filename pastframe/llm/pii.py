"""Personal data by patterns, and by contextual extraction that is bootstrapped from what the patterns find.

DataFrame functions only: the texts never leave the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastframe.llm.common import let, row_key, salted_join, settled, written

KINDS = ("email", "ip", "card", "phone")
# Possessive quantifiers and the condition on what stands before make each scan linear; the matches are the same ones
# that the plain patterns give: a run that fails from its start fails from every later place in it.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without this hold no match of the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: A token with a digit or an @, and those that follow it at one space each.
CANDIDATE = r"(?:\G|(?<![^\x20\x09-\x0D]))[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+(?:\x20[^\x20\x09-\x0D0-9@]*+[0-9][^\x20\x09-\x0D]*+)*+"
#: The last two words of what stands before a run, or its only one, however long they are; each word is a start once, so time is linear.
CONTEXT = r"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++)?[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+\z"
#: Places are summed in chunks of so many matches.
CHUNK = 256


@dataclass(frozen=True)
class Bootstrap:
    """rounds of scoring; confidence that patterns and instances must reach; seeds that must support a pattern."""

    rounds: int = 3
    confidence: float = 0.8
    support: int = 4


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits pass Luhn's check; false, uncomputed, for others."""
    n = F.length(digits)
    d = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, x.try_cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), x.try_cast("int") + 1)))
    total = F.aggregate(d, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.when(n.between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def passes(kind: str, m: Column) -> Column:
    """What a match must also be."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda x: F.coalesce(F.ltrim(x, F.lit("0")).rlike(r"^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"), F.lit(False)))
    if kind == "card":
        return _luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _ends(lengths: Column) -> Column:
    """Running sums of an array, in two levels: an array grows by copying, so none may grow longer than CHUNK or the number of chunks."""
    empty = F.array().cast("array<int>")
    grow = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"))
    zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def within(all_: Column) -> Column:
        n = F.ceil(F.size(all_) / CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.aggregate(F.slice(all_, k * CHUNK + 1, F.lit(CHUNK)), zero, grow))

    def joined(chunks: Column) -> Column:
        tail = F.transform(chunks, lambda c: c["at"])
        before = F.aggregate(tail, F.struct(F.lit(0).alias("at"), empty.alias("out")), lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        return F.flatten(F.zip_with(chunks, before, lambda c, o: F.transform(c["out"], lambda x: x + o)))

    return let(lengths, lambda all_: F.when(F.size(all_) > 0, let(within(all_), joined)).otherwise(empty))


def located(text: Column, pattern: str, context: str | None = None) -> Column:
    """Matches of a pattern in order, with the code points where they start and end, and with a context also what matches
    that in the text between the match before and this one.

    The pieces between matches and the matches themselves alternate, so the places are running sums of their lengths;
    time is linear in text and matches.
    """
    matches, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    before = lambda p: [] if context is None else [F.regexp_extract(p, context, 0).alias("before")]
    both = let(matches, lambda ms: F.zip_with(F.slice(pieces, 1, F.size(ms)), ms, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("text"), *before(p))))

    def placed(found: Column) -> Column:
        ends = _ends(F.transform(found, lambda x: x["gap"] + F.length(x["text"])))
        return F.zip_with(found, ends, lambda x, e: F.struct((e - F.length(x["text"])).alias("start"), e.alias("end"), x["text"].alias("text"), *([] if context is None else [x["before"].alias("before")])))

    return let(both, placed)


def base_spans(text: Column) -> Column:
    """array of (kind, start, end): kinds in the order of KINDS, then by start."""

    def of(kind: str) -> Column:
        found = F.filter(located(text, PATTERNS[kind]), lambda x: passes(kind, x["text"]))
        spans = F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
        may = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else text.rlike("[0-9]")
        return F.when(may, spans).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int>>"))

    return F.concat(*map(of, KINDS))


def candidates(found: DataFrame) -> DataFrame:
    """One row per identifier-like run: key, start, end, its text without signs at its edges, base kind if any, contexts.

    found: key, base, runs. A run that equals a base span is a seed of that kind (of several the first of KINDS); one that
    merely meets a base span is left out. Runs of a text don't meet each other, so base spans and runs in the order of
    their starts tell who meets whom: a row's spans are sorted once each way, and no run looks through all spans.
    """
    runs = found.select("key", F.explode("runs").alias("c"))
    lead = F.length(F.regexp_extract("c.text", r"^[^A-Za-z0-9+]*+", 0))
    core = F.regexp_extract("c.text", r"^[^A-Za-z0-9+]*+(.*?)[^A-Za-z0-9]*$", 1)
    c = runs.select("key", (F.col("c.start") + lead).alias("start"), core.alias("instance"), F.lower("c.before").alias("before"))
    words = F.regexp_extract_all("before", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    last = F.element_at(words, F.when(F.size(words) > 0, F.lit(-1)))
    two = F.when(F.size(words) > 1, F.concat_ws(" ", F.element_at(words, F.when(F.size(words) > 1, F.lit(-2))), last))
    patterns = F.array_compact(F.array(F.concat(F.lit("1 "), last), F.concat(F.lit("2 "), two)))
    c = c.select("key", "start", (F.col("start") + F.length("instance")).alias("end"), "instance", patterns.alias("patterns")).distinct()
    base = found.select("key", F.explode("base").alias("b")).select("key", "b.start", "b.end", F.array_position(F.array(*map(F.lit, KINDS)), F.col("b.kind")).alias("rank")).distinct()
    both = c.withColumn("rank", F.lit(None).cast("bigint")).unionByName(base.select("key", "start", "end", F.lit(None).cast("string").alias("instance"), F.lit(None).cast("array<string>").alias("patterns"), "rank"))
    is_base = F.col("rank").isNotNull()
    onward = Window.partitionBy("key").orderBy("start", F.col("rank").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("key").orderBy(F.col("start").desc(), F.col("rank").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy("key", "start", "end")
    seen = both.withColumn("reach", F.max(F.when(is_base, F.col("end"))).over(onward)).withColumn("next", F.min(F.when(is_base, F.col("start"))).over(back)).withColumn("own", F.min("rank").over(same))
    kind = F.get(F.array(*map(F.lit, KINDS)), F.col("own").cast("int") - 1)
    meets = F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))
    return seen.where(~is_base & (F.col("own").isNotNull() | ~meets)).select("key", "start", "end", "instance", kind.alias("kind"), "patterns")


def discovered(cands: DataFrame, p: Bootstrap = Bootstrap()) -> DataFrame:
    """(instance, kind) of the identifiers that confident patterns vouch for.

    Seeds induce the patterns: the one and the two words before them. In each round a pattern's confidence in a kind is
    the mean score of the instances it stands before, and an unseen instance's score is that of the best pattern with
    enough support. Both are joins and partial aggregations over the pattern-instance graph, with no group gathered.
    """
    unit = F.sha2(F.col("instance"), 256)
    edges = written(cands.select(unit.alias("i"), "kind", F.explode("patterns").alias("pattern")).groupBy("i", "kind", "pattern").agg(F.count("*").alias("n")), "pii-graph")
    seeds = edges.where("kind is not null")
    induced = seeds.groupBy("pattern", "kind").agg(F.sum("n").alias("s")).where(F.col("s") >= p.support)
    all_of = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
    base = induced.join(all_of, "pattern").select("pattern", F.col("kind").alias("of"), "s", "total")
    fresh = edges.where("kind is null").select("i", "pattern", "n")
    scores = None
    for _ in range(p.rounds):
        conf = base.withColumn("gain", F.lit(0.0))
        if scores is not None:
            gain = salted_join(fresh, scores, ["i"]).groupBy("pattern", "of").agg(F.sum(F.col("n") * F.col("score")).alias("gain"))
            conf = base.join(gain, ["pattern", "of"], "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))
        conf = conf.select("pattern", "of", ((F.col("s") + F.col("gain")) / (F.col("total") + 1)).alias("confidence"))
        scores = written(salted_join(fresh, conf, ["pattern"]).groupBy("i", "of").agg(F.max("confidence").alias("score")).where(F.col("score") >= p.confidence / 2), "pii-scores")
    best = scores.where(F.col("score") >= p.confidence).groupBy("i").agg(F.max(F.struct("score", "of")).alias("best"))
    return best.select("i", F.col("best.of").alias("kind"), F.col("best.score").alias("score"))


def find_personal_data(df: DataFrame, p: Bootstrap = Bootstrap(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and spans of every row: arrays of (kind, start, end), code points, end exclusive.

    base: the spans of PATTERNS, kinds in the order of KINDS, then by start. spans: those and the discovered ones, which
    never meet a base span. Null texts count as empty and have no spans; repeated rows get equal results; rows that share
    an id but not a text are told apart. Very long texts take time linear in their length and matches. Other columns,
    whatever their names, are not carried; an empty table gives no rows. The texts are read once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).select(row_key("id", "text").alias("key"), "id", text.alias("text"))
    none = F.array().cast("array<struct<start:int,end:int,text:string,before:string>>")
    runs = F.when(F.col("text").rlike("[0-9@]"), located(F.col("text"), CANDIDATE, CONTEXT)).otherwise(none)
    found = written(docs.select("key", "id", base_spans(F.col("text")).alias("base"), runs.alias("runs")), "pii-found")

    def discoveries() -> DataFrame:
        cands = written(candidates(found), "pii-candidates")
        new = cands.where("kind is null").withColumn("i", F.sha2("instance", 256))
        new = salted_join(new, discovered(cands, p).select("i", F.col("kind").alias("of")), ["i"])
        more = new.select("key", F.col("of").alias("kind"), "start", "end").distinct()
        return more.groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))

    more = settled(df.sparkSession, discoveries, "pii-discovered")
    out = found.select("key", "id", "base").join(more, "key", "left")
    rank = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k)
    keyed = F.transform(F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>"))), lambda x: F.struct(rank(x["kind"]).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    spans = F.transform(F.array_sort(keyed), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return out.select(F.col("id").alias(id_col), "base", spans.alias("spans"))


def spelled(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
