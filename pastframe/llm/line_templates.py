"""Line dedup by a log-template tree: lines that say the same up to variable fields, in many documents, are dropped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastframe.llm.common import let, row_key, salted_join, settled, written

#: Leading tokens that choose a leaf of the tree, after the token count.
DEPTH = 4
#: Parts of the tokens behind them that divide a leaf's lines further.
PARTS = 3
#: Share of a line's tokens behind the leading ones that must equal the template: of one to four, all of them.
ALIKE = 0.8
#: A template recurs if it is found in so many documents; lines of LONG tokens recur by chance no more in LONG_DOCS.
MIN_DOCS, LONG_DOCS, LONG = 3, 2, 50
#: So many leaves go out as a broadcast (16 bytes each); more are joined by a shuffle of the lines.
FEW = 200_000
_SPACE = r"[\x20\x09-\x0D]+"


def masked(line: Column) -> Column:
    """The line's tokens with a space between; those with a digit are variable fields, written <*>, unless all tokens are such."""
    untidy = F.contains(line, F.lit("  "))
    for sign in "\t\x0b\x0c\r":
        untidy = untidy | F.contains(line, F.lit(sign))
    plain = F.trim(F.when(untidy, F.regexp_replace(line, _SPACE, " ")).otherwise(line))
    said = plain.rlike("[0-9]") & plain.rlike(r"(?:^| )[^ 0-9]++(?: |$)")
    return F.when(said, F.regexp_replace(plain, r"(?:\G|(?<= ))[^ 0-9]*+[0-9][^ ]*+", "<*>")).otherwise(plain)


def _pair(*cols: Column) -> tuple[Column, Column]:
    """A 128-bit hash as two numbers."""
    return F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)


def parsed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per line with a token: row key, id, line number, masked line, token count, hashes of line and leaf."""
    lines = df.select(row_key(id_col, text_col).alias("key"), F.col(f"`{id_col}`").alias("id"), F.posexplode(F.split(F.col(f"`{text_col}`"), "\n")).alias("ln", "line"))
    lines = lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select("key", "id", "ln", masked(F.col("line")).alias("m"))
    n = F.length("m") - F.length(F.replace(F.col("m"), F.lit(" "), F.lit(""))) + 1
    lines = lines.withColumn("n", n).withColumn("lead", F.substring_index("m", " ", DEPTH))
    (h1, h2), (f1, f2) = _pair(F.col("m")), _pair(F.col("n"), F.col("lead"))
    return lines.select("key", "id", "ln", "m", "n", h1.alias("h1"), h2.alias("h2"), f1.alias("f1"), f2.alias("f2"))


def followed(lines: DataFrame) -> DataFrame:
    """(h1, h2, t1, t2) of the distinct lines (h1, h2, f1, f2, m) that follow the template of their group (f1, f2).

    The template has at each place the token that most lines of the group have there (of those, the smallest); a line
    follows it if ALIKE of its tokens behind the leading ones, which the group has in common, are the same. Tokens are counted with partial aggregation: no group is gathered.
    """
    group = ["f1", "f2"]
    counts = lines.select(*group, F.posexplode(F.split("m", " ")).alias("at", "token")).groupBy(*group, "at", "token").agg(F.count("*").alias("c"))
    modal = counts.groupBy(*group, "at").agg(F.min(F.struct(-F.col("c"), "token")).alias("best"))
    template = modal.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("at", F.col("best.token").alias("token")))).alias("t"))
    template = template.select(*group, F.transform("t", lambda x: x["token"]).alias("t"))
    same = F.size(F.filter(F.zip_with(F.split("m", " "), "t", lambda a, b: a == b), lambda x: x))
    t1, t2 = _pair(F.lit("template"), F.col("f1"), F.col("f2"))
    return lines.join(template, group).where(same - DEPTH >= ALIKE * (F.size("t") - DEPTH)).select("h1", "h2", t1.alias("t1"), t2.alias("t2"))


def _part(k: int) -> Column:
    """The tokens behind the leading ones at places k, k + PARTS, ..., as one text."""
    rest = F.slice(F.split("m", " "), DEPTH + 1, 1 << 30)
    return F.array_join(F.filter(rest, lambda _, i: i % PARTS == k), " ")


def leaf_templates(lines: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """(h1, h2, t1, t2): the template of each line that shares its leaf with another line and follows a template there.

    A leaf first has one template, made of all its distinct lines. Lines that don't follow it are divided anew, PARTS
    times: those of a leaf that agree on one of the PARTS interlaced parts of their further tokens make a group with a
    template of its own, and what doesn't follow goes on to the next part. So two boilerplates of one leaf are told apart,
    and a leaf full of unrelated lines doesn't hide a template among them, unless its lines differ in every part.
    places: the hashes of the same lines, if they are at hand. Leaves that lines share are broadcast up to FEW of them.
    """
    leaf, line = ["f1", "f2"], ["h1", "h2"]
    shared = (lines if places is None else places).where(F.col("n") > DEPTH).groupBy(*leaf).agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select(*leaf)
    shared = written(shared, "shared-leaves")
    shared = F.broadcast(shared) if shared.count() <= FEW else shared
    own = lines.join(shared, leaf, "left_semi").groupBy(*line).agg(*(F.first(c).alias(c) for c in ("f1", "f2", "m")))
    rest = own = written(own, "leaf-lines")
    found = [written(followed(own), "followed")]
    for k in range(PARTS):
        rest = rest.join(found[-1].select(*line), line, "left_anti")
        g1, g2 = _pair(F.lit(k), F.col("f1"), F.col("f2"), _part(k))
        part = rest.select(*line, "f1", "f2", "m", g1.alias("g1"), g2.alias("g2"))
        alike = part.groupBy("g1", "g2").agg(F.count("*").alias("c")).where("c > 1").select("g1", "g2")
        group = part.join(alike, ["g1", "g2"], "left_semi").select(*line, F.col("g1").alias("f1"), F.col("g2").alias("f2"), "m")
        found.append(written(followed(group), "followed"))
    return reduce(DataFrame.unionByName, found)


def recurring_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, long_docs: int = LONG_DOCS) -> DataFrame:
    """(key, drop): for each row with such lines, the numbers of lines whose template recurs, its first place excepted.

    A template recurs if min_docs different documents (id and text) hold it, or long_docs if its lines have LONG tokens or
    more; its place of smallest id, then smallest line number, stays. Rows that are repeated whole count once and keep the
    same lines. A template that stands in a third of all lines is no task's burden: its lines are dealt to many.
    """
    base = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def templates() -> DataFrame:
        lines = parsed(base, "id", "text")
        places = written(lines.select("key", "id", "ln", "n", "h1", "h2", "f1", "f2"), "lines")
        of = leaf_templates(lines, places)
        met = salted_join(places.select("key", "id", "ln", "n", "h1", "h2"), of, ["h1", "h2"], "left")
        return met.select("key", "id", "ln", "n", F.coalesce("t1", "h1").alias("t1"), F.coalesce("t2", "h2").alias("t2"))

    placed = settled(df.sparkSession, templates, "templates")
    per_doc = placed.groupBy("t1", "t2", "key").agg(F.min(F.struct("id", "ln")).alias("first"), F.first("n").alias("n"))
    common = per_doc.groupBy("t1", "t2").agg(F.count("*").alias("docs"), F.min("first").alias("first"), F.first("n").alias("n"))
    common = common.where(F.col("docs") >= F.when(F.col("n") >= LONG, long_docs).otherwise(min_docs)).select("t1", "t2", "first")
    again = salted_join(placed.drop("n"), common, ["t1", "t2"]).where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("ln") == F.col("first.ln"))))
    return again.groupBy("key").agg(F.collect_set("ln").alias("drop"))


def without_lines(text: Column, drop: Column) -> Column:
    """The text without the lines of these numbers, in time linear in both."""
    kept = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), drop), lambda i: F.get(x, i))
    return F.array_join(let(F.split(text, "\n"), kept), "\n")


def with_kept_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, long_docs: int = LONG_DOCS) -> DataFrame:
    """df with text_col rid of recurring lines, and n_dropped, how many went (a column of that name is replaced).

    A text that loses all its words becomes empty. Null and empty texts stay as they are; so do texts without recurring
    lines, to the byte. Very long texts are one row each, never cut. An empty table stays empty.
    """
    drops = recurring_lines(df, id_col, text_col, min_docs, long_docs).select(F.col("key").alias("__key"), F.col("drop").alias("__drop"))
    met = df.withColumn("__key", row_key(id_col, text_col)).join(drops, "__key", "left")
    text = F.when(F.col("__drop").isNull(), F.col(f"`{text_col}`")).otherwise(without_lines(F.col(f"`{text_col}`"), F.col("__drop")))
    cols = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns if c != "n_dropped"]
    return met.select(*cols, F.coalesce(F.size("__drop"), F.lit(0)).alias("n_dropped"))


def drop_recurring_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, long_docs: int = LONG_DOCS) -> DataFrame:
    """df's rows and columns, without recurring lines, and without rows that those lines were all of."""
    kept = with_kept_lines(df, id_col, text_col, min_docs, long_docs).where(F.col("n_dropped").eqNullSafe(F.lit(0)) | F.col(f"`{text_col}`").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(*[F.col(f"`{c}`") for c in df.columns]) if "n_dropped" not in df.columns else kept
