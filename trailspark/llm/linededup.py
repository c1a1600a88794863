"""Line dedup by distinct-site spread.

Lines are normalised and hashed; a HyperLogLog sketch of the sites of each line hash is merged by aggregation. Lines whose
estimate is clearly above the threshold are boilerplate; those near it get an exact distinct count. Every boilerplate line is
then taken out of all documents but the first that has it, so that no text is lost from the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, picked

#: Sites on which a line must stand; words that it must have.
MIN_SITES, MIN_WORDS = 4, 3
#: log2 of the sketches' registers, and the relative error of an estimate that counts as near: six standard errors.
LG_K = 12
NEAR = 6 * 1.04 / 2 ** (LG_K / 2)


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))


def lines_of(docs: DataFrame, min_words: int) -> DataFrame:
    """row (a digest of id and text), doc_id, site, pos and the two hashes of each line with enough words."""
    return (
        docs.select("row", "doc_id", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select("row", "doc_id", "site", "pos", normalised(F.col("line")).alias("line"))
        .where(F.length("line") - F.length(F.replace("line", F.lit(" "))) + 1 >= min_words)
        .where(F.col("line") != "")
        .select("row", "doc_id", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"))
    )


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """h1, h2 and the first place (doc_id, pos) of each line that stands on min_sites sites or more. Null sites count as none."""
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"), F.count("*").alias("n"), F.min(F.struct("doc_id", "pos", "row")).alias("first"))
    spread = cut(spread.where(F.col("n") >= min_sites).where(F.col("sites") >= min_sites * (1 - NEAR) - 1))
    near = F.abs(F.col("sites") - min_sites) <= min_sites * NEAR + 1
    exact = lines.join(spread.where(near).select("h1", "h2"), ["h1", "h2"]).where(F.col("site").isNotNull()).select("h1", "h2", "site").distinct().groupBy("h1", "h2").count().where(F.col("count") >= min_sites).select("h1", "h2")
    # written: where it is small, lines meet it without a shuffle, else the planner splits the hot ones
    return cut(spread.where(~near).select("h1", "h2", "first").unionByName(spread.join(exact, ["h1", "h2"]).select("h1", "h2", "first")))


def marked(docs: DataFrame, min_sites: int, min_words: int, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """row, gone: the positions of the lines to take out of each text that has such lines."""
    lines = cut(lines_of(picked(docs, doc_id=id_col, text=text_col, site=site_col).withColumn("row", F.xxhash64("doc_id", "text")), min_words))
    places = lines.join(boilerplate(lines, min_sites), ["h1", "h2"]).where(~F.struct("doc_id", "pos", "row").eqNullSafe(F.col("first")))
    return places.groupBy("row").agg(F.collect_set("pos").alias("gone"))


def cleaned(gone: str = "gone") -> Column:
    """The text without the lines at the positions in gone; as it is where gone is null."""
    # in time of the text's length: the positions left are a difference of sets, and the lines are cut once, as x
    left = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone)
    kept = F.transform(F.array(F.split("text", "\n")), lambda x: F.transform(left(x), lambda i: F.get(x, i)))
    return F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.get(kept, F.lit(0)), "\n"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """doc_id, text without boilerplate lines, n_removed. The first place of a line (smallest doc_id, null ids first, then
    position) keeps it; rows repeated whole share their places. Texts of any length are read whole; null texts stay null; empty tables give empty ones; other
    columns are left out."""
    own = picked(docs, doc_id=id_col, text=text_col).withColumn("row", F.xxhash64("doc_id", "text"))
    return own.join(marked(docs, min_sites, min_words, id_col, text_col, site_col), "row", "left").select("doc_id", cleaned().alias("text"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def report(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs)


def report_sql(min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> str:
    """The same in DuckDB's SQL, for unique ids."""
    return rf"""WITH cut AS (SELECT doc_id, source, unnest(parts) AS raw, generate_subscripts(parts, 1) - 1 AS pos FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents)),
lines AS (SELECT doc_id, source, pos, raw, lower(trim(regexp_replace(raw, '\s+', ' ', 'g'))) AS line FROM cut),
wide AS (SELECT line, min(row(doc_id, pos)) AS place FROM lines WHERE line <> '' AND len(string_split(line, ' ')) >= {min_words} GROUP BY line HAVING count(DISTINCT source) >= {min_sites}),
marked AS (SELECT l.doc_id, l.pos, l.raw, w.line IS NOT NULL AND row(l.doc_id, l.pos) <> w.place AS gone FROM lines l LEFT JOIN wide w USING (line))
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(m.raw, chr(10) ORDER BY m.pos) FILTER (WHERE NOT m.gone), '') END AS text, count(*) FILTER (WHERE m.gone) AS n_removed
FROM documents d LEFT JOIN marked m USING (doc_id) GROUP BY d.doc_id, d.text"""


def drop_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs in their own columns with the cleaned text and its length; documents of which nothing is left go. Rows with a null or empty
    text or a null id stay; rows that share an id are told apart by their texts; a column named row or gone stays as it is."""
    row, gone = (fresh(docs, name) for name in ("row", "gone"))
    places = marked(docs, min_sites, MIN_WORDS, "doc_id", "text", "source").toDF(row, gone)
    out = docs.withColumn(row, F.xxhash64("doc_id", "text")).join(places, row, "left").withColumn("text", cleaned(gone))
    return out.where(F.col(gone).isNull() | (F.trim("text") != "")).withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.char_length("text"))).select(*docs.columns)
