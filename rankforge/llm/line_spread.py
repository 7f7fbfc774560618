"""Line dedup by distinct-site spread.

For each line (white space at the ends off) the sites that hold it are counted by HyperLogLog sketches, which Spark
merges by aggregation (partial sketches on the map side, so a line in a third of all rows costs a sketch a task).
Lines whose estimate is nearer to the threshold than the sketch's error get an exact distinct count, from (line, site)
pairs made distinct before they are counted. Lines on ``min_sites`` sites or more are boilerplate: every occurrence
but the first (by identifier, hash of the text, position) is taken out.

Defined cases: a null text counts as empty, a null site as a site of its own name (empty); blank lines are never counted
or removed; rows that repeat identifier and text are one document and get the same result; null identifiers sort
first; an empty table gives an empty frame; all other columns pass through unchanged, whatever their names (but
``__pieces``, ``__cut`` and the like, which are ours). Texts are cut as whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.cutting import KEY, cut_positions, kept_pieces, keyed, without
from rankforge.llm.shared import written

#: Distinct sites from which a line is boilerplate; log2 of the sketch's registers; band around the threshold in
#: multiples of the sketch's relative error.
MIN_SITES, REGISTERS, BAND = 5, 12, 4.0


def split_lines(text):
    return F.split(text, "\n")


def lines_of(df: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    site = F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("__site")
    docs = keyed(df, id_col, text_col, site)
    lines = docs.select(*KEY, "__site", F.posexplode(split_lines(F.col("__text"))).alias("__pos", "__line"))
    line = F.trim(F.regexp_replace("__line", "[\\t\\r\\x0b\\f]", " "))
    return lines.withColumn("__line", line).where(F.length("__line") > 0).select(*KEY, "__site", "__pos", F.xxhash64("__line").alias("__h"), F.hash("__line").alias("__g"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, registers: int = REGISTERS) -> DataFrame:
    """``__h, __g, sites, __first`` of the lines on ``min_sites`` sites or more."""
    line = ["__h", "__g"]
    place = F.struct(*KEY, "__pos")
    spread = lines.groupBy(*line).agg(F.hll_sketch_agg("__site", F.lit(registers)).alias("s"), F.min(place).alias("__first"), F.count("*").alias("n"))
    spread = spread.where(F.col("n") >= min_sites).select(*line, F.hll_sketch_estimate("s").alias("est"), "__first")
    width = max(1.0, BAND * min_sites * 1.04 / 2 ** (registers / 2))
    spread = spread.where(F.col("est") >= min_sites - width)
    near = F.col("est") <= min_sites + width
    spread = written(spread.withColumn("near", near), "line-spread")
    wanted = spread.where("near").select(*line)
    exact = lines.select(*line, "__site").join(wanted, line, "left_semi").distinct().groupBy(*line).agg(F.count("*").alias("exact"))
    far = spread.where("not near").select(*line, F.col("est").cast("long").alias("sites"), "__first")
    close = spread.where("near").join(exact, line).select(*line, F.col("exact").alias("sites"), "__first")
    return far.unionByName(close.where(F.col("sites") >= min_sites))


def remove_boilerplate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, registers: int = REGISTERS) -> DataFrame:
    """All rows and columns of ``df``, the text without boilerplate, with ``__n_lines`` and ``__n_removed`` added."""
    lines = lines_of(df, id_col, text_col, site_col)
    bad = boilerplate(lines, min_sites, registers).select("__h", "__g", "__first")
    hits = lines.join(bad, ["__h", "__g"]).where(F.struct(*KEY, "__pos") != F.col("__first"))
    cuts = cut_positions(hits.select(*KEY, F.col("__pos").alias("__from"), F.col("__pos").alias("__to")))
    out = without(df, cuts, id_col, text_col, split_lines)
    new = F.when(F.size("__cut") == 0, F.col(text_col)).otherwise(F.array_join(kept_pieces(), "\n"))
    counts = {"__n_lines": F.size("__pieces").cast("long"), "__n_removed": F.size("__cut").cast("long"), text_col: new}
    return out.withColumns(counts).select(*df.columns, "__n_lines", "__n_removed")


def line_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    out = remove_boilerplate(df.select(id_col, text_col, site_col), id_col, text_col, site_col, min_sites)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return out.select(id_col, F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.length(text).cast("long").alias("n_chars_kept"), F.sha2(text, 256).alias("text_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS site, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT doc_id, site, unnest(l) AS raw, unnest(range(len(l))) AS pos FROM d),
n AS (SELECT doc_id, site, pos, raw, trim(translate(raw, chr(9) || chr(13) || chr(11) || chr(12), '    '), ' ') AS line FROM e),
b AS (SELECT line, min(doc_id * 1000000000 + pos) AS head FROM n WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
k AS (SELECT n.doc_id, n.pos, n.raw, b.line IS NOT NULL AND n.doc_id * 1000000000 + n.pos <> b.head AS gone FROM n LEFT JOIN b USING (line)),
j AS (SELECT doc_id, count(*) AS n_lines, count_if(gone) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS t FROM k GROUP BY doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, length(t)::BIGINT AS n_chars_kept, sha256(t) AS text_sha256 FROM j
"""
