"""Sources: document folders, questions, relevance labels; text and title of HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.functions.text import normalize, stable_hash, strip

SUFFIXES = r"(?i)\.(txt|md|markdown|html|htm)$"
QUESTION = "id string, question string, reference_answer string, expected_keywords array<string>, relevant_doc_ids array<string>, category string, difficulty string, answer_type string"


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and tags out, white space collapsed."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style\b.*?</style>", " ")
    return normalize(F.regexp_replace(out, r"(?s)<[^>]+>", " "))


def html_title(html: Column) -> Column:
    """The text of the first title element without attributes; null if there is none."""
    pattern = r"(?is)<title>(.*?)</title>"
    return F.when(html.rlike(pattern), normalize(F.regexp_extract(html, pattern, 1)))


def title_case(text: Column) -> Column:
    """The first letter of each run of letters in upper case, the others in lower case."""
    letters = r"[\p{Lu}\p{Ll}\p{Lt}]+"
    runs = F.regexp_extract_all(text, F.lit(rf"{letters}|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")


def title(raw: Column, stem: Column, extension: Column) -> Column:
    """A Markdown file's first heading of level one, else the HTML title, else the file's stem in words."""
    pattern = rf"(?m)^[^\S\r\n]*#[^\S\r\n]+([^\s][^\r\n]*)$"
    heading = F.when(extension.isin(".md", ".markdown") & raw.rlike(pattern), strip(F.regexp_extract(raw, pattern, 1)))
    return F.coalesce(heading, html_title(raw), title_case(F.translate(stem, "_-", "  ")))


def document_id(stem: Column, relative: Column) -> Column:
    slug = F.lower(F.regexp_replace(F.regexp_replace(relative, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(stem.rlike(r"^doc_[A-Za-z0-9_-]+$"), stem).otherwise(F.concat(F.lit("doc_"), stable_hash(slug, 10)))


def located(spark: SparkSession, path: str) -> tuple[bool, str]:
    """Whether a path of any store is a single file, and its absolute path inside the store."""
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = named.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(named):
        raise FileNotFoundError(path)
    return store.getFileStatus(named).isFile(), store.makeQualified(named).toUri().getPath()


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, path, title, text, extension`` of a file or, recursively, a folder, in any store that Spark reads."""
    single, root = located(spark, path)
    address = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.regexp_replace("value", "\r\n?", "\n").alias("raw"), F.regexp_replace(address, "^file:/+", "/").alias("path"))
    if not single:
        raw = raw.where(F.col("path").rlike(SUFFIXES))
    name = F.element_at(F.split("path", "/"), -1)
    stem, extension = F.regexp_replace(name, r"\.[^.]*$", ""), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    inside = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    relative = F.substring(inside, len(root.rstrip("/")) + 2, F.lit(1 << 30)) if not single else name
    text = F.when(extension.isin(".html", ".htm"), html_text(F.col("raw"))).otherwise(F.col("raw"))
    out = raw.select(document_id(stem, relative).alias("doc_id"), "path", title(F.col("raw"), stem, extension).alias("title"), text.alias("text"), extension.alias("extension"))
    if out.limit(1).count() == 0:
        raise ValueError(f"no documents in {path}")
    return out


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a JSON-lines file with their ``line`` numbers; blank lines go, a line that is no JSON object of the schema
    raises with path and number. For stated sets (questions, labels): a file is one row on its way."""
    located(spark, path)
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "said")).where(strip(F.col("said")) != "")
    made = F.from_json("said", schema + ", __bad string", {"columnNameOfCorruptRecord": "__bad"})
    rows = lines.select((F.col("at") + 1).alias("line"), made.alias("x")).select("line", "x.*")
    wrong = rows.where(F.col("__bad").isNotNull()).agg(F.min("line").alias("n"), F.min_by("__bad", "line").alias("said")).first()
    if wrong["n"] is not None:
        raise ValueError(f"no valid JSON in {path} at line {wrong['n']}: {wrong['said'][:200]}")
    return rows.drop("__bad")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON-lines file, missing fields filled."""
    rows = json_lines(spark, path, QUESTION).drop("line")
    empty = F.array().cast("array<string>")
    return rows.withColumns({c: F.coalesce(c, empty) for c in ("expected_keywords", "relevant_doc_ids")} | {c: F.coalesce(c, F.lit("unknown")) for c in ("category", "difficulty", "answer_type")})


def derived_qrels(questions: DataFrame) -> DataFrame:
    return questions.select(F.col("id").alias("query_id"), F.explode("relevant_doc_ids").alias("doc_id"), F.lit(1).alias("relevance")).distinct()


def read_qrels(spark: SparkSession, path: str | None, questions: DataFrame) -> DataFrame:
    """Labels of a JSON-lines file (of pairs that repeat the last counts), else 1 for each relevant document."""
    try:
        lines = json_lines(spark, path, "query_id string, doc_id string, relevance int") if path else None
    except FileNotFoundError:
        lines = None
    if lines is None:
        return derived_qrels(questions)
    return lines.groupBy("query_id", "doc_id").agg(F.max_by(F.coalesce("relevance", F.lit(1)), "line").alias("relevance"))
