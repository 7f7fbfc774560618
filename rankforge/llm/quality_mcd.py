"""Quality rules by robust multivariate outliers, DataFrame functions only.

Every text has base statistics. Those that pass the base rules get a vector of transformed statistics; per language and
source a minimum-covariance-determinant estimate gives centre and scatter: four deterministic starts, concentration steps
while they lower the determinant, the least determinant of all. A text whose squared Mahalanobis distance is over a
chi-square quantile is rejected. A group's estimate is shrunk towards its language's by a weight that falls smoothly with
its size, so small groups are judged alike, and the scatter's diagonal has floors (steps and determinants include them).

Vectors are whole numbers (thousandths), so sums are exact and do not depend on the order of rows, and medians are exact
with bounded state (``percentile`` keeps a counter a different value). The nearest share of a group is found from counts of
distances on a logarithmic grid, without a largest value; of texts at the limit's grid step all count. Only sums and
counts are shuffled; a group of a third of all rows is a group like any other.

Defined cases: a null text has no words (all zero, base rule failed); null language or source is a value of its own;
repeated rows are kept; an empty table gives an empty frame; further columns are ignored. Repeated windows are told apart by
64 bits of hash within one text.
"""

from __future__ import annotations

from functools import reduce
from math import exp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.llm.shared import written

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Share of a group that the estimate rests on, quantile beyond which a text is rejected, texts a language's estimate weighs.
SHARE, QUANTILE, PRIOR = 0.75, 0.9999999, 50
#: A start is done once a step lowers its log determinant by no more; grid steps of a distance a unit of its logarithm.
STABLE, FINE = 1e-3, 200
#: Pseudo-words that draw the mean word length of short texts to their group's; thousandths.
PSEUDO, UNIT = 100, 1000
#: Least standard deviation of each coordinate, in thousandths: mean word length (log), symbols, repeated lines,
#: repeated words (roots of shares). Most texts have none of the last three, so their scatter would vanish.
FLOORS = (40, 40, 150, 130)
P = len(FLOORS)
#: Groups up to which their estimates (four starts of some 30 numbers each, and the languages') are broadcast.
FEW = 5_000


def base_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``__n_words, __word_chars, __n_symbols, __n_lines, __n_dup_lines, __n_repeat_words`` in place of the text."""
    rest = [F.col(c) for c in df.columns if c != text_col]
    names = [c for c in df.columns if c != text_col]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(*rest, text.alias("__t"), F.trim(text, F.lit(SPACE)).alias("__trimmed"))
    # a text with a word starts and ends, once trimmed, with one
    words = F.when(F.col("__trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("__trimmed", r"[ \t\n\x0b\f\r]+"))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")
    symbols = F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))
    docs = docs.select(*names, words.alias("__words"), lines.alias("__lines"), symbols.cast("long").alias("__n_symbols"))
    n = F.size("__words")
    windows = F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("__words", i, WINDOW))))
    n_lines = F.size("__lines")
    docs = docs.select(
        *names, n.cast("long").alias("__n_words"), F.length(F.array_join("__words", "")).cast("long").alias("__word_chars"), "__n_symbols",
        n_lines.cast("long").alias("__n_lines"), (n_lines - F.size(F.array_distinct("__lines"))).cast("long").alias("__n_dup_lines"), windows.alias("__w"),
    )
    kept = [*names, "__n_words", "__word_chars", "__n_symbols", "__n_lines", "__n_dup_lines"]
    placed = F.sort_array(F.transform("__w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    docs = docs.select(*kept, F.when(F.size(F.array_distinct("__w")) < F.size("__w"), placed).alias("__s"))
    near = lambda k: F.get(F.col("__s"), k)["h"]
    again = F.filter("__s", lambda x, k: F.coalesce(near(k - 1) == x["h"], F.lit(False)) | F.coalesce(near(k + 1) == x["h"], F.lit(False)))
    docs = docs.select(*kept, F.sort_array(F.transform(again, lambda x: x["i"])).alias("__p"))
    step = F.transform("__p", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__p"), k + 1) - x, F.lit(WINDOW))))
    covered = F.when(F.col("__p").isNull(), F.lit(0)).otherwise(F.aggregate(step, F.lit(0), lambda a, x: a + x))
    return docs.select(*kept, covered.cast("long").alias("__n_repeat_words"))


def chi_square(x: float, dof: int) -> float:
    """The distribution function for an even number of degrees of freedom."""
    term = total = 1.0
    for k in range(1, dof // 2):
        term *= x / 2 / k
        total += term
    return 1 - exp(-x / 2) * total


def chi_square_quantile(q: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dof) < q else (low, mid)
    return high


def _pairs(name: str) -> list[str]:
    return [f"{name}{i}{j}" for i in range(P) for j in range(i + 1)]


X, CENTRE, SCATTER, FACTOR = [f"x{i}" for i in range(P)], [f"m{i}" for i in range(P)], _pairs("c"), _pairs("l")


def _cross(names: list[str], to: str) -> list[Column]:
    """Exact sums of the products of whole-numbered columns."""
    return [F.sum((F.col(names[i]) * F.col(names[j])).cast("decimal(20,0)")).cast("double").alias(f"{to}{i}{j}") for i in range(P) for j in range(i + 1)]


def _moments(docs: DataFrame, keys: list[str], share: float = 1.0) -> DataFrame:
    """Centre and scatter of each group; those of the nearest ``share`` of a group are widened to hold for all of it."""
    m = docs.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), *[F.sum(x).cast("double").alias(f"s{i}") for i, x in enumerate(X)], *_cross(X, "q"))
    mean = {i: F.col(f"s{i}") / F.col("n") for i in range(P)}
    factor = share / chi_square(chi_square_quantile(share, P), P + 2) if share < 1 else 1.0
    scatter = [((F.col(f"q{i}{j}") / F.col("n") - mean[i] * mean[j]) * factor + (FLOORS[i] ** 2 if i == j else 0)).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)]
    return m.select(*keys, *[mean[i].alias(f"m{i}") for i in range(P)], *scatter)


def _factored(m: DataFrame) -> DataFrame:
    """With the Cholesky factor of the scatter and the logarithm of its determinant, ``ld``."""
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            m = m.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"l{j}{j}"))
    return m.withColumn("ld", sum((2 * F.ln(f"l{i}{i}") for i in range(1, P)), 2 * F.ln("l00")))


def _distance() -> Column:
    solved: list[Column] = []
    for i in range(P):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * solved[j]
        solved.append(rest / F.col(f"l{i}{i}"))
    return sum((z * z for z in solved[1:]), solved[0] * solved[0])


def _sent(small: DataFrame, few: bool) -> DataFrame:
    """A frame of some rows a group: broadcast where the groups were counted and are few, so that texts need not meet by group."""
    return F.broadcast(small) if few else small


def _starts(docs: DataFrame, group: list[str], few: bool) -> DataFrame:
    """Four first estimates a group (column ``start``): medians with median deviations; these with the correlations of
    spatial signs; with those of hyperbolic tangents; mean and covariance of all."""
    middle = docs.groupBy(*group).agg(*[F.percentile(x, 0.5).alias(m) for x, m in zip(X, CENTRE, strict=True)])
    away = [F.percentile(F.abs(F.col(x) - F.col(m)).cast("long"), 0.5) for x, m in zip(X, CENTRE, strict=True)]
    scales = [F.greatest(a * 1.4826, F.lit(float(f))).alias(f"a{i}") for i, (a, f) in enumerate(zip(away, FLOORS, strict=True))]
    spread = written(docs.join(_sent(middle, few), group).groupBy(*group, *CENTRE).agg(*scales), "spread")
    z = [(F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"a{i}") for i in range(P)]
    norm = F.greatest(F.sqrt(sum((v * v for v in z[1:]), z[0] * z[0])), F.lit(1e-9))
    bent = docs.join(_sent(spread, few), group).select(
        *group, *X, *[F.round(v / norm * UNIT).cast("long").alias(f"u{i}") for i, v in enumerate(z)], *[F.round(F.tanh(v) * UNIT).cast("long").alias(f"t{i}") for i, v in enumerate(z)]
    )
    turned = bent.groupBy(*group).agg(*_cross([f"u{i}" for i in range(P)], "u"), *_cross([f"t{i}" for i in range(P)], "t"))

    def by_correlation(kind):
        own = lambda i, j: F.col(f"a{i}") * F.col(f"a{j}")
        size = lambda i, j: F.sqrt(F.greatest(F.col(f"{kind}{i}{i}") * F.col(f"{kind}{j}{j}"), F.lit(1.0)))
        return [(own(i, j) if i == j else own(i, j) * F.col(f"{kind}{i}{j}") / size(i, j) if kind else F.lit(0.0)).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)]

    robust = [spread.join(turned, group).select(*group, F.lit(n).alias("start"), *CENTRE, *by_correlation(kind)) for n, kind in enumerate(("", "u", "t"))]
    plain = _moments(docs, group).select(*group, F.lit(3).alias("start"), *CENTRE, *SCATTER)
    return robust[0].union(robust[1]).union(robust[2]).union(plain)


def estimates(docs: DataFrame, group: list[str], few: bool = False) -> DataFrame:
    """Minimum-covariance-determinant centre (``m0..``), scatter (``c00..``), its Cholesky factor (``l00..``) and the
    logarithm of its determinant (``ld``) of ``x0..`` for each group: from each start, the nearest ``SHARE`` of the group
    gives the next estimate while that lowers the start's determinant; the least of all steps counts (of equal ones, the
    earliest start's). Starts that are done are not measured again, and every further step lowers a determinant, so it ends."""
    keys = [*group, "start"]
    columns = [*keys, "ld", *CENTRE, *SCATTER, *FACTOR]
    moving = written(_factored(_starts(docs, group, few)).select(*columns, F.lit(0.0).alias("before")), "scatter")
    steps: list[DataFrame] = []
    while moving.limit(1).count():
        measured = docs.join(_sent(moving.drop("ld", "before"), few), group).select(*keys, *X, F.round(F.log1p(_distance()) * FINE).cast("int").alias("d"))
        counts = measured.groupBy(*keys, "d").agg(F.count("*").alias("n"))
        whole = Window.partitionBy(*keys)
        counts = counts.select(*keys, "d", F.sum("n").over(whole.orderBy("d")).alias("up_to"), F.sum("n").over(whole).alias("all"))
        limit = counts.where(F.col("up_to") >= F.ceil(F.col("all") * SHARE)).groupBy(*keys).agg(F.min("d").alias("limit"))
        near = measured.join(_sent(limit, few), keys).where(F.col("d") <= F.col("limit"))
        # a first estimate does not rest on the nearest share, so its determinant is not compared
        before = F.col("ld") if steps else F.lit(float("inf"))
        after = _factored(_moments(near, keys, SHARE)).join(moving.select(*keys, before.alias("before")), keys)
        after = written(after.select(*columns, "before"), "scatter")
        steps.append(after.select(*columns))
        moving = after.where(F.col("before") - F.col("ld") > STABLE)
    now = reduce(DataFrame.union, steps) if steps else moving.select(*columns)
    least = now.groupBy(*group).agg(F.min(F.struct("ld", "start", *CENTRE, *SCATTER, *FACTOR)).alias("least"))
    return written(least.select(*group, "least.*"), "scatter")


def _shrunk(estimate: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row a language and source: its own estimate with weight n / (n + ``PRIOR``), the language's with the rest."""
    own = estimate.where(~F.col("__whole")).drop("__whole")
    language = estimate.where("__whole").select("__lang", *[F.col(c).alias(f"w{c}") for c in (*CENTRE, *SCATTER)])
    weight = F.col("__n") / (F.col("__n") + PRIOR)
    mixed = sizes.join(own, ["__lang", "__source"]).join(language, "__lang")
    return _factored(mixed.select("__lang", "__source", *[(F.col(c) * weight + F.col(f"w{c}") * (1 - weight)).alias(c) for c in (*CENTRE, *SCATTER)])).select("__lang", "__source", *CENTRE, *FACTOR)


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """A row for every row: identifier, base statistics, ``base_failed``, ``distance`` (squared; null where the base rules
    failed) and ``kept``."""
    src = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("\0")).alias("__lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("\0")).alias("__source"))
    failed = (F.col("__n_words") < 10) | (F.col("__n_repeat_words") * 100 > F.col("__n_words") * 20)
    base = written(base_statistics(src, "__text").withColumn("__failed", failed), "base")
    passed = base.where(~F.col("__failed"))
    sizes = written(passed.groupBy("__lang", "__source").agg(F.count("*").alias("__n"), (F.sum("__word_chars") / F.sum("__n_words")).alias("__mean")), "sizes")
    few = sizes.count() <= FEW
    share = lambda a, b: F.round(F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1))) * UNIT).cast("long")
    length = (F.col("__word_chars") + F.col("__mean") * PSEUDO) / (F.col("__n_words") + PSEUDO)
    vector = [F.round(F.ln(length) * UNIT).cast("long"), share("__n_symbols", "__word_chars"), share("__n_dup_lines", "__n_lines"), share("__n_repeat_words", "__n_words")]
    out = base.join(_sent(sizes.select("__lang", "__source", "__mean"), few), ["__lang", "__source"], "left")
    out = out.select("__id", "__lang", "__source", "__n_words", "__word_chars", "__n_symbols", "__n_dup_lines", "__n_repeat_words", "__failed", *[F.when(~F.col("__failed"), v).alias(f"x{i}") for i, v in enumerate(vector)])
    levels = F.array(F.struct(F.col("__source").alias("__source"), F.lit(False).alias("__whole")), F.struct(F.lit("").alias("__source"), F.lit(True).alias("__whole")))
    docs = out.where(~F.col("__failed")).select("__lang", F.inline(levels), *X)
    estimate = estimates(docs, ["__lang", "__source", "__whole"], few)
    joint = written(_shrunk(estimate, sizes), "scatter")
    measured = out.join(_sent(joint, few), ["__lang", "__source"], "left").withColumn("__d", _distance())
    cut = chi_square_quantile(QUANTILE, P)
    kept = F.when(F.col("__failed"), F.lit(False)).otherwise(F.coalesce(F.col("__d") <= cut, F.lit(True)))
    return measured.select(
        F.col("__id").alias(id_col), F.col("__n_words").alias("n_words"), F.col("__word_chars").alias("word_chars"), F.col("__n_symbols").alias("n_symbols"),
        F.col("__n_dup_lines").alias("n_dup_lines"), F.col("__n_repeat_words").alias("n_repeat_words"), F.col("__failed").alias("base_failed"),
        F.when(~F.col("__failed"), F.round("__d", 6)).alias("distance"), kept.alias("kept"),
    )
