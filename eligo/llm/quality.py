"""Quality rules: robust multivariate outliers per language and source.

Every document becomes a vector of transformed statistics. Each group of documents (language and source) gets a location
and scatter by minimum covariance determinant: from two starts, steps that re-estimate both from the three quarters of the
group nearest by Mahalanobis distance, and the start with the smaller determinant wins. Documents beyond a quantile of the
chi-squared distribution are rejected.

Only DataFrame operations: statistics are expressions over one row, moments are sums that combine before the shuffle, the
cut of a group is found from counts on a logarithmic grid of distances. Estimates, one row per group and start, are written
and counted, and up to SMALL rows of them go to the tasks, so that documents do not move for them; more are joined by key,
where adaptive execution splits hot groups.

A source with fewer than MIN_GROUP rows that pass the base rules is judged by the pool of its language's small sources, and
if that is too small as well, by all passing rows of the table. SCALES are part of every scatter, so that an estimate exists
for any number of rows, a single one included; the scatter of all rows counts WIDE as MIN_GROUP rows more, so that a handful
of rows, which cannot tell what is usual, is judged by what is usual for texts.

Null or empty text has no words and fails the base rules, as does every text under 20 words. Null languages and sources
are groups like others. Repeated rows are judged, and weigh, one by one. An empty table gives an empty table. Further
columns of the input are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligo.llm.common import free_names
from eligo.session import cut_lineage

c = F.col

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
MIN_GROUP = 50  # rows; smaller sources are pooled within their language, and then with all
SMALL = 100_000  # rows of under 200 bytes that are broadcast
ALL = '{"by":"all"}'
COVERAGE = 0.75
QUANTILE = 0.9999
STEPS = 6
GRID = 32  # cells to a doubling of the squared distance
# Spread a statistic has at least, so that a group where nearly all documents have the same value does not reject the rest.
SCALES = {"x_word": 0.05, "x_symbols": 0.5, "x_lines": 0.08, "x_repeat": 0.05}
WIDE = {"x_word": 0.4, "x_symbols": 2.0, "x_lines": 0.3, "x_repeat": 0.15}  # spread over texts of all kinds
DIMS = tuple(SCALES)
P = len(DIMS)


def text_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of every whole text."""
    d = docs.select(*keep, F.coalesce(c("text"), F.lit("")).alias("_t"))
    d = d.select(
        *keep, "_t", F.array_remove(F.split("_t", r"[\x20\x09-\x0D]+", -1), "").alias("_w"),
        F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    d = d.select(
        *keep, F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.octet_length("_t") - F.octet_length(F.regexp_replace("_t", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_w") > WINDOW, F.transform("_w", lambda x: F.xxhash64(x))).alias("_h"))
    for step in (1, 2, 4):  # hashes of 2, 4 and then 8 words, from halves
        d = d.withColumn("_h", F.zip_with(
            F.slice("_h", 1, F.size("_h") - step), F.slice("_h", step + 1, F.size("_h") - step),
            lambda a, b: F.xxhash64(a, b)))
    # words inside windows whose hash occurs twice: sort the windows, keep equal neighbours, add up without overlaps;
    # each step is a column of its own, since an expression used twice inside another would run twice
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    d = d.withColumn("_h", F.when(again, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    d = d.withColumn("_h", F.filter(_neighbours(
        "_h", lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull()))
    d = d.withColumn("_h", F.sort_array(F.array_distinct(F.flatten("_h"))))
    return d.withColumn("n_repeat_words", F.coalesce(F.aggregate(
        _neighbours("_h", lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(WINDOW), lambda s, x: s + x),
        F.lit(0)).cast("long")).drop("_h")


def _neighbours(name: str, fn) -> Column:
    n = F.size(name) - 1
    return F.zip_with(F.slice(name, 1, n), F.slice(name, 2, n), fn)


def features(stats: DataFrame) -> DataFrame:
    """Adds base_failed and the transformed statistics; added counts keep short texts from looking extreme."""
    return stats.withColumns({
        "base_failed": (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words")),
        "x_word": F.log((c("word_chars") + 250.0) / (c("n_words") + 50.0)),
        "x_symbols": F.log1p(1000.0 * c("n_symbols") / (c("word_chars") + 250.0)),
        "x_lines": c("n_dup_lines") / (c("n_lines") + 4.0),
        "x_repeat": c("n_repeat_words") / (c("n_words") + 50.0),
    })


def _to_tasks(small: DataFrame) -> DataFrame:
    """A written table for the small side of a join, broadcast if its rows are few."""
    return F.broadcast(small) if small.limit(SMALL + 1).count() <= SMALL else small


def grouped(stats: DataFrame) -> DataFrame:
    """Adds ``grp``: language and source, or the pool of a language's smaller sources, or all."""
    sizes = stats.filter(~c("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("n"))
    sizes = cut_lineage(sizes, "quality-sizes")
    large = c("n") >= MIN_GROUP
    own = _to_tasks(cut_lineage(sizes.filter(large).select(c("lang").alias("_l"), c("source").alias("_s"), F.lit(True).alias("_own")), "quality-own"))
    pools = sizes.filter(~large).groupBy("lang").agg(F.sum("n").alias("n")).filter(large).select(c("lang").alias("_pl"), F.lit(True).alias("_pool"))
    pools = _to_tasks(cut_lineage(pools, "quality-pools"))
    return (stats.join(own, c("lang").eqNullSafe(c("_l")) & c("source").eqNullSafe(c("_s")), "left")
            .join(pools, c("lang").eqNullSafe(c("_pl")), "left")
            .withColumn("grp", F.when(c("_own"), F.to_json(F.struct(F.lit("source").alias("by"), "lang", "source")))
                        .when(c("_pool"), F.to_json(F.struct(F.lit("lang").alias("by"), "lang"))).otherwise(F.lit(ALL)))
            .drop("_l", "_s", "_own", "_pl", "_pool"))


def _pairs():
    return [(i, j) for i in range(P) for j in range(i + 1)]


def _moments() -> list[Column]:
    return [F.expr(x) for x in (
        "count(*) as n", *(f"sum({x}) as s{i}" for i, x in enumerate(DIMS)),
        *(f"sum({DIMS[i]} * {DIMS[j]}) as q{i}{j}" for i, j in _pairs()))]


def _estimates(moments: DataFrame) -> DataFrame:
    """Location m, Cholesky factor l of the scatter, and half the log determinant, from sums; one row per group."""
    scale = consistency(COVERAGE, P)
    e = moments.selectExpr("*", *(f"s{i} / n as m{i}" for i in range(P)), f"if(grp = '{ALL}', {MIN_GROUP}d, 0d) as w")
    for i, j in _pairs():
        wide = WIDE[DIMS[i]] ** 2 if i == j else 0.0
        cov, less = f"((q{i}{j} - n * m{i} * m{j}) * {scale}d + w * {wide}d) / (n + w)", "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        # the added spread keeps the root's argument positive; rounding may not
        e = e.selectExpr("*", f"sqrt(greatest(greatest({cov}, 0d) + {SCALES[DIMS[i]] ** 2}d{less}, 1e-8d)) as l{i}{i}"
                         if i == j else f"({cov}{less}) / l{j}{j} as l{i}{j}")
    keys = [k for k in ("grp", "start") if k in moments.columns]
    return e.selectExpr(*keys, *(f"m{i}" for i in range(P)), *(f"l{i}{j}" for i, j in _pairs()),
                        " + ".join(f"ln(l{i}{i})" for i in range(P)) + " as logdet")


def _with_distance(rows: DataFrame) -> DataFrame:
    """Adds the squared distance d2 by forward substitution."""
    kept = rows.columns
    for i, x in enumerate(DIMS):
        rows = rows.selectExpr("*", f"({x} - m{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(i)) + f") / l{i}{i} as y{i}")
    return rows.selectExpr(*(f"`{k}`" for k in kept), " + ".join(f"y{i} * y{i}" for i in range(P)) + " as d2")


def _step(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Estimates from the COVERAGE part of each group that is nearest by the given ones, to the end of a grid cell."""
    from pyspark.sql import Window

    cell = F.floor(GRID * F.log2(F.greatest(c("d2"), F.lit(2.0 ** -20))))
    cells = (_with_distance(rows.join(_to_tasks(estimates), "grp")).withColumn("cell", F.least(cell, F.lit(40 * GRID)))
             .groupBy("grp", "start", "cell").agg(*_moments()))
    by = Window.partitionBy("grp", "start")
    before = F.sum("n").over(by.orderBy("cell")) - c("n")
    near = cells.withColumns({"before": before, "all": F.sum("n").over(by)}).filter(
        c("before") < COVERAGE * c("all")).drop("before", "all", "cell")
    sums = [x for x in near.columns if x not in ("grp", "start")]
    return _estimates(near.groupBy("grp", "start").agg(*(F.sum(x).alias(x) for x in sums)))


def _starts(rows: DataFrame) -> DataFrame:
    """Start 0: all rows of the group. Start 1: medians, and spreads from the medians of distances to them."""
    classical = _estimates(rows.groupBy("grp").agg(*_moments())).withColumn("start", F.lit(0))
    middle = cut_lineage(rows.groupBy("grp").agg(
        *(F.percentile_approx(x, 0.5, 1000).alias(f"m{i}") for i, x in enumerate(DIMS))), "quality-medians")
    spread = rows.join(_to_tasks(middle), "grp").groupBy("grp").agg(
        *(F.first(f"m{i}").alias(f"m{i}") for i in range(P)),
        *(F.percentile_approx(F.abs(c(x) - c(f"m{i}")), 0.5, 1000).alias(f"d{i}") for i, x in enumerate(DIMS)))
    factors = {f"l{i}{j}": F.sqrt((1.4826 * c(f"d{i}")) ** 2 + SCALES[DIMS[i]] ** 2) if i == j else F.lit(0.0)
               for i, j in _pairs()}
    centred = spread.withColumns(factors | {"start": F.lit(1), "logdet": F.lit(0.0)})
    return classical.unionByName(centred.select(*classical.columns))


def estimate(rows: DataFrame) -> DataFrame:
    """One row per ``grp``: location and factor of the scatter with the least determinant found.

    ``rows`` has grp and the transformed statistics, and should be a written table: every step reads it again. Each
    step's estimates, one row per group and start, are written too, so that no step repeats the ones before.
    """
    e = cut_lineage(_starts(rows), "quality-estimates")
    for _ in range(STEPS):
        e = cut_lineage(_step(rows, e), "quality-estimates")
    best = F.min_by(F.struct(*e.columns), F.struct("logdet", "start"))
    return e.groupBy("grp").agg(best.alias("b")).select("b.*").drop("start", "logdet")


def quality(docs: DataFrame, *keep: str) -> DataFrame:
    """A row per document: ``keep`` (doc_id, lang, source at least), statistics, base_failed, d2 and kept."""
    keep = tuple(dict.fromkeys(("doc_id", "lang", "source", *keep)))
    rows = cut_lineage(grouped(cut_lineage(features(text_statistics(docs, *keep)), "quality-statistics")), "quality-groups")
    passing = rows.filter(~c("base_failed")).select("grp", *DIMS)
    if not passing.filter(c("grp") == ALL).isEmpty():  # these are judged by all passing rows
        passing = passing.filter(c("grp") != ALL).unionByName(passing.withColumn("grp", F.lit(ALL)))
    found = _to_tasks(cut_lineage(estimate(passing), "quality-found"))
    judged = _with_distance(rows.join(found, "grp", "left"))
    return judged.withColumn("kept", ~c("base_failed") & F.coalesce(c("d2") <= chi2_quantile(QUANTILE, P), F.lit(True))
                             ).select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                      "base_failed", "kept", "d2")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that quality() keeps, with all their columns.

    Rows equal in id, text, language and source have equal verdicts, so rejected rows are taken out by these.
    """
    names = ("doc_id", "lang", "source", "text_key")
    key, *bad_names = free_names(docs, "_text_key", *(f"_bad_{x}" for x in names))
    keyed = docs.select("doc_id", "lang", "source", "text", F.xxhash64("text").alias("text_key"))
    bad = quality(keyed, "text_key").filter(~c("kept")).select(*(c(x).alias(y) for x, y in zip(names, bad_names))).distinct()
    same = [c(x).eqNullSafe(c(y)) for x, y in zip(("doc_id", "lang", "source", key), bad_names)]
    return docs.withColumn(key, F.xxhash64("text")).join(
        bad.hint("shuffle_hash"), same[0] & same[1] & same[2] & same[3], "left_anti").drop(key)


def _chi2_cdf(x: float, p: int) -> float:
    """For even p."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))


def chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, p) < q else (low, mid)
    return high


def consistency(coverage: float, p: int) -> float:
    """What the scatter of the nearest part is multiplied by so that it fits normal data."""
    return coverage / _chi2_cdf(chi2_quantile(coverage, p), p + 2)
