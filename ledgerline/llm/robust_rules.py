"""Quality rules: fixed floors, then robust multivariate outliers per language and source.

Native: DataFrame expressions only. Every text becomes a few counts; a transformed
vector of them is compared with a minimum-covariance-determinant (MCD) estimate of
its (language, source) group, and is rejected when its Mahalanobis distance is far
beyond what the core of the group shows.

The estimate takes concentration steps: mean and covariance of the ``CORE`` share of
rows with the smallest distances, distances anew, and so on until the determinant stops
falling, from a few starts, of which the smallest determinant wins. The share is cut at
a bin of a fixed logarithmic histogram, so each step is one small aggregate with partial
sums and no row of a group has to meet another one.

Defined results: a null text has no words; null languages and sources are groups of
their own; a group under ``MIN_ROWS`` rows is judged by an estimate over all rows of its
language, and where these are fewer than that, over all rows of the table, however few:
the smallest spread of each feature keeps that from rejecting on a trifle; repeated rows are judged alike and
all stay; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.session import stage

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARACTERS = " \t\n\x0b\x0c\r"
NOT_SYMBOLS = r"[^#*$%&|<>]+"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Half of the rows, the share that stands the most junk.
CORE = 0.5
#: A step that lowers the logarithm of the determinant by less is the last one.
LEAST_GAIN = 1e-3
MIN_ROWS = 200
BINS_PER_DOUBLING = 8
#: Quantiles of the chi-squared distribution with five degrees of freedom, fixed
#: values: the median, and the far end at one in a hundred million.
CHI2_MEDIAN = 4.351
CHI2_FAR = 46.0

#: Feature and the smallest standard deviation it is given, so that a feature that
#: hardly varies in the core (a ratio that is mostly zero) cannot reject on a trifle:
#: a line said twice in a short text is none.
FEATURES = {
    "q_f_length": 0.05,
    "q_f_symbols": 0.12,
    "q_f_upper": 0.20,
    "q_f_repeats": 0.45,
    "q_f_lines": 0.50,
}
NAMES = list(FEATURES)
PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``q_words``, ``q_word_chars``, ``q_symbols``, ``q_dup_lines``,
    ``q_repeat_words``, ``q_n_lines`` and ``q_upper`` (long).

    Windows of three words are told apart by a 64-bit hash within their own text: for
    20,000 words two different ones agree with a chance of about one in 10^11."""
    whole = F.coalesce(F.col(text), F.lit(""))
    windows = F.when(
        F.size("q_list") >= 3,
        F.transform(
            F.expr("slice(q_list, 1, size(q_list) - 2)"),
            lambda w, i: F.xxhash64(w, F.get("q_list", i + 1), F.get("q_list", i + 2))),
    )
    # Equal windows are neighbours once sorted.
    sorted_windows = F.when(
        F.size(F.array_distinct("q_windows")) < F.size("q_windows"),
        F.sort_array(F.transform("q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    repeated = F.filter(
        "q_sorted",
        lambda x, i: (F.coalesce(F.get("q_sorted", i - 1)["h"] == x["h"], F.lit(False))
                      | F.coalesce(F.get("q_sorted", i + 1)["h"] == x["h"], F.lit(False))),
    )
    covered = F.array_distinct(F.flatten(F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    lines = F.filter(F.split(whole, "\n"), lambda line: F.length(F.btrim(line, F.lit(SPACE_CHARACTERS))) > 0)
    return (
        docs.withColumns({"q_list": F.array_remove(F.split(whole, SPACE), ""), "q_lines": lines})
        .withColumn("q_windows", windows)
        .withColumn("q_sorted", sorted_windows)
        .withColumns({
            "q_words": F.size("q_list").cast("long"),
            "q_word_chars": F.length(F.array_join("q_list", "")).cast("long"),
            "q_symbols": F.length(F.regexp_replace(whole, NOT_SYMBOLS, "")).cast("long"),
            "q_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
            "q_repeat_words": F.coalesce(F.size(covered), F.lit(0)).cast("long"),
            "q_n_lines": F.size("q_lines").cast("long"),
            "q_upper": F.length(F.regexp_replace(whole, r"[^\p{Lu}]+", "")).cast("long"),
        })
        .drop("q_list", "q_windows", "q_sorted", "q_lines")
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _bent(ratio: Column) -> Column:
    return F.log1p(20.0 * ratio)


def with_features(counts: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    chars = F.col("q_word_chars")
    return counts.withColumns({
        # Null and empty are kept apart.
        "q_lang": F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit("-")),
        "q_source": F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("-")),
        "q_failed": (F.col("q_words") < MIN_WORDS)
        | (100 * F.col("q_repeat_words") > MAX_REPEAT_PERCENT * F.col("q_words")),
        "q_f_length": F.log(F.greatest(_ratio(chars, F.col("q_words")), F.lit(1.0))),
        "q_f_symbols": _bent(_ratio(F.col("q_symbols"), chars)),
        "q_f_upper": _bent(_ratio(F.col("q_upper"), chars)),
        "q_f_repeats": _bent(_ratio(F.col("q_repeat_words"), F.col("q_words"))),
        "q_f_lines": _bent(_ratio(F.col("q_dup_lines"), F.col("q_n_lines"))),
    })


def _names() -> list[Column]:
    """The own group of a row, that of its language and that of all rows."""
    return [F.concat_ws("\x1f", "q_lang", "q_source"), F.concat_ws("\x1f", F.col("q_lang"), F.lit("*")), F.lit("*")]


def _groups(features: DataFrame) -> DataFrame:
    """``(q_lang, q_source, q_group)``: the estimate that judges a source. A small source
    is judged by all rows of its language, in a small language by all rows of the table."""
    counts = features.groupBy("q_lang", "q_source").agg(F.count(F.lit(1)).alias("n"))
    langs = counts.groupBy("q_lang").agg(F.sum("n").alias("lang_rows"))
    own, lang, whole = _names()
    group = F.when(F.col("n") >= MIN_ROWS, own).when(F.col("lang_rows") >= MIN_ROWS, lang).otherwise(whole)
    return counts.join(langs, "q_lang").select("q_lang", "q_source", group.alias("q_group"))


def _members(groups: DataFrame) -> DataFrame:
    """``(q_lang, q_source, q_group)``: the estimates that a source takes part in, three at
    most, of those that judge a source."""
    every = groups.select("q_lang", "q_source", F.explode(F.array(*_names())).alias("q_group"))
    return every.join(groups.select("q_group").distinct(), "q_group", "left_semi")


def _factors(moments: DataFrame, scale: Column | float = 1.0) -> DataFrame:
    """Cholesky factor ``l_i_j`` of each group's covariance, floors added, and the
    logarithm of its determinant."""
    out = moments
    for i, name in enumerate(NAMES):
        for j in range(i + 1):
            value = F.col(f"c_{i}_{j}") * scale
            if i == j:
                value = value + FEATURES[name] ** 2
            value = reduce(lambda v, k: v - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}"), range(j), value)
            value = F.sqrt(F.greatest(value, F.lit(1e-9))) if i == j else value / F.col(f"l_{j}_{j}")
            out = out.withColumn(f"l_{i}_{j}", value)
    return out.withColumn("m_logdet", sum((F.log(f"l_{i}_{i}") for i in range(1, len(NAMES))), F.log("l_0_0")) * 2)


def _distance(rows: DataFrame) -> DataFrame:
    """``rows`` joined with their factors, with the squared distance ``q_d2``."""
    for i, name in enumerate(NAMES):
        gap = F.col(name) - F.col(f"m_{i}")
        gap = reduce(lambda v, k: v - F.col(f"l_{i}_{k}") * F.col(f"z_{k}"), range(i), gap)
        rows = rows.withColumn(f"z_{i}", gap / F.col(f"l_{i}_{i}"))
    return rows.withColumn("q_d2", sum((F.col(f"z_{i}") ** 2 for i in range(1, len(NAMES))), F.col("z_0") ** 2)) \
        .drop(*[f"z_{i}" for i in range(len(NAMES))])


def _bin(distance: Column) -> Column:
    return F.floor(F.log2(distance + 1e-6) * BINS_PER_DOUBLING).cast("int")


def _upto(bins: DataFrame, *by: str) -> DataFrame:
    """``bins`` with the rows up to each bin, ``q_upto``, and of all, ``q_all``.

    A group has a few hundred bins at most, whatever its rows."""
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return bins.withColumns({"q_upto": F.sum("n").over(upto), "q_all": F.sum("n").over(whole)})


def _starts(rows: DataFrame) -> DataFrame:
    """A few starts per group, features uncorrelated: centre and spread of the middle
    half of each feature, of its shortest half, and of its lowest half."""
    grid = [k / 40 for k in range(41)]
    points = rows.groupBy("q_group").agg(
        *[F.percentile_approx(name, grid, 1000).alias(f"p_{i}") for i, name in enumerate(NAMES)])

    def half(i: int, first: Column) -> Column:
        at = lambda k: F.get(f"p_{i}", first + k)
        return F.struct(at(10).alias("centre"), ((at(20) - at(0)) / 1.349).alias("spread"))

    def shortest(i: int) -> Column:
        widths = F.array(*[F.struct((F.get(f"p_{i}", F.lit(k + 20)) - F.get(f"p_{i}", F.lit(k))).alias("w"),
                                    F.lit(k).alias("k")) for k in range(21)])
        return F.array_min(widths)["k"]

    halves = [[half(i, F.lit(10)), half(i, shortest(i)), half(i, F.lit(0))] for i in range(len(NAMES))]
    each = points.select("q_group", F.posexplode(F.array(*[
        F.struct(*[halves[i][k].alias(f"h_{i}") for i in range(len(NAMES))]) for k in range(3)
    ])).alias("q_start", "h"))
    return each.select(
        "q_group", "q_start",
        *[F.col(f"h.h_{i}.centre").alias(f"m_{i}") for i in range(len(NAMES))],
        *[(F.col(f"h.h_{i}.spread") ** 2 if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in PAIRS])


def _concentrated(rows: DataFrame, model: DataFrame) -> DataFrame:
    """One concentration step: moments of the core under ``model``, and their factors.

    Rows are summed by bin as gaps from the old centre. The bin in which the core ends
    counts in part, so that every core has the same share and determinants compare."""
    measured = _distance(rows.join(model, "q_group"))
    gap = [F.col(name) - F.col(f"m_{i}") for i, name in enumerate(NAMES)]
    key = ["q_group", "q_start"]
    bins = measured.groupBy(*key, _bin(F.col("q_d2")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("m_before").alias("m_before"),
        *[F.min(f"m_{i}").alias(f"m_{i}") for i in range(len(NAMES))],
        *[F.sum(g).alias(f"s_{i}") for i, g in enumerate(gap)],
        *[F.sum(gap[i] * gap[j]).alias(f"s_{i}_{j}") for i, j in PAIRS])
    inside = F.col("q_all") * CORE - (F.col("q_upto") - F.col("n"))
    weighed = _upto(bins, *key).withColumn(
        "w", F.least(F.lit(1.0), inside / F.col("n"))).where("w > 0")
    sums = weighed.groupBy(*key).agg(
        F.sum(F.col("w") * F.col("n")).alias("w"), F.min("m_before").alias("m_before"),
        *[F.min(f"m_{i}").alias(f"o_{i}") for i in range(len(NAMES))],
        *[F.sum(F.col("w") * F.col(f"s_{i}")).alias(f"s_{i}") for i in range(len(NAMES))],
        *[F.sum(F.col("w") * F.col(f"s_{i}_{j}")).alias(f"s_{i}_{j}") for i, j in PAIRS])
    mean = [F.col(f"s_{i}") / F.col("w") for i in range(len(NAMES))]
    return _factors(sums.select(
        *key, "m_before",
        *[(F.col(f"o_{i}") + mean[i]).alias(f"m_{i}") for i in range(len(NAMES))],
        *[(F.col(f"s_{i}_{j}") / F.col("w") - mean[i] * mean[j]).alias(f"c_{i}_{j}") for i, j in PAIRS]))


def _smallest(rows: DataFrame) -> DataFrame:
    """Per group the estimate of the smallest determinant over all starts.

    Steps of a start go on while they lower its determinant. That ends: the floors are
    a lower bound, and a step has to gain ``LEAST_GAIN`` in the logarithm."""
    model = stage(_factors(_starts(rows)).withColumn("m_before", F.lit(None).cast("double")), "mcd-model")
    ended = []
    while True:
        falls = F.col("m_before").isNull() | (F.col("m_logdet") < F.col("m_before") - LEAST_GAIN)
        stepped = stage(_concentrated(rows, model).withColumn("m_falls", falls), "mcd-model")
        ended.append(stepped.where(~F.col("m_falls")))
        if stepped.where("m_falls").isEmpty():
            break
        model = stepped.where("m_falls").withColumn("m_before", F.col("m_logdet"))
    every = reduce(DataFrame.unionByName, ended)
    best = every.groupBy("q_group").agg(
        F.min_by(F.struct(*[c for c in every.columns if c != "q_group"]), F.struct("m_logdet", "q_start")).alias("b"))
    return stage(best.select("q_group", "b.*").drop("q_start", "m_before", "m_falls"), "mcd-best")


def fit(features: DataFrame) -> DataFrame:
    """The estimates as a small stored table: one row per (language, source).

    ``features``: rows of :func:`with_features`, read several times, so pass a staged
    table. Rows that fail the floors do not shape the estimates."""
    usable = features.where(~F.col("q_failed"))
    groups = stage(_groups(usable), "mcd-groups")
    members = stage(_members(groups), "mcd-members")
    rows = stage(usable.join(members, ["q_lang", "q_source"]).select("q_group", *NAMES), "mcd-rows")
    best = _smallest(rows)
    # Scale the core's covariance so that the median distance is that of clean normal rows.
    bins = _distance(rows.join(best, "q_group")).groupBy("q_group", _bin(F.col("q_d2")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    half = _upto(bins, "q_group").where(F.col("q_upto") >= 0.5 * F.col("q_all")).groupBy("q_group").agg(
        F.min("bin").alias("half_bin"))
    scale = F.greatest(F.lit(1.0), F.pow(2.0, (F.col("half_bin") + 1) / BINS_PER_DOUBLING) / CHI2_MEDIAN)
    factors = [f"l_{i}_{j}" for i, j in PAIRS]
    moments = best.drop(*factors).join(stage(half, "mcd-half"), "q_group").withColumn("m_scale", scale)
    final = _factors(moments, F.col("m_scale")).select("q_group", *[f"m_{i}" for i in range(len(NAMES))], *factors)
    return stage(groups.join(final, "q_group"), "mcd-final")


def judged(features: DataFrame, model: DataFrame) -> DataFrame:
    """``features`` with ``q_d2`` (null where no row of the source passes the floors) and ``q_kept``.

    The model has one row per language and source and no broadcast hint: Spark
    compares its stored size with the broadcast threshold."""
    known = model.withColumnRenamed("q_lang", "m_lang").withColumnRenamed("q_source", "m_source")
    rows = features.join(known, (F.col("q_lang") == F.col("m_lang")) & (F.col("q_source") == F.col("m_source")), "left")
    rows = _distance(rows)
    outlier = F.col("q_d2") > CHI2_FAR
    # One comparison of both sides of the join, not a conjunction: as a filter, a conjunct of
    # the left side alone would be pushed to the scan and split the text once more per word.
    faults = F.greatest(F.col("q_failed").cast("int"), F.coalesce(outlier, F.lit(False)).cast("int"))
    return rows.withColumn("q_kept", faults == 0)


def stored_features(docs: DataFrame) -> DataFrame:
    base = docs.select("doc_id", "text", "lang", "source")
    counted = text_counts(base).drop("text")
    return stage(with_features(counted).drop("lang", "source"), "rule-features")


def rule_verdicts(docs: DataFrame) -> DataFrame:
    """One row per document: the counts, ``base_failed`` and ``kept``."""
    features = stored_features(docs)
    return judged(features, fit(features)).select(
        "doc_id",
        F.col("q_words").alias("n_words"),
        F.col("q_word_chars").alias("word_chars"),
        F.col("q_symbols").alias("n_symbols"),
        F.col("q_dup_lines").alias("n_dup_lines"),
        F.col("q_repeat_words").alias("n_repeat_words"),
        F.col("q_failed").alias("base_failed"),
        F.col("q_kept").alias("kept"),
        F.col("q_d2").alias("distance2"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns.

    The counts of a text are made twice, once for the estimates and once for its
    verdict, so that no text has to be shuffled to meet its verdict."""
    model = fit(stored_features(docs))
    own = docs.columns
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("q_row"),
                        "text", "lang", "source")
    rows = judged(with_features(text_counts(boxed)), model).where("q_kept")
    return rows.select(*[F.col("q_row")[c].alias(c) for c in own])
