"""Quality rules: text statistics and robust multivariate outliers.

Per language and source a regularised minimum-covariance-determinant estimate
is fitted to transformed statistics of all documents; documents at a large
Mahalanobis distance from it are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reportloom.llm.common import BLANKS, private
from reportloom.session import materialize

# Transformed statistics: name, SQL over the columns of text_statistics, least standard deviation.
FEATURES = (
    ("f_length", "ln(1 + word_chars / greatest(n_words, 1))", 0.06),
    ("f_symbols", "sqrt(n_symbols / greatest(n_words, 1))", 0.10),
    ("f_lines", "sqrt(n_dup_lines / greatest(n_lines, 1))", 0.12),
    ("f_repeats", "sqrt(n_repeat_words / greatest(n_words, 1))", 0.08),
    ("f_capitals", "sqrt(n_capitals / greatest(word_chars, 1))", 0.05),
)
P = len(FEATURES)
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


def text_statistics(text: Column) -> dict[str, list[tuple[str, Column]]]:
    """Steps of columns; each step may use the columns of the one before it.

    Every step is linear in the text: repeated windows are found by sorting
    their hashes together with their places, not by comparing them with each other.
    """
    whole = F.coalesce(text, F.lit(""))
    words, n = F.col("_words"), F.col("n_words").cast("int")
    place = F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(*(F.element_at(words, i + k) for k in range(5))))
    windows, ordered, starts = F.col("_windows"), F.col("_ordered"), F.col("_starts")
    none = F.array().cast("array<int>")
    # Neighbours with one hash in the sorted list are repeats of each other.
    twins = F.zip_with(
        F.slice(ordered, F.lit(1), F.size(ordered) - 1), F.slice(ordered, F.lit(2), F.size(ordered) - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["at"], b["at"])),
    )
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.element_at(starts, -1) + 5))
    covered = F.aggregate(
        F.zip_with(starts, ends, lambda a, b: F.least(b - a, F.lit(5))), F.lit(0), lambda total, x: total + x
    )
    lines = F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(f"[^{BLANKS}]"))
    return {
        "words": [("_words", F.array_remove(F.split(whole, f"[{BLANKS}]+", -1), "")), ("_lines", lines)],
        "counts": [
            ("n_words", F.size(words).cast("long")),
            ("word_chars", F.length(F.array_join(words, "")).cast("long")),
            ("n_symbols", F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long")),
            ("n_capitals", F.regexp_count(whole, F.lit(r"\p{Lu}")).cast("long")),
            ("n_lines", F.size("_lines").cast("long")),
            ("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")),
        ],
        "windows": [("_windows", F.when(n >= 5, place).otherwise(F.array().cast("array<bigint>")))],
        "ordered": [(
            "_ordered",
            F.when(
                F.size(F.array_distinct(windows)) < F.size(windows),
                F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at")))),
            ),
        )],
        "starts": [("_starts", F.when(ordered.isNotNull(), F.array_sort(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))).otherwise(none))],
        "repeats": [("n_repeat_words", F.when(F.size(starts) > 0, covered).otherwise(0).cast("long"))],
    }


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds STATISTICS, the features and ``base_failed``."""
    for step in text_statistics(F.col(text)).values():
        df = df.withColumns(dict(step))
    df = df.drop("_words", "_lines", "_windows", "_ordered", "_starts")
    df = df.withColumns({name: F.expr(sql).cast("double") for name, sql, _ in FEATURES})
    return df.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


def _prior(stats: DataFrame) -> tuple[list[float], list[float]]:
    """Median and robust variance of every feature over all documents."""
    row = stats.agg(*(F.percentile_approx(name, [0.25, 0.5, 0.75], 2000).alias(name) for name, _, _ in FEATURES)).first()
    centre, spread = [], []
    for name, _, least in FEATURES:
        low, middle, high = row[name] or (0.0, 0.0, 0.0)
        centre.append(float(middle))
        spread.append(max(least, (high - low) / 1.349) ** 2)
    return centre, spread


def _factored(params: DataFrame) -> DataFrame:
    """Adds the inverse Cholesky factor (i_ab) and the log determinant of the covariance (c_ab)."""
    for a in range(P):
        for b in range(a + 1):
            rest = F.col(f"c_{a}{b}")
            for k in range(b):
                rest = rest - F.col(f"l_{a}{k}") * F.col(f"l_{b}{k}")
            params = params.withColumn(f"l_{a}{b}", F.sqrt(rest) if a == b else rest / F.col(f"l_{b}{b}"))
    for a in range(P):
        for b in range(a, -1, -1):
            if a == b:
                entry = 1 / F.col(f"l_{a}{a}")
            else:
                total = F.lit(0.0)
                for k in range(b, a):
                    total = total + F.col(f"l_{a}{k}") * F.col(f"i_{k}{b}")
                entry = -total / F.col(f"l_{a}{a}")
            params = params.withColumn(f"i_{a}{b}", entry)
    log_det = F.lit(0.0)
    for a in range(P):
        log_det = log_det + 2 * F.log(F.col(f"l_{a}{a}"))
    keep = [c for c in params.columns if not c.startswith(("c_", "l_"))]
    return params.select(*keep, log_det.alias("log_det"))


def _distance() -> Column:
    total = F.lit(0.0)
    for a in range(P):
        part = F.lit(0.0)
        for b in range(a + 1):
            part = part + F.col(f"i_{a}{b}") * (F.col(FEATURES[b][0]) - F.col(f"m_{b}"))
        total = total + part * part
    return total


def _estimate(rows: DataFrame, prior, pseudo: float, consistency: float) -> DataFrame:
    """Mean and covariance of the rows with ``inside``, per group and start, drawn to the prior as far as rows lack."""
    centre, spread = prior
    names = [name for name, _, _ in FEATURES]
    inside = [F.when(F.col("inside"), F.col(n)) for n in names]
    sums = [F.count(F.when(F.col("inside"), 1)).alias("n_in")]
    sums += [F.sum(x).alias(f"s_{a}") for a, x in enumerate(inside)]
    # Deviations from the prior centre keep the products small.
    off = [x - F.lit(c) for x, c in zip(inside, centre)]
    sums += [F.sum(off[a] * off[b]).alias(f"q_{a}{b}") for a in range(P) for b in range(a + 1)]
    got = rows.groupBy("grp", "start").agg(*sums).fillna(0.0)
    n = F.col("n_in")
    size = F.greatest(n, F.lit(1))
    means = {a: (F.col(f"s_{a}") + pseudo * centre[a]) / (n + pseudo) for a in range(P)}
    out = [F.col("grp"), F.col("start"), n, *(means[a].alias(f"m_{a}") for a in range(P))]
    for a in range(P):
        for b in range(a + 1):
            shift = (F.col(f"s_{a}") / size - centre[a]) * (F.col(f"s_{b}") / size - centre[b])
            scatter = F.when(n > 0, F.col(f"q_{a}{b}") - n * shift).otherwise(0.0)
            own = pseudo * spread[a] if a == b else 0.0
            value = (scatter * consistency + own) / (n + pseudo)
            if a == b:
                value = F.greatest(value, F.lit(0.0)) + FEATURES[a][2] ** 2
            out.append(value.alias(f"c_{a}{b}"))
    return _factored(got.select(*out))


def robust_estimates(
    stats: DataFrame, share: float = 0.75, steps: int = 3, pseudo: float = 30.0, consistency: float = 1.41
) -> DataFrame:
    """Minimum-covariance-determinant estimate per ``grp``.

    Two deterministic starts (median with quartile spread, and median with the
    spread of the inner half of the rows) are improved by concentration steps: estimate from the
    ``share`` of rows nearest to the last estimate. The start with the smaller
    determinant wins. ``consistency`` undoes the shrinking of a covariance
    taken from the nearest ``share`` in five dimensions.
    """
    names = [name for name, _, _ in FEATURES]
    prior = _prior(stats)
    rows = stats.filter(~F.col("base_failed")).select("grp", *names)
    quartiles = rows.groupBy("grp").agg(*(F.percentile_approx(n, [0.25, 0.5, 0.75], 2000).alias(f"p_{n}") for n in names))
    wide, inner = F.lit(0.0), F.lit(0.0)
    for name, _, least in FEATURES:
        low, middle, high = (F.col(f"p_{name}")[k] for k in range(3))
        z = F.abs(F.col(name) - middle) / F.greatest((high - low) / 1.349, F.lit(least))
        wide, inner = wide + z * z, F.greatest(inner, z)
    first = rows.join(quartiles, "grp").select("grp", *names, F.inline(F.array(
        F.struct(F.lit(0).alias("start"), wide.alias("d2")), F.struct(F.lit(1).alias("start"), inner.alias("d2"))
    )))
    first = materialize(first, "mcd-starts")
    params = None
    for step in range(steps + 1):
        if params is None:
            measured, part = first, 0.5
        else:
            measured, part = first.drop("d2").join(params, ["grp", "start"]).withColumn("d2", _distance()), share
        measured = measured.select("grp", "start", *names, "d2")
        cut = measured.groupBy("grp", "start").agg(F.percentile_approx("d2", part, 2000).alias("cut"))
        near = measured.join(cut, ["grp", "start"]).withColumn("inside", F.col("d2") <= F.col("cut"))
        params = materialize(_estimate(near, prior, pseudo, consistency), "mcd-params")
    best = params.groupBy("grp").agg(F.min_by("start", F.struct("log_det", "start")).alias("start"))
    return params.join(best, ["grp", "start"]).drop("start")


def group_key(lang: Column, source: Column) -> Column:
    """One value per language and source, absent ones included."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("none"))
    return F.concat_ws("\t", part(lang), part(source))


def quality_rules(documents: DataFrame, limit: float = 50.0, share: float = 0.75, steps: int = 3) -> DataFrame:
    """doc_id, text statistics, ``base_failed``, squared robust distance and ``kept`` of every document.

    A document is kept if the base rules pass and its squared Mahalanobis
    distance from the estimate of its language and source is at most ``limit``.
    No text counts as an empty one, which the base rules reject; without
    language or source, documents form a group of their own. Small or constant
    groups are drawn to the figures of all documents. Repeated rows are judged
    alike, and an empty table gives an empty result.
    """
    stats = with_statistics(documents.select("doc_id", "text", group_key(F.col("lang"), F.col("source")).alias("grp"))).drop("text")
    stats = materialize(stats, "text-statistics")
    params = robust_estimates(stats, share, steps)
    return _judged(stats, params, limit).select("doc_id", *STATISTICS, "base_failed", "distance2", "kept")


def _judged(stats: DataFrame, params: DataFrame, limit: float) -> DataFrame:
    judged = stats.join(params, "grp", "left").withColumn("distance2", F.coalesce(_distance(), F.lit(0.0)))
    # One condition over both sides of the join: a part of it, pushed down on its own, would
    # repeat the steps of the statistics inside each other.
    return judged.withColumn("kept", F.when(F.col("distance2") <= limit, ~F.col("base_failed")).otherwise(False))


def keep_good(documents: DataFrame, limit: float = 50.0) -> DataFrame:
    """The documents that the rules keep, with their own columns.

    The statistics are computed in the pass that filters as well, so texts
    never move; only the estimates, a few numbers per language and source, do.
    """
    narrow = documents.select("text", group_key(F.col("lang"), F.col("source")).alias("grp"))
    stats = materialize(with_statistics(narrow).drop("text"), "text-statistics")
    params = robust_estimates(stats)
    whole, columns = private(documents, "_row"), documents.columns
    packed = documents.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias(whole))
    packed = packed.withColumns({"_text": F.col(whole)["text"], "grp": group_key(F.col(whole)["lang"], F.col(whole)["source"])})
    judged = _judged(with_statistics(packed, "_text"), params, limit)
    return judged.filter("kept").select(f"{whole}.*")
