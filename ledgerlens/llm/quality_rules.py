"""Quality rules with a robust multivariate outlier test, in DataFrame operations only.

Per text: counts of words, characters, symbols, repeated lines and repeated three-word windows. Five transformed
statistics, rounded to a grid of 1 / GRID, form a vector. Rows that pass the base rule are aggregated to distinct vectors with
weights, and for every language and source, every language, and all rows a minimum-covariance-determinant estimate is
fitted to them: concentration steps (the CORE share of rows with the smallest Mahalanobis distances gives the next mean and
covariance) from three starts (medians and median deviations; all rows; rows near the medians) until the determinant falls no
more; of the starts the one with the smallest determinant counts. A cell's estimate is then weighted toward that of its
language, and this toward that of all rows, as if the parent were SHRINK rows of the cell, so a small cell needs no rule of
its own. A row whose distance from its cell's estimate exceeds CUTOFF is rejected.

Values on the grid have exact sums, and core shares are taken from counts by distance bin, so verdicts don't depend on how
rows are partitioned. All fitting is grouped aggregation over distinct vectors, so a cell with a third of all rows is summed in parts.

Defined cases: a null text counts as empty and fails the base rule; null language or source is a value like any other; a
very long text is one row like any other; rows that repeat are separate rows, tied distances fall on the same side; no
rows give no rows, and without rows that pass the base rule nothing is fitted. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut, small, stored, table, text_or_empty

SPACES = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
CORE = 0.75
#: A parent's estimate counts as so many rows of the cell.
SHRINK = 100.0
GRID = 64
#: Bins of distances: so many per doubling of 1 + distance.
DISTANCE_BINS = 64
#: Concentration goes on while it lowers the determinant by more than this share.
LEAST_GAIN = 1e-6
#: Makes the core's covariance consistent at a normal sample: 0.75 / P(chi2 with 7 degrees <= its 0.75 point with 5 degrees).
CONSISTENCY = 1.41
#: Chi-square with 5 degrees of freedom exceeds this once in 100,000 rows.
CUTOFF = 30.86
#: Statistics with the least standard deviation that each is granted, as most clean texts share the same value of some.
STATS = {"log_words": 0.4, "log_word_length": 0.12, "symbol_rate": 0.5, "line_repeats": 0.15, "word_repeats": 0.15}


def text_counts(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """The counts of every text; windows are compared by 64-bit hashes of their three words."""
    spaced = F.split("text_in", SPACES)
    line_words = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    base = docs.select(F.col(id_col).alias("doc_id"), *keep, text_or_empty(text_col).alias("text_in"))
    counted = base.select(
        "doc_id",
        *keep,
        F.array_remove(spaced, "").alias("words"),
        F.length(F.regexp_replace("text_in", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text_in") - F.length(F.regexp_replace("text_in", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text_in", "\n"), line_words).alias("lines"),
    )
    hashed = counted.select(
        "doc_id",
        *keep,
        "word_chars",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))).alias("windows"),
    )
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    sorted_windows = hashed.withColumn(
        "sorted", F.when(repeated, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    ).drop("windows")
    twice = sorted_windows.withColumn(
        "starts",
        F.array_sort(
            F.transform(
                F.filter("sorted", lambda s, i: F.coalesce(s["h"] == F.get("sorted", i - 1)["h"], F.lit(False)) | F.coalesce(s["h"] == F.get("sorted", i + 1)["h"], F.lit(False))),
                lambda s: s["i"],
            )
        ),
    ).drop("sorted")
    covered = F.aggregate(F.transform("starts", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("starts", i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return twice.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("starts")


def _vectors(counts: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    grid = lambda c: F.round(c * GRID) / GRID
    return (
        counts.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
        .withColumn("log_words", grid(F.log1p(words)))
        .withColumn("log_word_length", grid(F.log1p(F.col("word_chars") / words)))
        .withColumn("symbol_rate", grid(F.log1p(1000 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)))))
        .withColumn("line_repeats", grid(F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))))
        .withColumn("word_repeats", grid(F.sqrt(F.col("n_repeat_words") / words)))
    )


def _cell(groups: list[str], depth: int) -> Column:
    """The name of a row's cell that its first depth groups make."""
    return F.concat_ws("\u0002", F.lit(str(depth)), *[F.coalesce(F.col(g).cast("string"), F.lit("\u0001")) for g in groups[:depth]])


def _points(vectors: DataFrame, groups: list[str]) -> DataFrame:
    """cell, parent, w and the statistics: distinct vectors of rows that pass the base rule, with weights, in their cell at every level."""
    levels = [F.struct(_cell(groups, d).alias("cell"), (_cell(groups, d - 1) if d else F.lit(None).cast("string")).alias("parent")) for d in range(len(groups) + 1)]
    distinct = vectors.filter(~F.col("base_failed")).groupBy(*groups, *STATS).agg(F.count("*").cast("double").alias("w"))
    return distinct.select(F.explode(F.array(*levels)).alias("at"), "w", *STATS).groupBy("at.cell", "at.parent", *STATS).agg(F.sum("w").alias("w"))


def _moments(rows: DataFrame, keys: tuple[str, ...] = ("cell",)) -> DataFrame:
    """Weight, means and covariances of each cell; sums of values on the grid are exact, in whatever order."""
    names, w = list(STATS), F.col("w") if "w" in rows.columns else F.lit(1.0)
    sums = [F.sum(w * F.col(a)).alias(f"sum_{a}") for a in names] + [F.sum(w * F.col(a) * F.col(b)).alias(f"sum_{a}_{b}") for i, a in enumerate(names) for b in names[: i + 1]]
    mean = lambda a: F.col(f"sum_{a}") / F.col("n")
    covs = [(F.col(f"sum_{a}_{b}") / F.col("n") - mean(a) * mean(b)).alias(f"cov_{a}_{b}") for i, a in enumerate(names) for b in names[: i + 1]]
    return rows.groupBy(*keys).agg(F.sum(w).alias("n"), *sums).select(*keys, "n", *[mean(a).alias(f"mean_{a}") for a in names], *covs)


def _with_factor(params: DataFrame, scale: float, keep: tuple[str, ...] = ("cell",)) -> DataFrame:
    """Cholesky factor of scale * covariance + granted variances, one column an entry, and the logarithm of its determinant."""
    names = list(STATS)
    out = params
    for i, a in enumerate(names):
        for j, b in enumerate(names[: i + 1]):
            rest = F.coalesce(F.col(f"cov_{a}_{b}"), F.lit(0.0)) * scale + (F.lit(STATS[a] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l_{j}_{j}"))
    log_det = sum((F.log(f"l_{i}_{i}") for i in range(1, len(names))), F.log("l_0_0")) * 2
    return out.select(*keep, *[f"mean_{a}" for a in names], *[f"l_{i}_{j}" for i in range(len(names)) for j in range(i + 1)], log_det.alias("log_det"))


def _distance() -> list[Column]:
    """Entries of the standardised difference, by forward substitution; the last column is their squared length."""
    names = list(STATS)
    steps = []
    for i, a in enumerate(names):
        z = F.col(a) - F.col(f"mean_{a}")
        for k in range(i):
            z = z - F.col(f"l_{i}_{k}") * F.col(f"z_{k}")
        steps.append((f"z_{i}", z / F.col(f"l_{i}_{i}")))
    square = sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(1, len(names))), F.col("z_0") * F.col("z_0"))
    return [*steps, ("distance", square)]


def _measured(rows: DataFrame, params: DataFrame, n_params: int, how: str = "inner", keep: tuple[str, ...] = ()) -> DataFrame:
    out = rows.join(small(params, n_params), "cell", how)
    for name, column in _distance():
        out = out.withColumn(name, column)
    return out.select(*rows.columns, *keep, "distance")


def _medians(rows: DataFrame, names: list[str]) -> DataFrame:
    """cell and the weighted lower median of each named column: from counts by value, of which the grid allows few."""
    long = rows.select("cell", "w", F.explode(F.array(*[F.struct(F.lit(a).alias("stat"), F.col(a).alias("v")) for a in names])).alias("x")).groupBy("cell", "x.stat", "x.v").agg(F.sum("w").alias("w"))
    along = Window.partitionBy("cell", "stat")
    placed = long.withColumn("below", F.sum("w").over(along.orderBy("v"))).withColumn("all", F.sum("w").over(along))
    middle = placed.filter(2 * F.col("below") >= F.col("all")).groupBy("cell", "stat").agg(F.min("v").alias("v"))
    return middle.groupBy("cell").agg(*[F.max(F.when(F.col("stat") == a, F.col("v"))).alias(f"mid_{a}") for a in names])


def _starts(points: DataFrame, n_cells: int) -> DataFrame:
    """cell, start and estimates to begin with: medians and their deviations; all rows; rows near the medians in every statistic."""
    names = list(STATS)
    middle = cut(_medians(points, names))
    off = points.join(small(middle, n_cells), "cell").select("cell", "w", *names, *[F.abs(F.col(a) - F.col(f"mid_{a}")).alias(f"off_{a}") for a in names])
    spread = cut(_medians(off.drop(*names).withColumnsRenamed({f"off_{a}": a for a in names}), names).withColumnsRenamed({f"mid_{a}": f"mad_{a}" for a in names}))
    covs = [F.pow(F.col(f"mad_{a}") * 1.4826, F.lit(2)).alias(f"cov_{a}_{b}") if a == b else F.lit(0.0).alias(f"cov_{a}_{b}") for i, a in enumerate(names) for b in names[: i + 1]]
    by_median = middle.join(spread, "cell").select("cell", F.lit(0).alias("start"), *[F.col(f"mid_{a}").alias(f"mean_{a}") for a in names], *covs)
    near = off.join(small(spread, n_cells), "cell")
    for a in names:
        near = near.filter(F.col(f"off_{a}") <= 2 * (1.4826 * F.col(f"mad_{a}") + STATS[a]))
    shape = by_median.columns
    of_all, of_near = (_moments(rows).withColumn("start", F.lit(i)).select(shape) for i, rows in ((1, points), (2, near)))
    return _with_factor(stored(by_median.unionByName(of_all).unionByName(of_near)), 1.0, ("cell", "start"))


def mcd(points: DataFrame) -> DataFrame:
    """cell, n, means and covariances of the core with the smallest determinant, for every cell of points (cell, w, statistics)."""
    # Estimates are stored, not checkpointed: a checkpoint keeps the constraints of the factor's columns, whose inference grows exponentially.
    points = points.select("cell", "w", *STATS)
    n_cells = points.select("cell").distinct().count()
    params, best = stored(_starts(points, n_cells)), None
    bins = F.floor(F.log2(1 + F.col("distance")) * DISTANCE_BINS).cast("int")
    group = ("cell", "start")
    along = Window.partitionBy(*group)
    while True:
        measured = _measured(points, params.select(*[c for c in params.columns if c != "log_det"]), 3 * n_cells, keep=("start",)).withColumn("bin", bins)
        counts = measured.groupBy(*group, "bin").agg(F.sum("w").alias("w"))
        placed = counts.withColumn("below", F.sum("w").over(along.orderBy("bin"))).withColumn("all", F.sum("w").over(along))
        limits = placed.filter(F.col("below") >= CORE * F.col("all")).groupBy(*group).agg(F.min("bin").alias("core_bin"))
        core = measured.join(small(limits, 3 * n_cells), list(group)).filter(F.col("bin") <= F.col("core_bin"))
        found = stored(_moments(core, group))
        step = stored(_with_factor(found, CONSISTENCY, (*group, "n", *[c for c in found.columns if c.startswith("cov_")])))
        if best is None:
            best = moved = step
        else:
            before = best.select(*group, F.col("log_det").alias("before"))
            moved = stored(step.join(before, list(group)).filter(F.col("log_det") < F.col("before") - LEAST_GAIN).drop("before"))
            if moved.isEmpty():
                break
            best = stored(best.join(moved.select(*group), list(group), "left_anti").unionByName(moved))
        params = moved.select(params.columns)
    shape = ["cell", "n", *[c for c in best.columns if c.startswith(("mean_", "cov_"))]]
    chosen = best.groupBy("cell").agg(F.min_by(F.struct(*[c for c in shape if c != "cell"]), F.struct("log_det", "start")).alias("s"))
    return chosen.select("cell", "s.*").select(shape)


def _shrunk(estimates: DataFrame, families: DataFrame, depth: int) -> DataFrame:
    """Estimates of the deepest cells, each weighted toward its parent's; families: cell, parent and the rows n_all of every cell."""
    numbers = [c for c in estimates.columns if c.startswith(("mean_", "cov_"))]
    known = estimates.drop("n").join(families, "cell")
    level = known.filter(F.col("parent").isNull()).drop("parent", "n_all")
    for d in range(1, depth + 1):
        above = level.select(F.col("cell").alias("parent"), *[F.col(c).alias(f"up_{c}") for c in numbers])
        own = known.filter(F.col("cell").startswith(f"{d}\u0002")).join(above, "parent")
        level = own.select("cell", *[((F.col("n_all") * F.col(c) + SHRINK * F.col(f"up_{c}")) / (F.col("n_all") + SHRINK)).alias(c) for c in numbers])
    return level


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source"), keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts, base_failed, distance and kept of every row; columns named in keep come along."""
    carried = list(dict.fromkeys([*groups, *keep]))
    counts = text_counts(docs, id_col, text_col, carried)
    vectors = stored(_vectors(counts))
    points = stored(_points(vectors, list(groups)))
    families = cut(points.groupBy("cell", "parent").agg(F.sum("w").alias("n_all")))
    params = stored(_with_factor(stored(_shrunk(mcd(points), families, len(groups))), CONSISTENCY)).drop("log_det")
    judged = _measured(vectors.withColumn("cell", _cell(list(groups), len(groups))), params, params.count(), "left")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUTOFF))


def op6_mcd_quality_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
