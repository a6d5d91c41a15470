"""Quality rules: counts per text, and multivariate outliers by robust estimates per language and source.

For each group the minimum covariance determinant is sought: the mean and
covariance of the ``share`` of rows whose covariance has the smallest
determinant. Two starts (coordinate medians, classical moments) go through
concentration steps. A step is one aggregation: distances under the present
estimate fall into bins, moments are summed per bin, and the innermost bins
that hold the share give the next estimate. So no group is ever in one place,
and what is joined back is one row for each group.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.words import raw, slices
from tidemark.session import cut_lineage

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
# Spread below which a dimension is not told apart; its square is added to every variance.
LEAST = (0.5, 0.05, 0.05, 0.15, 0.15)
TYPICAL = 5.5  # characters of a word
SIZE = len(LEAST)
PAIRS = [(i, j) for i in range(SIZE) for j in range(i, SIZE)]
BINS = 25  # of squared distance for each factor of e
# Median and 97.5 % point of chi-squared with five degrees of freedom.
CHI_MEDIAN, CHI_975 = 4.351, 12.833
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def text_counts(text: bytes, run: int = 5) -> tuple[int, ...]:
    """``COUNTS`` of one text. Words in windows: every word in some ``run`` of words that the text has twice."""
    words = text.split()
    symbols = sum(map(text.count, [SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))]))
    chars = len(text.decode("utf-8", "replace")) - sum(map(text.count, [BLANKS[i : i + 1] for i in range(len(BLANKS))]))
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
    covered = np.zeros(len(words) + 1, np.int64)
    if len(words) >= run:
        number: dict[bytes, int] = {}
        own = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        # exact names for ever longer runs: a pair of names gets a name
        name, length = own, 1
        while length < run:
            step = min(length, run - length)
            pair = name[: len(name) - step] * (int(name.max()) + 1) + name[step:]
            name, length = np.unique(pair, return_inverse=True)[1], length + step
        again = np.flatnonzero(np.bincount(name)[name] > 1)
        np.add.at(covered, again, 1)
        np.add.at(covered, again + run, -1)
    return len(words), chars, symbols, len(lines) - len(set(lines)), int((np.cumsum(covered)[:-1] > 0).sum()), len(lines)


def _counted(docs: DataFrame, id: str, text: str, group: list[str]) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                columns = zip(*[text_counts(t) for t in raw(part.column("_text"))])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *[pa.array(c, pa.int64()) for c in columns]], [*part.schema.names[:-1], *COUNTS]
                )

    rows = docs.select(F.col(id).alias("_id"), *[F.col(c).cast("string").alias(f"_g{k}") for k, c in enumerate(group)], F.col(text).alias("_text"))
    kinds = [f"{n} {t}" for n, t in rows.dtypes[:-1]] + [f"{c} long" for c in COUNTS]
    return rows.mapInArrow(run, ", ".join(kinds))


def vector() -> list[Column]:
    """Transformed statistics: length, word length, symbols, repeated lines, repeated words.

    Square roots even out the spread of counts. Short texts vary more: their
    word length is drawn towards ``TYPICAL``, and shares are of a little more
    than they have.
    """
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [
        F.log1p("n_words"),
        (F.log(chars / words) - float(np.log(TYPICAL))) * F.sqrt(words / (words + 60)),
        F.sqrt(F.col("n_symbols") / (chars + 50)),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 20)),
        F.sqrt(F.col("n_repeat_words") / (words + 100)),
    ]


def _squared_distance() -> Column:
    x = [F.col(f"x{i}") - F.col("mean")[i] for i in range(SIZE)]
    terms = [x[i] * x[j] * F.col("inverse")[k] * (1 if i == j else 2) for k, (i, j) in enumerate(PAIRS)]
    return sum(terms[1:], terms[0])


def _estimates(moments: DataFrame) -> DataFrame:
    """(group, start, n, mean, inverse, size) from (group, start, n, m0.., m00..); ``size`` is the log of the determinant."""

    def run(batches):
        for batch in batches:
            t = batch.to_pydict()
            n = np.array(t["n"], float)
            mean = np.array([t[f"m{i}"] for i in range(SIZE)], float).T.reshape(-1, SIZE) / n[:, None]
            spread = np.zeros((len(n), SIZE, SIZE))
            for i, j in PAIRS:
                spread[:, i, j] = spread[:, j, i] = np.array(t[f"m{i}{j}"], float) / n - mean[:, i] * mean[:, j]
            spread += np.diag(np.square(LEAST))
            inverse = np.linalg.inv(spread) if len(n) else spread
            sizes = np.linalg.slogdet(spread)[1] if len(n) else n
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("group"), batch.column("start"), batch.column("rows"), pa.array(mean.tolist(), pa.list_(pa.float64())),
                    pa.array([[m[i, j] for i, j in PAIRS] for m in inverse], pa.list_(pa.float64())), pa.array(sizes, pa.float64()),
                ],
                ["group", "start", "rows", "mean", "inverse", "size"],
            )

    return moments.mapInArrow(run, "group string, start int, rows long, mean array<double>, inverse array<double>, size double")


def _sums() -> list[Column]:
    first = [F.sum(f"x{i}").alias(f"m{i}") for i in range(SIZE)]
    return [F.count(F.lit(1)).alias("n"), *first, *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"m{i}{j}") for i, j in PAIRS]]


def _bins(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Moments of each distance bin of each group and start, with the rows in it and before it."""
    far = rows.join(estimates.select("group", "start", "mean", "inverse"), "group")
    far = far.withColumn("bin", F.floor(F.log(_squared_distance() + 1e-9) * BINS).cast("int"))
    bins = far.groupBy("group", "start", "bin").agg(*_sums())
    order = Window.partitionBy("group", "start").orderBy("bin")
    return bins.withColumn("up_to", F.sum("n").over(order)).withColumn("rows", F.sum("n").over(Window.partitionBy("group", "start")))


def _inner(bins: DataFrame, chosen: Column) -> DataFrame:
    names = ["n", *[f"m{i}" for i in range(SIZE)], *[f"m{i}{j}" for i, j in PAIRS]]
    return _estimates(bins.filter(chosen).groupBy("group", "start").agg(*[F.sum(c).alias(c) for c in names], F.max("rows").alias("rows")))


def robust_estimates(rows: DataFrame, share: float = 0.75, steps: int = 5) -> DataFrame:
    """(group, mean, inverse, scale): reweighted minimum covariance determinant of each group of ``rows`` (group, x0..)."""
    middle = cut_lineage(rows.groupBy("group").agg(*[F.percentile_approx(f"x{i}", 0.5).alias(f"c{i}") for i in range(SIZE)]))
    off = rows.join(middle, "group").select("group", *[F.abs(F.col(f"x{i}") - F.col(f"c{i}")).alias(f"d{i}") for i in range(SIZE)])
    off = off.groupBy("group").agg(*[F.percentile_approx(f"d{i}", 0.5).alias(f"s{i}") for i in range(SIZE)])
    weight = [1 / (F.pow(F.col(f"s{i}") * 1.4826, 2) + LEAST[i] ** 2) for i in range(SIZE)]
    by_median = middle.join(off, "group").select(
        "group", F.lit(0).alias("start"), F.array(*[f"c{i}" for i in range(SIZE)]).alias("mean"),
        F.array(*[weight[i] if i == j else F.lit(0.0) for i, j in PAIRS]).alias("inverse"),
    )
    all_rows = rows.groupBy("group", F.lit(1).alias("start")).agg(*_sums()).withColumn("rows", F.col("n"))
    now = cut_lineage(by_median.union(_estimates(all_rows).select("group", "start", "mean", "inverse")))
    half = F.col("up_to") - F.col("n") < F.col("rows") * share
    for _ in range(steps):
        now = cut_lineage(_inner(_bins(rows, now), half))
    best = now.groupBy("group").agg(F.min(F.struct("size", "start", "mean", "inverse")).alias("e")).select("group", "e.*")
    # scaled so that the median distance is that of a normal distribution, then once more with all rows that are near
    bins = cut_lineage(_bins(rows, best))
    median = bins.filter("up_to * 2 >= rows").groupBy("group").agg(F.exp((F.min("bin") + 1) / BINS).alias("median"))
    near = F.col("bin") <= F.log(F.col("median") * (CHI_975 / CHI_MEDIAN)) * BINS
    final = cut_lineage(_inner(bins.join(median, "group"), near))
    last = _bins(rows, final).filter("up_to * 2 >= rows").groupBy("group").agg((F.exp((F.min("bin") + 1) / BINS) / CHI_MEDIAN).alias("scale"))
    return final.join(last, "group").select("group", "mean", "inverse", "scale")


def quality_rules(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    group: tuple[str, str] = ("lang", "source"),
    min_words: int = 10,
    max_repeat_percent: int = 20,
    cutoff: float = 100.0,
    min_rows: int = 100,
) -> DataFrame:
    """(id, counts, base_failed, distance, kept) for every row.

    ``base_failed``: under ``min_words`` words, or more than
    ``max_repeat_percent`` of the words in repeated five-word windows. The
    other rows give the estimates: of their own language and source if that
    group has ``min_rows`` of them, else of all such small groups of the
    language, else of all that are left; if these are under ``min_rows`` too,
    they are judged by the estimate of the whole corpus. ``distance`` is the squared
    Mahalanobis distance, scaled to the median of chi-squared; a row with more
    than ``cutoff`` is not kept. The default is far out in the tail, for texts
    are not normally distributed and clean ones are to stay.

    Null and empty texts have no words and fail. Null languages and sources are
    values of their own. Where the whole corpus has under ``min_rows`` rows to
    learn from, distances are null and rows are kept. Very long texts count
    whole. Repeated rows count each by itself; other columns are not read.
    """
    counted = _counted(docs, id, text, list(group))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    counted = counted.withColumn("base_failed", failed).withColumns({f"x{i}": x for i, x in enumerate(vector())})
    counted = cut_lineage(counted.withColumn("own", F.to_json(F.struct("_g0", "_g1"))))
    sizes = counted.filter("not base_failed").groupBy("own", "_g0").agg(F.count(F.lit(1)).alias("n"))
    small = sizes.filter(F.col("n") < min_rows).groupBy(F.col("_g0").alias("language")).agg(F.sum("n").alias("wider"))
    named = sizes.join(small, F.col("_g0").eqNullSafe(F.col("language")), "left").select(
        "own",
        F.when(F.col("n") >= min_rows, F.col("own"))
        .when(F.col("wider") >= min_rows, F.concat(F.lit("language "), F.coalesce("_g0", F.lit("\x00"))))
        .otherwise("rest")
        .alias("group"),
        "n",
    )
    named = cut_lineage(named)
    left_over, in_all = named.agg(F.sum(F.when(F.col("group") == "rest", F.col("n"))), F.sum("n")).first()
    named = named.drop("n")
    good = counted.filter("not base_failed").select("_id", "own", *[f"x{i}" for i in range(SIZE)])
    rows = good.join(named, "own").drop("own")
    if 0 < (left_over or 0) < min_rows:
        rows = rows.filter("group != 'rest'")
        if in_all >= min_rows:  # what is left is too little by itself
            rows = rows.unionByName(good.drop("own").withColumn("group", F.lit("rest")))
    rows = cut_lineage(rows)
    estimates = cut_lineage(robust_estimates(rows))
    judged = counted.join(named, "own", "left").join(estimates, "group", "left")
    judged = judged.withColumn("distance", F.when(~F.col("base_failed"), _squared_distance() / F.col("scale")))
    return judged.select(
        F.col("_id").alias(id), *COUNTS[:-1], "base_failed", "distance",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"),
    )
