"""Topic words, duplicate topics, oversized topics and topic quality."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import clean_keywords, ngrams, without, words
from tidemark.functions.vectors import norm
from tidemark.operators.aggregates import top_k_per_group
from tidemark.operators.graph import connected_components
from tidemark.operators.parallel import spread
from tidemark.session import cut_lineage

NOISE = -1
BITS_PER_TERM, FEWEST_BITS, MOST_BITS = 32, 1 << 16, 1 << 27  # of the table that tells which runs may be part of longer ones


def stop_words(base, keep, extra) -> list[str]:
    """(base without keep) plus extra."""
    return sorted((set(base) - set(keep)) | set(extra))


def term_counts(
    df: DataFrame, topic: str, text: str, stop=(), longest: int = 3, min_topics: int = 1, max_share: float = 1.0
) -> DataFrame:
    """topic, term, n (uses in the topic), n_topics, n_all (uses in all topics).

    Terms are runs of 1 to ``longest`` words within a text after stop words are
    gone. Counting per (topic, term) combines before the shuffle; document
    frequency limits count topics. With a lower limit, a longer run is counted
    only where the shorter runs in it may reach the limit.
    """
    rows = spread(df.select(topic, text))
    tokens = rows.select(F.col(topic).alias("topic"), without(words(F.col(text)), stop).alias("tokens"))
    if min_topics > 1 and longest > 1:
        counts = _common_runs(tokens, longest, min_topics)
    else:
        counts = _per_topic(tokens.select("topic", F.explode(ngrams(F.col("tokens"), longest)).alias("term")), min_topics)
    if max_share < 1.0:
        all_topics = df.agg(F.countDistinct(topic).alias("t")).scalar()
        counts = counts.filter(F.col("n_topics") <= F.lit(max_share) * all_topics)
    return counts


def _per_topic(terms: DataFrame, min_topics: int) -> DataFrame:
    """The counts of the rows (topic, term) for terms in at least ``min_topics`` topics."""
    counts = terms.groupBy("topic", "term").agg(F.count("*").alias("n"))
    # a term has at most one row per topic here
    per_term = W.partitionBy("term")
    counts = counts.withColumns({"n_topics": F.count("*").over(per_term), "n_all": F.sum("n").over(per_term)})
    return counts.filter(F.col("n_topics") >= min_topics) if min_topics > 1 else counts


def _common_runs(tokens: DataFrame, longest: int, min_topics: int) -> DataFrame:
    """``_per_topic`` of all runs, from the short ones to the long ones.

    A run is in no more topics than the two runs of one word less in it, so
    only runs whose parts both reach the limit are counted. A bit table of
    bounded size tells the parts; parts that share a bit with one that reaches
    the limit let runs pass that the count then drops.
    """
    tokens = cut_lineage(tokens)
    found = cut_lineage(_per_topic(tokens.select("topic", F.explode("tokens").alias("term")), min_topics))
    levels, parts = [found], F.col("tokens")
    for n in range(2, longest + 1):
        bits, table = _bit_table(found.select("term").distinct())
        held = F.arrays_zip(
            parts.alias("head"), F.slice(parts, 2, F.size("tokens")).alias("tail"), F.slice("tokens", n, F.size("tokens")).alias("last")
        )
        # the last part has no word behind it
        runs = tokens.filter(F.size("tokens") >= n).select("topic", F.inline(held)).filter(F.col("tail").isNotNull())
        for part in ("head", "tail"):
            runs = runs.filter(_has_bit(table, bits, part))
        found = cut_lineage(_per_topic(runs.select("topic", F.concat("head", F.lit(" "), "last").alias("term")), min_topics))
        levels.append(found)
        later = F.slice("tokens", n, F.size("tokens"))
        parts = F.array_compact(F.zip_with(parts, later, lambda run, t: F.concat(run, F.lit(" "), t)))
    return reduce(DataFrame.unionByName, levels)


def _spot(bits: int, *columns) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(bits))


def _bit_table(terms: DataFrame) -> tuple[int, DataFrame]:
    """(bits, table of one row): 64-bit words in which the bit of every row of ``terms`` is set; about ``BITS_PER_TERM`` bits for each."""
    bits = FEWEST_BITS
    wanted = min(terms.count() * BITS_PER_TERM, MOST_BITS)
    while bits < wanted:
        bits *= 2
    spots = terms.select(_spot(bits, *terms.columns).alias("spot"))
    held = spots.selectExpr("shiftright(spot, 6) AS word", "shiftleft(1L, int(spot & 63)) AS held")
    empty = terms.sparkSession.range(bits // 64).selectExpr("id AS word", "0L AS held")
    words_of_table = held.union(empty).groupBy("word").agg(F.bit_or("held").alias("held"))
    listed = F.sort_array(F.collect_list(F.struct("word", "held")))
    return bits, cut_lineage(words_of_table.agg(listed["held"].alias("held")))


def _has_bit(table: DataFrame, bits: int, *columns) -> Column:
    spot = _spot(bits, *columns)
    word = F.get(table.select("held").scalar(), F.shiftright(spot, 6).cast("int"))
    return F.call_function("shiftright", word, spot.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def _followed(tokens: DataFrame, longest: int) -> DataFrame:
    """(topic, w0, w1, ...): every word with the words behind it, null behind the end of a text; single last words are left out."""
    behind = [F.slice("tokens", i + 1, F.size("tokens")).alias(f"w{i}") for i in range(longest)]
    return tokens.select("topic", F.inline(F.arrays_zip(*behind))).filter(F.col("w1").isNotNull())


def _run(n: int) -> Column:
    return F.concat_ws(" ", *[f"w{i}" for i in range(n)])


def _uses(tokens: DataFrame, terms: DataFrame, longest: int) -> DataFrame:
    """The counts, as ``_per_topic`` gives them, of all runs of two or more words in ``terms`` (term), and of a few more.

    Places whose first two words begin none of the runs are left before runs are formed.
    """
    first = F.split("term", " ")
    bits, begun = _bit_table(terms.select(first[0].alias("w0"), first[1].alias("w1")).distinct())
    known, table = _bit_table(terms.select("term").distinct())
    places = _followed(tokens, longest).filter(_has_bit(begun, bits, "w0", "w1"))
    runs = [F.when(F.col(f"w{n - 1}").isNotNull(), _run(n)) for n in range(2, longest + 1)]
    found = places.select("topic", F.explode(F.array(*runs)).alias("term"))
    # a bit that several terms share is set or not for all uses of a term, so counts are exact
    return _per_topic(found.filter(F.col("term").isNotNull() & _has_bit(table, known, "term")), 1)


def _frequent_runs(tokens: DataFrame, words: DataFrame, least: DataFrame, longest: int) -> DataFrame:
    """(term): runs of two or more words used in some topic as often as ``least`` (topic, least) asks there.

    ``words``: topic, term, n. A run is used no more often than the two runs of one word less in it.
    """
    found, levels = words, []
    for n in range(2, longest + 1):
        parts = F.split("term", " ")
        known = found.join(least, "topic").filter(F.col("n") >= F.col("least"))
        bits, table = _bit_table(known.select("topic", *[parts[i].alias(f"w{i}") for i in range(n - 1)]))
        places = _followed(tokens, n).filter(F.col(f"w{n - 1}").isNotNull())
        for start in (0, 1):
            places = places.filter(_has_bit(table, bits, "topic", *[f"w{i}" for i in range(start, start + n - 1)]))
        counts = places.select("topic", _run(n).alias("term")).groupBy("topic", "term").agg(F.count("*").alias("n"))
        found = cut_lineage(counts.join(least, "topic").filter(F.col("n") >= F.col("least")).drop("least"))
        levels.append(found.select("term"))
    return cut_lineage(reduce(DataFrame.unionByName, levels).distinct())


def _least_uses(weighted: DataFrame, k: int) -> DataFrame:
    """(topic, least): a term used less often in a topic is not among its k heaviest.

    ``weighted``: words with weight, topic_words and mean_words. The k-th
    weight W of the words is a floor. A term used n times in the topic is used
    as often or more in all, so it weighs sqrt(n / topic_words) *
    ln((A + 1) / (n + .5)) at most, and the logarithm falls with n: each turn
    puts the bound found so far into it and gets the next one. Topics with
    fewer than k words, or W not above 0, have no bound.
    """
    kth = F.when(F.count("*") >= k, F.get(F.sort_array(F.collect_list("weight"), asc=False), F.lit(k - 1)))
    kept = top_k_per_group(weighted.select("topic", "topic_words", "mean_words", "weight"), "topic", [F.col("weight").desc()], k)
    floors = kept.groupBy("topic", "topic_words", "mean_words").agg(kth.alias("floor"))
    # weights are compared after rounding to 12 places
    floors = floors.select("topic", "topic_words", "mean_words", (F.col("floor") * (1 - 1e-9) - 1e-11).alias("floor"), F.lit(1.0).alias("least"))
    for _ in range(8):
        log = F.log((F.col("mean_words") + 1) / (F.col("least") + 0.5))
        needed = F.ceil(F.col("topic_words") * F.try_divide("floor", log) ** 2 - 1e-6).cast("double")
        bound = F.when(F.col("floor") > 0, F.when(log > 0, F.greatest("least", needed)).otherwise(F.lit(float("inf"))))
        floors = floors.withColumn("least", F.coalesce(bound, F.lit(1.0)))
    return floors.select("topic", "least")


def heaviest_terms(
    df: DataFrame, topic: str, text: str, k: int, stop=(), longest: int = 3, max_share: float = 1.0
) -> DataFrame:
    """``top_words`` of the ``topic_word_weights`` of ``term_counts`` without a lower limit of topics, the same rows.

    Not every run is counted for that. Words are; a run in more than
    ``max_share`` of the topics is in one of the smallest topics, so only the
    runs there are looked for elsewhere; and a run can be among the heaviest of
    a topic only if it is used there as often as the words' weights ask.
    """
    rows = spread(df.select(topic, text))
    tokens = cut_lineage(rows.select(F.col(topic).alias("topic"), without(words(F.col(text)), stop).alias("tokens")))
    counts = cut_lineage(_per_topic(tokens.select("topic", F.explode("tokens").alias("term")), 1))
    in_text = sum(F.greatest(F.size("tokens") - n, F.lit(0)).cast("long") for n in range(longest))
    sizes = cut_lineage(tokens.groupBy("topic").agg(F.sum(in_text).alias("runs")))

    def usual(table: DataFrame) -> DataFrame:
        return table if most is None else table.filter(F.col("n_topics") <= most)

    most = None
    if max_share < 1.0:
        held = sizes.agg(F.count("*").alias("all"), F.count("topic").alias("named")).first()
        most = max_share * held["named"]
        dropped = counts.filter(F.col("n_topics") > most).select("topic", "n")
        # a term in more topics than that misses fewer topics than these
        smallest = sizes.orderBy("runs", "topic").limit(max(0, held["all"] - int(most))).select(F.col("topic").alias("__t"))
        inside = tokens.join(smallest, F.col("topic").eqNullSafe(F.col("__t")), "left_semi")
        if longest > 1:
            runs = [F.when(F.col(f"w{n - 1}").isNotNull(), _run(n)) for n in range(2, longest + 1)]
            there = _followed(inside, longest).select(F.explode(F.array(*runs)).alias("term")).filter("term IS NOT NULL")
            everywhere = _uses(tokens, cut_lineage(there.distinct()), longest).filter(F.col("n_topics") > most)
            dropped = dropped.unionByName(everywhere.select("topic", "n"))
        gone = dropped.groupBy(F.col("topic").alias("__t")).agg(F.sum("n").alias("gone"))
        sizes = sizes.join(gone, F.col("topic").eqNullSafe(F.col("__t")), "left").select(
            "topic", (F.col("runs") - F.coalesce("gone", F.lit(0))).alias("runs")
        )
    sizes = cut_lineage(_with_mean(sizes.filter("runs > 0").select("topic", F.col("runs").alias("topic_words"))))
    weighted = _weighted(usual(counts), sizes)
    if longest > 1:
        found = _frequent_runs(tokens, counts.select("topic", "term", "n"), cut_lineage(_least_uses(weighted, k)), longest)
        weighted = weighted.unionByName(_weighted(usual(_uses(tokens, found, longest)), sizes))
    return top_words(weighted, k)


def topic_word_weights(counts: DataFrame) -> DataFrame:
    """Class-based TF-IDF: sqrt(share of the topic's words) * ln(1 + (A - f + .5) / (f + .5)).

    f = uses of the term in all topics, A = mean words per topic, truncated.
    The counts are read twice and therefore stored.
    """
    counts = cut_lineage(counts)
    sizes = counts.groupBy("topic").agg(F.sum("n").alias("topic_words"))
    return _weighted(counts, _with_mean(sizes)).drop("mean_words")


def _with_mean(sizes: DataFrame) -> DataFrame:
    # one row per topic
    mean = F.floor(F.avg("topic_words").over(W.partitionBy())).cast("double")
    return sizes.withColumn("mean_words", mean)


def _weighted(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    idf = F.log(1 + (F.col("mean_words") - F.col("n_all") + 0.5) / (F.col("n_all") + 0.5))
    weight = F.sqrt(F.col("n") / F.col("topic_words")) * idf
    return counts.join(sizes, "topic").withColumn("weight", weight)


def top_words(weights: DataFrame, k: int) -> DataFrame:
    """The k heaviest words per topic; ties by word."""
    return top_k_per_group(weights, "topic", [F.round("weight", 12).desc(), F.col("term")], k).select(
        "topic", "rank", "term", "weight"
    )


def topic_keywords(top: DataFrame, k: int = 10, topics: DataFrame | None = None) -> DataFrame:
    """One cleaned ", "-joined keyword string per topic; noise has a fixed name.

    ``topics`` (topic) names all topics; those without a word get the keyword of an empty list.
    """
    listed = top.filter(F.col("rank") <= k).groupBy("topic").agg(
        F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("l")
    )
    if topics is not None:
        listed = topics.select("topic").distinct().join(listed, "topic", "left")
    joined = F.coalesce(F.array_join(F.transform("l", lambda s: s["term"]), ", "), F.lit(""))
    keywords = F.when(F.col("topic") == NOISE, F.lit("Noise/Outlier")).otherwise(clean_keywords(joined))
    return listed.select("topic", keywords.alias("keywords"))


def topic_word_sets(top: DataFrame, k: int = 5, min_length: int = 2, topics: DataFrame | None = None) -> DataFrame:
    """topic, words: the distinct stripped top-k words of two or more characters.

    ``topics`` (topic) names all topics; those without a word get an empty set.
    """
    word = F.trim("term")
    valid = F.when((F.col("rank") <= k) & (F.length(word) >= min_length), word)
    if topics is not None:
        top = topics.select("topic").distinct().join(top, "topic", "left")
    return (
        top.filter(F.col("topic") != NOISE)
        .groupBy("topic")
        .agg(F.sort_array(F.collect_set(valid)).alias("words"))
    )


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def _prefix_length(size: Column, threshold: float, min_words: int) -> Column:
    """Words that must be looked up so that no partner can be missed.

    Two sets of sizes n and m reach the threshold only with an overlap of
    t / (1 + t) * (n + m); the smallest possible partner gives the smallest
    overlap o, and then the n - o + 1 rarest words hold a common one.
    """
    partner = F.greatest(F.lit(min_words), F.ceil(threshold * size - 1e-9))
    overlap = F.greatest(F.lit(1), F.ceil(threshold / (1 + threshold) * (size + partner) - 1e-9))
    return F.greatest(size - overlap + 1, F.lit(1))


def jaccard_pairs(
    sets: DataFrame, threshold: float = 0.5, min_words: int = 2, id_col: str = "topic"
) -> DataFrame:
    """t1 < t2 and their Jaccard similarity where it reaches the threshold.

    Sets meet only on their rarest words (an exact filter), so a word shared by
    very many sets does not pair them all.
    """
    usable = sets.filter(F.size("words") >= min_words)
    long = usable.select(F.col(id_col).alias("t"), "words", F.explode("words").alias("word"))
    frequency = long.groupBy("word").agg(F.count("*").alias("f"))
    prefix = _prefix_length(F.size("words"), threshold, min_words)
    order = W.partitionBy("t").orderBy("f", "word")
    rare = (
        long.join(frequency, "word")
        .withColumn("__i", F.row_number().over(order))
        .filter(F.col("__i") <= prefix)
        .select("t", "words", "word")
    )
    left = rare.select(F.col("t").alias("t1"), F.col("words").alias("w1"), "word")
    right = rare.select(F.col("t").alias("t2"), F.col("words").alias("w2"), "word")
    met = left.join(right, "word").filter(F.col("t1") < F.col("t2"))
    reached = met.withColumn("jaccard", jaccard(F.col("w1"), F.col("w2"))).filter(F.col("jaccard") >= threshold)
    return reached.groupBy("t1", "t2").agg(F.max("jaccard").alias("jaccard"))


def weak_topics(sets: DataFrame, min_words: int = 2) -> DataFrame:
    """Topics with too few usable words; they are demoted to noise."""
    return sets.filter(F.size("words") < min_words).select("topic")


def merge_map(
    sets: DataFrame, sizes: DataFrame, threshold: float = 0.5, transitive: bool = True, min_words: int = 2
) -> DataFrame:
    """topic, merged_topic for every topic that changes.

    ``sizes``: topic, n. The larger topic of a pair wins, ties go to the lower
    id. ``transitive`` merges whole chains into their largest member; otherwise
    a topic moves one hop and, where it loses several pairs, the last pair in
    (t1, t2) order decides. Weak topics become noise in both modes.
    """
    sets = cut_lineage(sets)
    weak = weak_topics(sets, min_words).withColumn("merged_topic", F.lit(NOISE))
    usable = sets.filter(F.size("words") >= min_words)
    if transitive:
        # Equal word sets are linked to one of them, not to each other.
        twins = usable.groupBy("words").agg(F.min("topic").alias("lead"))
        pairs = jaccard_pairs(twins, threshold, min_words, id_col="lead")
        same = usable.join(twins, "words").select(F.col("topic").alias("a"), F.col("lead").alias("b"))
        edges = pairs.select(F.col("t1").alias("a"), F.col("t2").alias("b")).union(same)
        roots = connected_components(usable.select(F.col("topic").alias("node")), edges)
        sized = cut_lineage(roots.join(sizes.select(F.col("topic").alias("node"), "n"), "node"))
        best = sized.groupBy("root").agg(
            F.max(F.struct(F.col("n"), (-F.col("node")).alias("neg"))).alias("b")
        )
        target = sized.join(best, "root").select(
            F.col("node").alias("topic"), (-F.col("b.neg")).cast("int").alias("merged_topic")
        )
    else:
        pairs = jaccard_pairs(usable, threshold, min_words)
        sizes = cut_lineage(sizes.join(sets.select("topic"), "topic", "left_semi"))
        n1 = sizes.select(F.col("topic").alias("t1"), F.col("n").alias("n1"))
        n2 = sizes.select(F.col("topic").alias("t2"), F.col("n").alias("n2"))
        keep_first = F.col("n1") >= F.col("n2")
        moves = pairs.join(n1, "t1").join(n2, "t2").select(
            F.when(keep_first, F.col("t2")).otherwise(F.col("t1")).alias("topic"),
            F.when(keep_first, F.col("t1")).otherwise(F.col("t2")).alias("to"),
            "t1", "t2",
        )
        target = moves.groupBy("topic").agg(
            F.max_by("to", F.struct("t1", "t2")).cast("int").alias("merged_topic")
        )
    changed = target.filter(F.col("topic") != F.col("merged_topic"))
    return changed.unionByName(weak)


def apply_merge(df: DataFrame, mapping: DataFrame, topic: str) -> DataFrame:
    """Replace topics by their merge target."""
    named = mapping.withColumnRenamed("topic", topic)
    return df.join(named, topic, "left").withColumn(
        topic, F.coalesce(F.col("merged_topic"), F.col(topic))
    ).drop("merged_topic")


def oversized_topics(df: DataFrame, topic: str, share: float = 0.15, most: int = 3) -> DataFrame:
    """The largest ``most`` topics that hold at least ``share`` of all rows (noise counts as rows)."""
    sizes = df.groupBy(F.col(topic).alias("topic")).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("t")).scalar()
    largest = sizes.filter(F.col("topic") != NOISE).orderBy(F.col("n").desc(), "topic").limit(most)
    return largest.withColumn("share", F.col("n") / total).filter(F.col("share") >= share)


def apply_split(df: DataFrame, topic: str, sub_topic: str, targets: DataFrame, above: Column | None = None) -> DataFrame:
    """Give the sub-topics of split topics new ids.

    The first target's sub-topics start at the highest id + 1, the next
    target's after those; sub-topic -1 becomes noise. ``targets``: topic, n.
    ``above`` is the highest id there was before topics were merged, so that
    no part takes the id of a topic that was merged away.
    """
    wanted = targets.select(F.col("topic").alias("__t"), F.col("n").alias("__n"))
    # at most as many rows as topics were asked to be split
    used = (
        df.join(wanted, F.col(topic) == F.col("__t"))
        .groupBy("__t", "__n")
        .agg(F.greatest(F.max(sub_topic), F.lit(-1)).alias("__top"))
    )
    earlier = W.partitionBy().orderBy(F.col("__n").desc(), "__t").rowsBetween(W.unboundedPreceding, -1)
    highest = df.agg(F.max(topic).alias("m")).scalar()
    if above is not None:
        highest = F.greatest(highest, above)
    starts = used.withColumn(
        "__start", highest + 1 + F.coalesce(F.sum(F.col("__top") + 1).over(earlier), F.lit(0))
    ).select("__t", "__start")
    joined = df.join(starts, F.col(topic) == F.col("__t"), "left")
    moved = F.when(F.col(sub_topic) < 0, F.lit(NOISE)).otherwise(F.col("__start") + F.col(sub_topic))
    return joined.withColumn(
        topic, F.when(F.col("__t").isNull(), F.col(topic)).otherwise(moved).cast("int")
    ).drop("__t", "__start")


def heterogeneity(vectors: DataFrame, topic: str, vector: str) -> DataFrame:
    """1 - mean pairwise cosine of a topic's vectors; 0.0 below two vectors, null for noise.

    With unit vectors u the sum of all pairwise cosines is |sum u|^2 - n, so
    sums per dimension are enough and no pairs are formed.
    """
    unit = vectors.withColumn("__len", norm(F.col(vector)))
    sizes = vectors.groupBy(topic).agg(F.count("*").alias("n"))
    sums = (
        unit.filter(F.col("__len") > 0)
        .select(topic, "__len", F.posexplode(vector).alias("dim", "x"))
        .groupBy(topic, "dim")
        .agg(F.sum(F.col("x").cast("double") / F.col("__len")).alias("s"))
        .groupBy(topic)
        .agg(F.sum(F.col("s") * F.col("s")).alias("__sq"))
    )
    zero = unit.filter(F.col("__len") > 0).groupBy(topic).agg(F.count("*").alias("__m"))
    n = F.col("n")
    mean = (F.coalesce(F.col("__sq"), F.lit(0.0)) - F.coalesce(F.col("__m"), F.lit(0))) / (n * (n - 1))
    score = F.when(F.col(topic) == NOISE, None).when(n < 2, F.lit(0.0)).otherwise(F.round(1 - mean, 4))
    return (
        sizes.join(sums, topic, "left").join(zero, topic, "left").select(topic, "n", score.alias("heterogeneity"))
    )


def word_heterogeneity(top: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """topic, n, heterogeneity: 1 - mean pairwise cosine of the vectors of a topic's distinct top-k words.

    ``vectors``: word, vector, one row per word. ``n`` counts the words that
    have a vector; words without one are left out, and a topic with fewer than
    two of them scores 0.0. Noise has no score.
    """
    used = top.filter(F.col("rank") <= k).select("topic", F.trim("term").alias("word")).distinct()
    scores = heterogeneity(used.join(vectors, "word"), "topic", "vector")
    missing = F.when(F.col("topic") != NOISE, F.lit(0.0))
    return used.select("topic").distinct().join(scores, "topic", "left").select(
        "topic", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("heterogeneity", missing).alias("heterogeneity")
    )


def phrase_coverage(top: DataFrame, phrases: list[str]) -> DataFrame:
    """phrase, covered: some topic word contains the phrase or lies in it. One pass over the words."""
    word = F.lower("term")
    real = top.filter(F.col("topic") != NOISE)
    wide = real.agg(
        *[
            F.coalesce(F.max((word.contains(p) | F.lit(p).contains(word)).cast("int")), F.lit(0)).alias(f"p{i}")
            for i, p in enumerate(phrases)
        ]
    )
    rows = [F.struct(F.lit(p).alias("phrase"), F.col(f"p{i}").alias("covered")) for i, p in enumerate(phrases)]
    return wide.select(F.inline(F.array(*rows)))
