"""Topic word, merge, split and report queries."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.standins import load, quoted, role, sql_with
from tidemark.catalog.text_queries import deid_sql
from tidemark.functions.text import words
from tidemark.functions.vectors import cosine
from tidemark.operators import reports, topics

STOP = topics.stop_words(["the", "of", "la", "der", "no", "not", "les"], ["no", "not"], ["tion", "and", "le"])
WORD_LIST = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def counts_sql(source: str, topic: str, text: str, key: str, stop, longest: int, min_topics: int, share: float) -> str:
    words = WORD_LIST.format(text)
    kept = f"WHERE w NOT IN ({quoted(stop)})" if stop else ""
    runs = " UNION ALL ".join(
        f"SELECT topic, {' || chr(32) || '.join('w' + str(j) for j in range(n))} AS term FROM seq"
        for n in range(1, longest + 1)
    )
    leads = ", ".join(f"lead(w, {j}) OVER (PARTITION BY key ORDER BY i) AS w{j}" for j in range(longest))
    return f"""
      (WITH tok AS (SELECT {key} AS key, {topic} AS topic, unnest(l) AS w, generate_subscripts(l, 1) AS i
                   FROM (SELECT *, {words} AS l FROM {source})),
      seq AS (SELECT topic, {leads} FROM tok {kept}),
      cnt AS (SELECT topic, term, count(*) AS n FROM ({runs}) WHERE term IS NOT NULL GROUP BY 1, 2)
      SELECT * FROM (SELECT topic, term, n, count(*) OVER (PARTITION BY term) AS n_topics,
                            CAST(sum(n) OVER (PARTITION BY term) AS BIGINT) AS n_all FROM cnt)
      WHERE n_topics >= {min_topics} AND n_topics <= {share} * (SELECT count(DISTINCT {topic}) FROM {source}))"""


WEIGHT_SQL = """
    (WITH t AS (SELECT topic, sum(n) AS words FROM counts GROUP BY 1), a AS (SELECT floor(avg(words)) AS a FROM t)
    SELECT c.topic, c.term, sqrt(c.n / t.words) * ln(1 + (a.a - c.n_all + 0.5) / (c.n_all + 0.5)) AS weight
    FROM counts c JOIN t ON t.topic = c.topic, a)"""
TOP_SQL = """
    SELECT topic, CAST(rn AS INT) AS rank, term, weight FROM (
      SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 12) DESC, term) AS rn FROM weights)
    WHERE rn <= {0}"""
NOTES = {"counts": counts_sql("notes", "topic", "text", "doc_id", STOP, 3, 5, 0.95), "weights": WEIGHT_SQL, "top": TOP_SQL.format(10)}
PARTS = {"counts": counts_sql("part", "p_size", "p_name", "p_partkey", [], 1, 1, 1.0), "weights": WEIGHT_SQL, "top": TOP_SQL.format(5)}
SETS_SQL = "SELECT topic, list_sort(list(DISTINCT term) FILTER (length(trim(term)) >= 2)) AS words FROM top WHERE topic <> -1 GROUP BY 1"
PAIRS_SQL = """
    SELECT * FROM (SELECT a.topic AS t1, b.topic AS t2,
                          len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))) AS jaccard
                   FROM sets a JOIN sets b ON a.topic < b.topic WHERE len(a.words) >= 2 AND len(b.words) >= 2)
    WHERE jaccard >= {0}"""
SIZES_SQL = "SELECT p_size AS topic, count(*) AS n FROM part GROUP BY 1"
THRESHOLD = 0.5
PART_SETS = {**PARTS, "sets": SETS_SQL, "pairs": PAIRS_SQL.format(THRESHOLD), "sizes": SIZES_SQL}
ONE_HOP_SQL = """
    SELECT topic, arg_max(winner, t1 * 1000 + t2) AS merged_topic FROM (
      SELECT t1, t2, CASE WHEN a.n >= b.n THEN t2 ELSE t1 END AS topic, CASE WHEN a.n >= b.n THEN t1 ELSE t2 END AS winner
      FROM pairs JOIN sizes a ON a.topic = t1 JOIN sizes b ON b.topic = t2) GROUP BY 1
    UNION ALL SELECT topic, -1 FROM sets WHERE len(words) < 2"""
REACH_SQL = """
    SELECT topic AS node, topic AS r FROM sets WHERE len(words) >= 2
    UNION SELECT CASE WHEN p.t1 = x.node THEN p.t2 ELSE p.t1 END, x.r
    FROM reach x JOIN pairs p ON p.t1 = x.node OR p.t2 = x.node"""
CHAIN_SQL = """
    SELECT topic, merged_topic FROM (
      SELECT node AS topic, first_value(node) OVER (PARTITION BY root ORDER BY n DESC, node) AS merged_topic
      FROM (SELECT node, min(r) AS root FROM reach GROUP BY 1) x JOIN sizes s ON s.topic = x.node)
    WHERE topic <> merged_topic UNION ALL SELECT topic, -1 FROM sets WHERE len(words) < 2"""


def note_counts(spark, sf):
    return topics.term_counts(role(spark, sf, "notes"), "topic", "text", STOP, 3, 5, 0.95)


def note_top(spark, sf, k=10):
    return topics.top_words(topics.topic_word_weights(note_counts(spark, sf)), k)


def part_top(spark, sf, k=5):
    counts = topics.term_counts(load(spark, sf, "part"), "p_size", "p_name", longest=1)
    return topics.top_words(topics.topic_word_weights(counts), k)


def part_merge(spark, sf, transitive):
    sizes = load(spark, sf, "part").groupBy(F.col("p_size").alias("topic")).agg(F.count("*").alias("n"))
    return topics.merge_map(topics.topic_word_sets(part_top(spark, sf)), sizes, THRESHOLD, transitive)


@query("ngram_counts", sql_with(["notes"], "SELECT * FROM counts", NOTES))
def _(spark, sf):
    return note_counts(spark, sf)


@query("ctfidf_top_words", sql_with(["notes"], "SELECT topic, rank, term, round(weight, 6) AS weight FROM top", NOTES))
def _(spark, sf):
    return note_top(spark, sf).withColumn("weight", F.round("weight", 6))


@query("topic_keywords", sql_with(
    ["notes"],
    f"SELECT topic, CASE WHEN topic = -1 THEN 'Noise/Outlier' ELSE coalesce(string_agg({deid_sql('term')}, ', ' ORDER BY rank), 'general') END AS keywords FROM top GROUP BY 1",
    NOTES))
def _(spark, sf):
    return topics.topic_keywords(note_top(spark, sf))


@query("word_sets", sql_with([], "SELECT topic, array_to_string(words, ' ') AS words FROM sets", PART_SETS))
def _(spark, sf):
    return topics.topic_word_sets(part_top(spark, sf)).withColumn("words", F.array_join("words", " "))


@query("jaccard_pairs", sql_with([], "SELECT t1, t2, round(jaccard, 6) AS jaccard FROM pairs", {**PART_SETS, "pairs": PAIRS_SQL.format(0.3)}))
def _(spark, sf):
    pairs = topics.jaccard_pairs(topics.topic_word_sets(part_top(spark, sf)), 0.3)
    return pairs.withColumn("jaccard", F.round("jaccard", 6))


@query("merge_topics", sql_with([], CHAIN_SQL, {**PART_SETS, "reach": REACH_SQL}))
def _(spark, sf):
    return part_merge(spark, sf, True)


@query("merge_topics_one_hop", sql_with([], ONE_HOP_SQL, PART_SETS))
def _(spark, sf):
    return part_merge(spark, sf, False)


@query("merged_rows", sql_with(
    [], "SELECT p_partkey, coalesce(m.merged_topic, p_size) AS topic FROM part LEFT JOIN m ON m.topic = p_size",
    {**PART_SETS, "m": ONE_HOP_SQL}))
def _(spark, sf):
    rows = load(spark, sf, "part").select("p_partkey", F.col("p_size").alias("topic"))
    return topics.apply_merge(rows, part_merge(spark, sf, False), "topic")


@query("heterogeneity", """
    WITH v AS (SELECT vec_id, label - 1 AS topic, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
         p AS (SELECT a.topic, avg(list_cosine_similarity(a.e, b.e)) AS c FROM v a JOIN v b ON a.topic = b.topic AND a.vec_id <> b.vec_id GROUP BY 1)
    SELECT v.topic, count(*) AS n, CASE WHEN v.topic = -1 THEN NULL ELSE round(1 - any_value(p.c), 4) END AS heterogeneity
    FROM v JOIN p ON p.topic = v.topic GROUP BY 1""")
def _(spark, sf):
    vectors = load(spark, sf, "embeddings").select((F.col("label") - 1).alias("topic"), "embedding")
    return topics.heterogeneity(vectors, "topic", "embedding")


# every word of a part name has a vector but those that begin with b
@query("word_heterogeneity", sql_with(
    [], """SELECT t.topic, count(e) AS n, coalesce(any_value(p.h), 0.0) AS heterogeneity FROM v t LEFT JOIN p ON p.topic = t.topic GROUP BY 1""",
    {**PARTS,
     "v": """SELECT DISTINCT topic, term, CASE WHEN term NOT LIKE 'b%' THEN
             [CAST(length(term) AS DOUBLE), ascii(substr(term, 1, 1)) - 110.0, ascii(substr(term, 3, 1)) - 105.0] END AS e FROM top""",
     "p": """SELECT a.topic, round(1 - avg(list_cosine_similarity(a.e, b.e)), 4) AS h
             FROM v a JOIN v b ON a.topic = b.topic AND a.term <> b.term WHERE a.e IS NOT NULL AND b.e IS NOT NULL GROUP BY 1"""}))
def _(spark, sf):
    names = load(spark, sf, "part").select(F.explode(words(F.col("p_name"))).alias("word")).distinct()
    vector = F.array(
        F.length("word").cast("double"), F.ascii(F.substring("word", 1, 1)) - F.lit(110.0), F.ascii(F.substring("word", 3, 1)) - F.lit(105.0)
    )
    return topics.word_heterogeneity(part_top(spark, sf), names.filter(~F.col("word").startswith("b")).select("word", vector.alias("vector")))


@query("cosine", """
    SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(spark, sf):
    vectors = load(spark, sf, "embeddings")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return vectors.join(following, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


PHRASES = ["thatin", "the rewh", "nicht ein", "zzz", "hehely", "une"]


@query("phrase_coverage", sql_with(
    ["notes"],
    " UNION ALL ".join(
        f"SELECT '{p}' AS phrase, CAST(EXISTS (SELECT 1 FROM top WHERE topic <> -1 AND (contains(term, '{p}') OR contains('{p}', term))) AS INT) AS covered"
        for p in PHRASES), NOTES))
def _(spark, sf):
    return topics.phrase_coverage(note_top(spark, sf), PHRASES)


LANGS = "CAST(CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE -1 END AS INT)"


@query("oversized_topics", f"""
    SELECT topic, n, round(n / (SELECT count(*) FROM documents), 6) AS share
    FROM (SELECT {LANGS} AS topic, count(*) AS n FROM documents GROUP BY 1 HAVING topic <> -1 ORDER BY n DESC, topic LIMIT 3)
    WHERE n / (SELECT count(*) FROM documents) >= 0.12""")
def _(spark, sf):
    docs = load(spark, sf, "documents").select(F.expr(LANGS).alias("topic"))
    return topics.oversized_topics(docs, "topic", 0.12).withColumn("share", F.round("share", 6))


@query("split_ids", f"""
    WITH d AS (SELECT doc_id, {LANGS} AS topic, CAST(doc_id % 4 - 1 AS INT) AS sub FROM documents),
         s AS (SELECT topic, count(*) AS n, max(sub) AS top FROM d WHERE topic <> -1 GROUP BY 1),
         w AS (SELECT * FROM s WHERE n / (SELECT count(*) FROM d) >= 0.12 ORDER BY n DESC, topic LIMIT 3),
         o AS (SELECT topic, (SELECT max(topic) FROM d) + 1 + coalesce(sum(top + 1) OVER (ORDER BY n DESC, topic
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM w)
    SELECT doc_id, CAST(CASE WHEN o.topic IS NULL THEN d.topic WHEN sub < 0 THEN -1 ELSE start + sub END AS INT) AS topic
    FROM d LEFT JOIN o ON o.topic = d.topic""")
def _(spark, sf):
    docs = load(spark, sf, "documents").select(
        "doc_id", F.expr(LANGS).alias("topic"), (F.col("doc_id") % 4 - 1).cast("int").alias("sub")
    )
    targets = topics.oversized_topics(docs, "topic", 0.12)
    return topics.apply_split(docs, "topic", "sub", targets).drop("sub")


SUMMARY_SQL = """
    SELECT count(*) AS n_total, count(*) FILTER (topic = -1) AS n_noise, count(DISTINCT topic) FILTER (topic <> -1) AS n_topics,
           round(count(*) FILTER (topic = -1) / count(*), 6) AS noise_ratio,
           CASE WHEN count(*) FILTER (topic = -1) / count(*) < 0.15 THEN 'good' WHEN count(*) FILTER (topic = -1) / count(*) < 0.3
                THEN 'needs improvement' WHEN count(*) FILTER (topic = -1) / count(*) < 0.6 THEN 'excessive' ELSE 'critical' END AS grade
    FROM notes"""
HET_SQL = """
    SELECT label - 1 AS topic, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"""
HET_SCORES = """
    SELECT a.topic, round(1 - avg(list_cosine_similarity(a.e, b.e)), 4) AS heterogeneity
    FROM v a JOIN v b ON a.topic = b.topic AND a.vec_id <> b.vec_id WHERE a.topic <> -1 GROUP BY 1"""


@query("topic_report", sql_with(["notes"], SUMMARY_SQL))
def _(spark, sf):
    return reports.topic_summary(role(spark, sf, "notes"), "topic").withColumn("noise_ratio", F.round("noise_ratio", 6))


@query("most_heterogeneous", sql_with(
    [], "SELECT topic, heterogeneity, CASE WHEN heterogeneity > 0.5 THEN 'decompose' WHEN heterogeneity > 0.3 THEN 'review' ELSE '' END AS flag "
    "FROM h ORDER BY heterogeneity DESC, topic LIMIT 5", {"v": HET_SQL, "h": HET_SCORES}))
def _(spark, sf):
    vectors = load(spark, sf, "embeddings").select((F.col("label") - 1).alias("topic"), "embedding")
    return reports.most_heterogeneous(topics.heterogeneity(vectors, "topic", "embedding"), "topic")


@query("label_distribution", sql_with(
    ["topics"], "SELECT cc_system, count(*) AS n, round(count(*) / (SELECT count(*) FROM topics), 6) AS share FROM topics WHERE cc_topic <> -1 GROUP BY 1"))
def _(spark, sf):
    found = reports.label_distribution(role(spark, sf, "topics"), "cc_topic", "cc_system")
    return found.withColumn("share", F.round("share", 6))


@query("method_checklist", sql_with(
    ["notes"],
    "SELECT 'noise below 30 percent' AS \"check\", CAST(noise_ratio < 0.3 AS INT) AS passed FROM s "
    "UNION ALL SELECT 'no merged topics', CAST((SELECT count(*) FROM m) = 0 AS INT) "
    "UNION ALL SELECT 'no topic above 0.5 heterogeneity', CAST((SELECT max(heterogeneity) FROM h) <= 0.5 AS INT) "
    "UNION ALL SELECT 'at least 20 topics', CAST(n_topics >= 20 AS INT) FROM s",
    {**PART_SETS, "m": ONE_HOP_SQL, "v": HET_SQL, "h": HET_SCORES, "s": SUMMARY_SQL}))
def _(spark, sf):
    vectors = load(spark, sf, "embeddings").select((F.col("label") - 1).alias("topic"), "embedding")
    scores = topics.heterogeneity(vectors, "topic", "embedding")
    worst = scores.filter("topic <> -1").agg(F.max("heterogeneity").alias("w")).scalar()
    merged = part_merge(spark, sf, False).agg(F.count("*").alias("n")).scalar()
    return reports.method_checklist(reports.topic_summary(role(spark, sf, "notes"), "topic"), merged, worst)


@query("concat_batches", "SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark")
def _(spark, sf):
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs.unionByName(load(spark, sf, "benchmark").select("text", F.col("item_id").alias("id")))
