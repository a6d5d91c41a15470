"""Text cleaning, rule and relabelling queries."""

from functools import reduce

from pyspark.sql import functions as F

from tidemark import clinical_values as values
from tidemark.catalog.registry import query
from tidemark.catalog.standins import load, role, sql_with
from tidemark.functions import text as tx
from tidemark.operators import aggregates
from tidemark.operators.joins import label_shift
from tidemark.operators.parallel import spread
from tidemark.operators.relabel import OTHER, relabel, topic_labels
from tidemark.operators.rules import substring_label, word_label
from tidemark.plans import complaints

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


BLANKS = literal(tx.BLANKS)


def word_sql(column: str, phrase: str) -> str:
    return rf"regexp_matches({column}, '(?i)(^|{NOT_WORD})({phrase})({NOT_WORD}|$)')"


def expand_sql(column: str) -> str:
    """Every rule runs twice, as neighbouring hits share the character between them."""
    out = f"lower({column})"
    for short, long in values.ABBREVIATIONS:
        if short != long:
            for _ in range(2):
                out = rf"regexp_replace({out}, '(^|{NOT_WORD}){short}({NOT_WORD}|$)', '\1{long}\2', 'g')"
    return f"trim({out}, {BLANKS})"


def default_sql(column: str, default: str = "unknown") -> str:
    return f"CASE WHEN trim(coalesce({column}, ''), {BLANKS}) = '' THEN '{default}' ELSE trim({column}, {BLANKS}) END"


def deid_sql(column: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({column}, '_{{2,}}', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'), {BLANKS})"


def ladder_sql(branches, default: str | None) -> str:
    cases = " ".join(f"WHEN {test} THEN '{label}'" for test, label in branches)
    return f"CASE {cases} ELSE {literal(default) if default else 'NULL'} END"


# rules on words that occur in the test texts
DOC_RULES = [("thatin", "alpha"), ("edtion", "beta"), ("rewh", "beta"), ("and the", "gamma"), ("une", "delta"), ("ha", "epsilon"), ("der", "zeta")]
DOC_GROUPS = [("first", ["inoran", "hehely"]), ("second", ["that the", "Ungie", "éa"]), ("third", ["ing ", "nicht"]), ("fourth", ["la"])]
PART_RULES = [("red widget", "BUILDING"), ("hot ring", "MACHINERY"), ("large rod", "FURNITURE"), ("old", "HOUSEHOLD"), ("small gear", "BUILDING")]
PART_GROUPS = [("AUTOMOBILE", ["blue"]), ("Flat", ["plate", "ring"]), ("Cold", ["cold anvil", "cold g"])]
PART_FIXES = [("widget", "BUILDING"), ("rod", "FURNITURE"), ("plate", "Flat"), ("gear", "BUILDING")]

DOC_RULES_SQL = ladder_sql([(word_sql("text", p), label) for p, label in DOC_RULES], None)
DOC_GROUPS_SQL = ladder_sql(
    [(" OR ".join(f"contains(lower(text), '{n}')" for n in needles), label) for label, needles in DOC_GROUPS], OTHER
)


@query("expand_abbrev", f"SELECT doc_id, {expand_sql('text')} AS expanded FROM documents WHERE text IS NOT NULL")
def _(spark, sf):
    return complaints.expanded(load(spark, sf, "documents"), "text").select("doc_id", F.col("text_expanded").alias("expanded"))


@query("expand_sample", f"SELECT doc_id, text, {expand_sql('text')} AS expanded FROM documents WHERE regexp_matches(lower(text), 'thha|rewh') ORDER BY doc_id LIMIT 10")
def _(spark, sf):
    hits = load(spark, sf, "documents").filter(F.lower("text").rlike("thha|rewh")).select("doc_id", "text")
    sample = aggregates.top_k(hits, 10, F.col("doc_id"))
    return sample.withColumn("expanded", tx.expand_abbreviations(F.col("text"), values.ABBREVIATIONS))


@query("default_text", sql_with(["notes"], f"SELECT doc_id, {default_sql('raw')} AS text FROM notes"))
def _(spark, sf):
    return role(spark, sf, "notes").select("doc_id", tx.default_text(F.col("raw")).alias("text"))


CLEAN_SQL = f"SELECT doc_id, topic, raw, {default_sql('raw')} AS first FROM notes"


@query("deid_clean", sql_with(
    ["notes"], f"SELECT doc_id, CASE WHEN {deid_sql('first')} = '' THEN 'unknown' ELSE {deid_sql('first')} END AS text FROM c", {"c": CLEAN_SQL}))
def _(spark, sf):
    return complaints.prepared(role(spark, sf, "notes").drop("text"), "raw", "text").select("doc_id", "text")


@query("cleaning_counts", sql_with(
    ["notes"],
    f"SELECT count(*) AS n, count(*) FILTER (trim(coalesce(raw, '')) = '') AS n_blank, "
    f"count(*) FILTER ({deid_sql('first')} <> first) AS n_changed, count(*) FILTER ({deid_sql('first')} = '') AS n_emptied FROM c",
    {"c": CLEAN_SQL}))
def _(spark, sf):
    return complaints.preparation_counts(role(spark, sf, "notes"), "raw")


KEYWORDS = "CASE WHEN p_partkey % 5 = 0 THEN '___, __ , ' WHEN p_partkey % 5 = 1 THEN concat(p_name, ', ___, ', p_type) ELSE concat('__', p_brand, ' , ', p_name, ',  ') END"


@query("keyword_clean", f"""
    WITH w AS (SELECT p_partkey, unnest(string_split({KEYWORDS}, ',')) AS w, generate_subscripts(string_split({KEYWORDS}, ','), 1) AS i FROM part),
         k AS (SELECT p_partkey, string_agg(v, ', ' ORDER BY i) FILTER (v <> '') AS keywords
               FROM (SELECT p_partkey, i, {deid_sql('w')} AS v FROM w) GROUP BY 1)
    SELECT p_partkey, coalesce(keywords, 'general') AS keywords FROM k""")
def _(spark, sf):
    return load(spark, sf, "part").select("p_partkey", tx.clean_keywords(F.expr(KEYWORDS)).alias("keywords"))


@query("substring_rules", f"SELECT doc_id, {DOC_GROUPS_SQL} AS label FROM documents")
def _(spark, sf):
    return spread(load(spark, sf, "documents")).select(
        "doc_id", substring_label(F.col("text"), DOC_GROUPS, OTHER, fold_case=True).alias("label")
    )


@query("regex_override", f"SELECT doc_id, {DOC_RULES_SQL} AS label FROM documents")
def _(spark, sf):
    return spread(load(spark, sf, "documents")).select("doc_id", word_label(F.col("text"), DOC_RULES).alias("label"))


@query("override_vocabularies", f"""
    SELECT stay_id, {ladder_sql([(word_sql('t', p), label) for p, label in values.ROW_OVERRIDES], None)} AS label,
           {ladder_sql([(word_sql('t', p), label) for p, label in values.SWEEP_OVERRIDES], OTHER)} AS sweep_label
    FROM (SELECT doc_id AS stay_id, {expand_sql('text')} AS t FROM documents)""")
def _(spark, sf):
    docs = spread(load(spark, sf, "documents")).select(
        F.col("doc_id").alias("stay_id"), tx.expand_abbreviations(F.col("text"), values.ABBREVIATIONS).alias("t")
    )
    return docs.select(
        "stay_id",
        word_label(F.col("t"), values.ROW_OVERRIDES).alias("label"),
        word_label(F.col("t"), values.SWEEP_OVERRIDES, OTHER).alias("sweep_label"),
    )


@query("literal_filter", "SELECT conv_id, turn FROM conversations WHERE contains(text, 'tion') OR contains(text, '.*')")
def _(spark, sf):
    text = F.col("text")
    return load(spark, sf, "conversations").filter(text.contains("tion") | text.contains(".*")).select("conv_id", "turn")


@query("regex_filter", "SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, 'tion|[ew]h')")
def _(spark, sf):
    return load(spark, sf, "conversations").filter(F.col("text").rlike("tion|[ew]h")).select("conv_id", "turn")


MODES_SQL = """
    SELECT topic, v, n, row_number() OVER (PARTITION BY topic ORDER BY n DESC, v) AS rn
    FROM (SELECT p_size AS topic, p_name AS v, count(*) AS n FROM part GROUP BY 1, 2)"""


@query("modal_text", f"SELECT topic, v AS p_name, n, CAST(rn AS INT) AS rank FROM ({MODES_SQL}) WHERE rn <= 5")
def _(spark, sf):
    return aggregates.modal_values(load(spark, sf, "part").withColumnRenamed("p_size", "topic"), "topic", "p_name", 5)


@query("joined_modes", f"SELECT topic, string_agg(v, ' | ' ORDER BY rn) AS sample_text FROM ({MODES_SQL}) WHERE rn <= 10 GROUP BY topic")
def _(spark, sf):
    parts = load(spark, sf, "part").withColumnRenamed("p_size", "topic")
    return aggregates.joined_modes(parts, "topic", "p_name", 10, " | ", "sample_text")


PART_STRONG = ladder_sql([(word_sql("{0}", p).replace("{0}", "sample_text"), label) for p, label in PART_RULES], None)
PART_ROW = ladder_sql([(word_sql("chiefcomplaint_proc", p), label) for p, label in PART_RULES], None)
PART_RULE = ladder_sql([(" OR ".join(f"contains(sample_text, '{n}')" for n in needles), label) for label, needles in PART_GROUPS], None)
TOPIC_LABEL_SQL = f"""
    SELECT cc_topic, coalesce(s, r, '{OTHER}') AS topic_label,
           CASE WHEN s IS NOT NULL THEN 'high' WHEN r IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence
    FROM (SELECT cc_topic, {PART_STRONG} AS s, {PART_RULE} AS r FROM (
            SELECT cc_topic, lower(string_agg(v, ' | ' ORDER BY n DESC, v)) AS sample_text FROM (
              SELECT *, row_number() OVER (PARTITION BY cc_topic ORDER BY n DESC, v) AS rn FROM (
                SELECT cc_topic, chiefcomplaint_proc AS v, count(*) AS n FROM topics WHERE cc_topic <> -1 GROUP BY 1, 2))
            WHERE rn <= 10 GROUP BY 1))"""
RELABEL_SQL = f"""
    SELECT t.subject_id, t.stay_id, t.chiefcomplaint_proc, t.cc_topic, t.cc_keywords, t.cc_system AS cc_system_orig,
           coalesce({PART_ROW}, l.topic_label, '{OTHER}') AS cc_system,
           CASE WHEN t.cc_topic = -1 THEN 'noise' ELSE coalesce(l.confidence, 'low') END AS cc_system_confidence
    FROM topics t LEFT JOIN labels_by_topic l ON l.cc_topic = t.cc_topic"""
RELABEL = {"labels_by_topic": TOPIC_LABEL_SQL, "fixed": RELABEL_SQL}


def relabelled(spark, sf):
    return relabel(role(spark, sf, "topics"), "cc_topic", "chiefcomplaint_proc", "cc_system", PART_RULES, PART_GROUPS)


@query("topic_confidence", sql_with(["topics"], TOPIC_LABEL_SQL))
def _(spark, sf):
    return topic_labels(role(spark, sf, "topics"), "cc_topic", "chiefcomplaint_proc", PART_RULES, PART_GROUPS)


@query("relabel", sql_with(["topics"], "SELECT * FROM fixed", RELABEL))
def _(spark, sf):
    return relabelled(spark, sf)


@query("changed_rows", sql_with(["topics"], "SELECT stay_id, cc_system_orig, cc_system FROM fixed WHERE cc_system <> cc_system_orig", RELABEL))
def _(spark, sf):
    return relabelled(spark, sf).filter(F.col("cc_system") != F.col("cc_system_orig")).select(
        "stay_id", "cc_system_orig", "cc_system"
    )


@query("change_rate", sql_with(
    ["topics"],
    "SELECT count(*) AS n, count(*) FILTER (cc_system <> cc_system_orig) AS n_changed, "
    "round(count(*) FILTER (cc_system <> cc_system_orig) / count(*) * 100, 6) AS percent FROM fixed", RELABEL))
def _(spark, sf):
    changed = F.count_if(F.col("cc_system") != F.col("cc_system_orig"))
    return relabelled(spark, sf).agg(
        F.count("*").alias("n"), changed.alias("n_changed"), F.round(changed / F.count("*") * 100, 6).alias("percent")
    )


@query("label_shift", sql_with(
    ["topics"],
    "SELECT coalesce(b.label, a.label) AS label, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after, "
    "coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM (SELECT cc_system_orig AS label, count(*) AS n FROM fixed GROUP BY 1) b "
    "FULL JOIN (SELECT cc_system AS label, count(*) AS n FROM fixed GROUP BY 1) a ON a.label = b.label", RELABEL))
def _(spark, sf):
    return label_shift(relabelled(spark, sf), "cc_system_orig", "cc_system")


@query("known_fixes", sql_with(
    ["topics"],
    " UNION ALL ".join(
        f"SELECT '{p}' AS phrase, '{w}' AS label, count(*) AS n FROM fixed "
        f"WHERE regexp_matches(chiefcomplaint_proc, '{p}') AND cc_system = '{w}'" for p, w in PART_FIXES
    ), RELABEL))
def _(spark, sf):
    return aggregates.known_fixes(relabelled(spark, sf), "chiefcomplaint_proc", "cc_system", PART_FIXES)


@query("label_counts_ranked", sql_with(["topics"], "SELECT cc_system, count(*) AS n FROM fixed GROUP BY 1 ORDER BY n DESC, 1", RELABEL))
def _(spark, sf):
    return aggregates.group_counts(relabelled(spark, sf), "cc_system").orderBy(F.col("n").desc(), "cc_system")


@query("commonest_labels", sql_with(["topics"], "SELECT cc_topic, count(*) AS n FROM topics WHERE cc_topic <> -1 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3"))
def _(spark, sf):
    counts = aggregates.group_counts(role(spark, sf, "topics").filter("cc_topic <> -1"), "cc_topic")
    return aggregates.top_k(counts, 3, F.col("n").desc(), F.col("cc_topic"))
