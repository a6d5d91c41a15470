"""Language of addressed texts: what the text says, fused with declared language, address suffix and host.

Text likelihoods are byte trigrams counted over all labelled texts. Their
posteriors, summed by grouped aggregation, give how often each language
declares what, has which suffix, and is on which host; hosts are smoothed by
their domain, and domains by the whole corpus. A row's own share is taken out
of its host's before it is judged.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.sent import sent
from tidemark.llm.words import raw, slices
from tidemark.session import cut_lineage

CODES = 1 << 16
MOST_LANGUAGES = 2048  # what the model may grow to; about 60 kB each when sent to tasks
AT_ONCE = 64  # languages whose counts a task or the driver holds side by side


def trigram_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all byte trigrams (A-Z lower-cased, blanks at both ends), and where each text's begin."""
    marked = [b" " + t.lower() + b"  " for t in texts]
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    codes = ((data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    starts = np.cumsum([0, *map(len, marked[:-1])])
    return codes, starts


def trigram_counts(labelled: DataFrame, label: str, text: str) -> DataFrame:
    """(label, code, n) over all rows with a label; tasks count before anything is shuffled."""

    def run(batches):
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                texts, labels = raw(part.column("text")), part.column("label").to_pylist()
                for name in set(labels):
                    codes, _ = trigram_codes([t for t, own in zip(texts, labels) if own == name])
                    seen[name] = seen.get(name, 0) + np.bincount(codes, minlength=CODES)
                    if len(seen) > AT_ONCE:
                        yield from told(seen)
                        seen = {}
        yield from told(seen)

    def told(seen):
        for name, counts in seen.items():
            codes = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(codes), pa.string()), pa.array(codes, pa.int32()), pa.array(counts[codes], pa.int64())],
                ["label", "code", "n"],
            )

    rows = labelled.select(F.col(label).alias("label"), F.col(text).alias("text")).filter("label is not null")
    return rows.mapInArrow(run, "label string, code int, n long").groupBy("label", "code").agg(F.sum("n").alias("n"))


def read_likelihoods(counts: DataFrame, smooth: float = 0.5) -> tuple[list[str], list[tuple]]:
    """Languages in order, and for each its seen codes, their log likelihoods and that of any other code."""
    counts = cut_lineage(counts)
    languages = [r[0] for r in counts.select("label").distinct().orderBy("label").limit(MOST_LANGUAGES + 1).collect()]
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    sparse = {}
    for k in range(0, len(languages), AT_ONCE):
        some = counts.filter(F.col("label").isin(languages[k : k + AT_ONCE])).toPandas()
        for name, own in some.groupby("label"):
            n = own["n"].to_numpy(np.float64)
            total = n.sum() + smooth * CODES
            known = np.log((n + smooth) / total).astype(np.float32)
            sparse[name] = own["code"].to_numpy(np.uint16), known, np.float32(np.log(smooth / total))
    return languages, [sparse[name] for name in languages]


def _dense(codes: np.ndarray, known: np.ndarray, other: np.float32) -> np.ndarray:
    out = np.full(CODES, other, np.float64)
    out[codes] = known
    return out


def _softmax(logs: np.ndarray) -> np.ndarray:
    e = np.exp(logs - logs.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def text_evidence(rows: DataFrame, likelihoods: list[tuple], temper: float) -> DataFrame:
    """``rows`` without ``text``, with ``said`` (tempered log likelihoods) and ``r`` (their posterior)."""
    model = sent(rows.sparkSession, likelihoods)
    others = [c for c in rows.columns if c != "text"]

    def run(batches):
        table = model()
        for batch in batches:
            for part in slices(batch):
                codes, starts = trigram_codes(raw(part.column("text")))
                said = np.stack([np.add.reduceat(_dense(*own)[codes], starts) for own in table], 1) * temper
                said -= said.max(1, keepdims=True)
                kinds = pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in others], pa.array(said.tolist(), kinds), pa.array(_softmax(said).tolist(), kinds)],
                    [*others, "said", "r"],
                )

    kept = rows.select(*others, "text")
    kinds = ", ".join(f"{n} {t}" for n, t in kept.dtypes[:-1])
    return kept.mapInArrow(run, f"{kinds}, said array<double>, r array<double>")


def page_text(html: Column) -> Column:
    """What a page shows: without scripts, styles, comments, tags and character references."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    return F.regexp_replace(bare, r"\s+", " ")


def declared_language(html: Column) -> Column:
    """Primary language of the root element, two or three letters, else null."""
    found = F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})(?![a-z])""", 1))
    return F.when(found != "", found)


def host_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^\w+://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def _summed(rows: DataFrame, by: list[str], size: int) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(F.col("r")[k]).alias(f"s{k}") for k in range(size)])


def fuse(evidence: DataFrame, languages: list[str], weight: float = 10.0, own: float = 1.0) -> DataFrame:
    """Adds ``lang`` and ``probability`` to rows (key, declared, suffix, host, domain, said, r)."""
    size = len(languages)
    spark = evidence.sparkSession
    total = evidence.agg(F.count(F.lit(1)), *[F.sum(F.col("r")[k]) for k in range(size)]).first()
    rows_in_all, mass = total[0], [x or 0.0 for x in total[1:]]
    prior = [(m + own) / (rows_in_all + own * size) for m in mass]
    out = evidence
    for name in ("declared", "suffix"):
        # P(value | language), smoothed by the share of the value among all rows
        told = _summed(evidence.filter(F.col(name).isNotNull()), [name], size)
        known = told.agg(F.sum("rows")).first()[0] or 1
        share = F.col("rows") / known
        logs = F.array(*[F.log((F.col(f"s{k}") + own * share) / (mass[k] + own)) for k in range(size)])
        out = out.join(told.select(name, logs.alias(f"by_{name}")), name, "left")
    hosts = _summed(evidence.filter("host is not null"), ["host", "domain"], size)
    domains = hosts.groupBy("domain").agg(F.sum("rows").alias("d_rows"), *[F.sum(f"s{k}").alias(f"d{k}") for k in range(size)])
    hosts = hosts.join(domains, "domain").select(
        "host", F.col("rows").alias("h_rows"), F.array(*[f"s{k}" for k in range(size)]).alias("h"), "d_rows", F.array(*[f"d{k}" for k in range(size)]).alias("d")
    )
    out = out.join(hosts, "host", "left")
    # the row itself tells nothing new about its host
    domain = [(F.greatest(F.col("d")[k] - F.col("r")[k], F.lit(0.0)) + weight * prior[k]) / (F.col("d_rows") - 1 + weight) for k in range(size)]
    host = [(F.greatest(F.col("h")[k] - F.col("r")[k], F.lit(0.0)) + weight * domain[k]) / (F.col("h_rows") - 1 + weight) for k in range(size)]
    logs = [
        F.col("said")[k]
        + F.coalesce(F.col("by_declared")[k], F.lit(0.0))
        + F.coalesce(F.col("by_suffix")[k], F.lit(0.0))
        + F.log(F.coalesce(host[k], F.lit(float(prior[k]))))
        for k in range(size)
    ]
    out = out.withColumn("_logs", F.array(*logs)).withColumn("_most", F.array_max("_logs"))
    odds = F.aggregate("_logs", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("_most")))
    names = F.array(*map(F.lit, languages))
    out = out.withColumns({"lang": F.get(names, (F.array_position("_logs", F.col("_most")) - 1).cast("int")), "probability": 1 / odds})
    return out.drop("_logs", "_most", "by_declared", "by_suffix", "h_rows", "h", "d_rows", "d")


def identify(rows: DataFrame, labelled: DataFrame, label: str = "lang", text: str = "text", temper: float = 0.1) -> DataFrame:
    """``rows`` (text, declared, url and any key columns) with ``lang`` and ``probability`` instead of the text.

    ``labelled`` gives the text likelihoods: all its rows with a label count.
    ``temper`` shrinks them, as neighbouring trigrams are not independent. A
    host that no address gives may come as column ``host``; its domain is the
    last two labels, its suffix the last.

    Null and empty texts say nothing, null declarations and addresses neither.
    Ties go to the first language in alphabetical order. Rows that repeat are
    judged each by itself. Without labelled rows, language and probability are
    null. Very long texts count whole. Up to ``MOST_LANGUAGES`` languages; more
    are an error. Key columns must not be named as the columns above.
    """
    languages, likelihoods = read_likelihoods(trigram_counts(labelled, label, text))
    keys = [c for c in rows.columns if c not in ("text", "declared", "url", "host")]
    if not languages:
        nothing = {"lang": F.lit(None).cast("string"), "probability": F.lit(None).cast("double")}
        return rows.select(*keys, "declared").withColumns(nothing)
    host = F.coalesce(F.col("host"), host_of(F.col("url"))) if "host" in rows.columns else host_of(F.col("url"))
    addressed = rows.select(*keys, "declared", host.alias("host"), "text")
    addressed = addressed.withColumns(
        {
            "suffix": F.when(F.instr("host", ".") > 0, F.element_at(F.split("host", r"\."), -1)),
            "domain": F.substring_index("host", ".", -2),
        }
    )
    evidence = cut_lineage(text_evidence(addressed, likelihoods, temper))
    return fuse(evidence, languages).select(*keys, "declared", "host", "lang", "probability")
