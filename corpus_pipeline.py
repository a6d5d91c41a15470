"""From raw documents to pieces: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. ``run`` writes each result as Parquet
into the folder named by ``spark.checkpoint.dir`` and goes on from there.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontam import with_leaks
from tidemark.llm.linededup import dedup_lines
from tidemark.llm.paritysketch import first_of_components
from tidemark.llm.pieces import encode_texts
from tidemark.llm.toxicity import score_toxicity
from tidemark.session import cut_lineage

MODEL = "piece_bpe_32k.model"
ORACLE_SQL = None  # a trained network decides the first stage


def _apart(docs: DataFrame) -> DataFrame:
    """Id, text and all columns as one, so that no column can clash with one of an operator."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network does not find toxic."""
    scored = score_toxicity(_apart(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.filter("predicted = 0").select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that an earlier one has; ``text`` and ``n_chars`` are those of what is left."""
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    kept = dedup_lines(docs.select("doc_id", "text", others.alias("row")))
    own = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return kept.select(*(own[c].alias(c) if c in own else F.col(f"row.`{c}`") for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8): that with the smallest id."""
    return first_of_components(docs, k=5, num=80, den=100)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = with_leaks(_apart(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_words=1)
    return found.filter(F.size("leaks") == 0).select("row.*")


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, their digests, and how many bytes of the text they cover."""
    outputs = ("n_tokens", "ids", "ids_sha256", "decoded_sha256", "covered_bytes")
    return encode_texts(docs, public_tokenizers.path(MODEL), outputs=outputs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("sentencepiece", to_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
