"""Reading source tables: CSV with fixed schemas and null tokens, Parquet with a projection."""

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import NULL_TOKENS, null_tokens, to_number
from tidemark.functions.times import parse_timestamp
from tidemark.operators.running import with_running

# Columns and types of the source tables.
SCHEMAS = {
    "edstays": "subject_id long, hadm_id long, stay_id long, intime timestamp_ntz, outtime timestamp_ntz, "
    "disposition string, gender string, race string, arrival_transport string",
    "patients": "subject_id long, anchor_age long, anchor_year long",
    "triage": "subject_id long, stay_id long, acuity double, pain string, chiefcomplaint string",
    "vitalsign": "stay_id long, charttime timestamp_ntz, sbp double, dbp double, heartrate double, "
    "resprate double, o2sat double, temperature double",
    "labevents": "subject_id long, itemid long, charttime timestamp_ntz, valuenum double, valueuom string",
    "d_labitems": "itemid long, label string",
    "admissions": "hadm_id long, hospital_expire_flag long",
    "icustays": "hadm_id long, intime timestamp_ntz",
    "procedureevents": "subject_id long, itemid long, starttime timestamp_ntz",
    "inputevents": "subject_id long, itemid long, starttime timestamp_ntz",
}

# tables with typed-in text, whose fields may hold line ends
FREE_TEXT = {"triage"}


def fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(f.split()) for f in schema.split(",")]


def _file_system(spark: SparkSession, place: str):
    """(Hadoop file system, path) of a file or folder, local or not."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, place: str) -> bool:
    system, path = _file_system(spark, place)
    return system.exists(path)


def files_below(spark: SparkSession, folder: str) -> Iterator[str]:
    system, path = _file_system(spark, folder)
    if system.exists(path):
        found = system.listFiles(path, True)
        while found.hasNext():
            yield found.next().getPath().toString()


def find_table(spark: SparkSession, name: str, folders: list[str]) -> str:
    """Path of ``<name>.csv`` or ``<name>.csv.gz`` below the first folder that has one; folders on any file system."""
    for folder in folders:
        found = sorted(p for p in files_below(spark, folder) if p.rsplit("/", 1)[1] in (f"{name}.csv", f"{name}.csv.gz"))
        if found:
            return found[0]
    raise FileNotFoundError(f"no {name}.csv or {name}.csv.gz in {', '.join(map(str, folders))}")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(record): the records of CSV files without their header lines, where quoted fields may hold line ends.

    A file is read in as many byte ranges as Spark cuts it into. A line with
    an odd number of quotes opens or closes a record of several lines; whether
    one is open at the start of a range follows from the odd lines of the
    ranges before it, a small aggregate. Only lines of such records are
    gathered, by record. Line ends within a record become a line feed; empty
    lines between records are no records; an open quote at the end of a file
    closes there. Quotes must be in quoted fields, doubled, and the header
    must be one line.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.regexp_replace("value", "\r$", "").alias("line"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    odd = (F.char_length("line") - F.char_length(F.replace("line", F.lit('"')))) % 2
    marked = with_running(
        lines.withColumn("odd", odd.cast("long")), "block", [F.col("at")],
        {"odds": F.col("odd"), "number": F.lit(1).cast("long")}, ["file"],
    ).filter("number > 1")
    several = "odd = 1 OR odds % 2 = 1"
    joined = marked.filter(several).groupBy("file", F.expr("(odds + 1) DIV 2").alias("record")).agg(
        F.array_sort(F.collect_list(F.struct("number", "line"))).alias("parts")
    )
    whole = joined.select(F.array_join("parts.line", "\n").alias("record"))
    return marked.filter(f"NOT ({several}) AND line != ''").select(F.col("line").alias("record")).union(whole)


def typed(raw: DataFrame, schema: str, tokens=NULL_TOKENS) -> DataFrame:
    """Cast string columns; null tokens and values that do not parse become null."""
    columns = []
    for name, kind in fields(schema):
        text = null_tokens(F.col(name), tokens)
        if kind == "timestamp_ntz":
            text = parse_timestamp(text)
        elif kind == "long":
            # whole numbers may be written with a fraction ("20.0")
            text = F.coalesce(to_number(text, "long"), to_number(to_number(text), "long"))
        elif kind != "string":
            text = to_number(text, kind)
        columns.append(text.alias(name))
    return raw.select(*columns)


def read_csv(spark: SparkSession, path: str, schema: str, tokens=NULL_TOKENS, multi_line: bool = False) -> DataFrame:
    """CSV with a header, read as text by column name and then cast.

    ``multi_line`` is for tables whose quoted fields may hold line ends; their
    records are put together by ``csv_records``, many tasks to a file.
    """
    header = spark.read.option("header", True).option("escape", '"').csv(path)
    if multi_line:
        kinds = ", ".join(f"`{c.replace('`', '``')}` string" for c in header.columns)
        record = F.from_csv("record", F.lit(kinds), {"escape": '"'})
        header = csv_records(spark, path).select(record.alias("r")).select("r.*")
    return typed(header, schema, tokens)


def ensure_parquet(spark: SparkSession, name: str, folders: list[str], out: str, partitions: int | None = None) -> str:
    """Convert a table to Parquet once and return the Parquet path.

    A gzip file is read by one task, so its rows are spread before writing.
    """
    target = f"{out}/{name}.parquet"
    if exists(spark, f"{target}/_SUCCESS"):
        return target
    path = find_table(spark, name, folders)
    rows = read_csv(spark, path, SCHEMAS[name], multi_line=name in FREE_TEXT)
    if path.endswith(".gz"):
        rows = rows.repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.write.mode("overwrite").parquet(target)
    return target


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan; the projection reaches the reader."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def register(views: dict[str, DataFrame]) -> None:
    """Make tables available to spark.sql under distinct names."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
