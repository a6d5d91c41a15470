"""The relational job with its tables written: sources, cohort, masters, outcome, analysis."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark import clinical_values as values
from tidemark.plans import encounters
from tidemark.sources.sinks import write_table
from tidemark.sources.tables import SCHEMAS, ensure_parquet, exists


def stored(spark: SparkSession, path: str, build: Callable[[], DataFrame], partition_by=(), sort_by=()) -> DataFrame:
    """The table at ``path``, built and written first unless an earlier run has finished it.

    A table that a lost run left half written has no ``_SUCCESS`` file and is
    written again. A finished table is not compared with its inputs: to build
    it anew, use another folder or delete it.
    """
    if not exists(spark, f"{path}/_SUCCESS"):
        write_table(build(), path, partition_by, sort_by)
    return spark.read.parquet(path)


def build_analysis(
    spark: SparkSession, root: str, topics: DataFrame, out: str, folders=values.SOURCE_FOLDERS,
    subgroups=values.COHORT_SUBGROUPS, windows=values.WINDOW_HOURS, categories=values.LAB_CATEGORIES,
    vent_items=values.VENTILATION_ITEMS, pressor_items=values.PRESSOR_ITEMS,
) -> DataFrame:
    """From CSV files below ``root`` to the analysis table, one row per stay and window.

    ``topics`` has the relabelled text of each stay: subject_id, stay_id,
    chiefcomplaint_proc, cc_topic, cc_keywords and cc_system. Every step is a table below
    ``out``, on any file system, and a later run goes on after the last one
    that was finished; the analysis table has one folder per window.
    """
    places = [f"{root}/{f}" for f in folders]
    source = {n: spark.read.parquet(ensure_parquet(spark, n, places, f"{out}/sources")) for n in SCHEMAS}

    def cohort():
        chosen = encounters.cohort(source["edstays"], source["patients"], topics, subgroups)
        return encounters.cohort_labels(chosen, source["admissions"])

    base = stored(spark, f"{out}/cohort", cohort)

    def master():
        labs = encounters.known_labs(source["labevents"], source["d_labitems"], categories)
        return encounters.masters(
            base, encounters.vitals_summary(base, source["vitalsign"], windows), source["triage"], topics,
            encounters.first_labs(base, labs, windows, categories=categories), windows,
        )

    def outcome():
        return encounters.outcomes(
            base, source["icustays"], source["procedureevents"], source["inputevents"], source["admissions"],
            vent_items, pressor_items,
        )

    masters = stored(spark, f"{out}/master", master, ["time_window"])
    outcomes = stored(spark, f"{out}/outcome", outcome)
    return stored(
        spark, f"{out}/analysis", lambda: encounters.finalize(masters, outcomes), ["time_window"], ["stay_id"]
    )
