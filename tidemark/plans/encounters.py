"""Source tables to analysis tables: cohort, labels, window features, outcomes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import clinical_values as values
from tidemark.functions.scalars import admission_label, any_flag, clip_upper, measured, to_number
from tidemark.functions.times import hours_to_seconds
from tidemark.operators.aggregates import prevalence
from tidemark.operators.columns import exclude_matching
from tidemark.operators.intervals import (
    first_in_window,
    flag_within,
    interval_join,
    window_extremes,
    windowed_first_values,
)
from tidemark.operators.joins import lookup_left
from tidemark.operators.rules import like_ladder
from tidemark.session import cut_lineage

FLAGS = ["icu_24h", "vent_24h", "pressor_24h", "death_hosp"]


def window_seconds(windows: dict[str, float]) -> dict[str, int]:
    return {label: hours_to_seconds(h) for label, h in windows.items()}


def cohort(edstays: DataFrame, patients: DataFrame, triage: DataFrame, subgroups=values.COHORT_SUBGROUPS) -> DataFrame:
    """Stays with a known patient and an accepted subgroup."""
    accepted = triage.filter(F.col("cc_system").isin(list(subgroups))).select(
        "subject_id", "stay_id", "cc_system", "chiefcomplaint_proc"
    )
    stays = edstays.withColumnsRenamed({"intime": "ed_intime", "outtime": "ed_outtime"})
    return stays.join(patients.select("subject_id", "anchor_age"), "subject_id").join(
        accepted, ["subject_id", "stay_id"]
    )


def cohort_labels(base: DataFrame, admissions: DataFrame) -> DataFrame:
    """Admit-or-expire label; many stays have no admission id, so null keys are spread."""
    joined = lookup_left(base, admissions.select("hadm_id", "hospital_expire_flag"), "hadm_id", "stay_id")
    label = admission_label(F.col("hadm_id"), F.col("hospital_expire_flag"), F.col("disposition"))
    return joined.select(*[F.col(c) for c in base.columns], label.alias("target_admit_or_expire"))


def vitals_summary(stays: DataFrame, vitals: DataFrame, windows=values.WINDOW_HOURS,
                   grace=values.GRACE_HOURS, key: str = "stay_id") -> DataFrame:
    """Minimum and maximum vitals per stay and window."""
    numbers = {c: F.col(c) for c in ("sbp", "heartrate", "resprate", "o2sat", "temperature")}
    return window_extremes(
        stays, vitals, "stay_id", key, "ed_intime", "charttime", hours_to_seconds(grace), window_seconds(windows),
        minima={"sbp_min": numbers["sbp"], "heartrate_min": numbers["heartrate"], "o2sat_min": numbers["o2sat"]},
        maxima={
            "sbp_max": numbers["sbp"], "heartrate_max": numbers["heartrate"],
            "resprate_max": numbers["resprate"], "temperature_max": numbers["temperature"],
        },
    ).drop("n_events")


def known_labs(labevents: DataFrame, d_labitems: DataFrame, categories=values.LAB_CATEGORIES) -> DataFrame:
    """Lab rows of a known category with a value; items are classified before they meet the events."""
    items = d_labitems.select(
        "itemid", F.col("label").alias("lab_name"),
        like_ladder(F.col("label"), [(n, c) for n, c, _ in categories]).alias("lab_category"),
    ).filter(F.col("lab_category") != "Other")
    return labevents.filter(F.col("valuenum").isNotNull()).join(items, "itemid")


def labs_in_window(stays: DataFrame, labs: DataFrame, hours: float, grace=values.GRACE_HOURS) -> DataFrame:
    """Every lab row within the window of every stay of its subject."""
    return interval_join(
        stays.select("subject_id", "stay_id", "ed_intime"), labs, "subject_id", "ed_intime", "charttime",
        hours_to_seconds(grace), hours_to_seconds(hours),
    ).select("stay_id", "subject_id", "itemid", "lab_name", "charttime", "valuenum", "valueuom", "lab_category")


def first_labs(stays: DataFrame, labs: DataFrame, windows=values.WINDOW_HOURS, grace=values.GRACE_HOURS,
               categories=values.LAB_CATEGORIES, flags=values.MEASURED_FLAGS) -> DataFrame:
    """First value per stay, window and category, wide, with measured flags.

    One pass at the widest window serves all windows. A stay without any lab of
    a known category in the window has no row, so its flags stay null after the
    left join.
    """
    widths = window_seconds(windows)
    found = first_in_window(
        stays, labs, "stay_id", "subject_id", "ed_intime", "charttime", "itemid", "lab_category",
        [c for _, c, _ in categories], hours_to_seconds(grace), max(widths.values()), "valuenum",
    )
    names = [n for _, _, n in categories]
    wide = windowed_first_values(found, stays, "stay_id", "ed_intime", names, widths)
    return wide.filter("has_event").drop("has_event").select(
        "*", *[measured(F.col(n)).alias(f"{n}_measured") for n in flags if n in names]
    )


def masters(base: DataFrame, vitals: DataFrame, triage: DataFrame, topics: DataFrame, labs: DataFrame,
            windows=values.WINDOW_HOURS) -> DataFrame:
    """One row per stay and window with all attributes; partition by ``time_window`` when written."""
    labels = F.explode(F.array(*[F.lit(w) for w in windows])).alias("time_window")
    arrival = triage.select(
        "stay_id", F.col("acuity").alias("triage_acuity"), F.col("pain").alias("triage_pain")
    )
    return (
        base.join(arrival, "stay_id", "left")
        .join(topics.select("stay_id", "cc_topic", "cc_keywords"), "stay_id", "left")
        .select("*", labels)
        .join(vitals, ["stay_id", "time_window"], "left")
        .join(labs, ["stay_id", "time_window"], "left")
    )


def outcomes(base: DataFrame, icustays: DataFrame, procedureevents: DataFrame, inputevents: DataFrame,
             admissions: DataFrame, vent_items=values.VENTILATION_ITEMS, pressor_items=values.PRESSOR_ITEMS,
             hours=values.OUTCOME_HOURS) -> DataFrame:
    """Four components within ``hours`` of arrival (death without a limit) and their union.

    "Any event in the window" is "the next event at or after arrival is in the
    window", so no stay is paired with all events of its subject.
    """
    stays = base.select("subject_id", "stay_id", "hadm_id", "ed_intime")
    span = hours_to_seconds(hours)

    def starts(df, items, kind):
        return df.filter(F.col("itemid").isin(list(items))).select(
            "subject_id", "starttime", F.lit(kind).alias("kind"), F.lit(0).alias("tie")
        )

    by_subject = starts(procedureevents, vent_items, "vent").unionByName(
        starts(inputevents, pressor_items, "pressor")
    )
    treated = first_in_window(
        stays, by_subject, "stay_id", "subject_id", "ed_intime", "starttime", "tie", "kind",
        ["vent", "pressor"], 0, span,
    )
    icu = icustays.select("hadm_id", "intime", F.lit("icu").alias("kind"), F.lit(0).alias("tie"))
    moved = first_in_window(
        stays, icu, "stay_id", "hadm_id", "ed_intime", "intime", "tie", "kind", ["icu"], 0, span
    )
    deaths = admissions.groupBy("hadm_id").agg(
        F.max(F.when(F.col("hospital_expire_flag") == 1, 1).otherwise(0)).alias("death_hosp")
    )
    flags = (
        lookup_left(stays.select("stay_id", "hadm_id"), deaths, "hadm_id", "stay_id")
        .join(moved.select("stay_id", flag_within(moved, "c0").alias("icu_24h")), "stay_id")
        .join(
            treated.select(
                "stay_id", flag_within(treated, "c0").alias("vent_24h"),
                flag_within(treated, "c1").alias("pressor_24h"),
            ),
            "stay_id",
        )
        .withColumn("death_hosp", F.coalesce("death_hosp", F.lit(0)))
    )
    return flags.select(
        "stay_id", "hadm_id", *FLAGS, any_flag([F.col(c) for c in FLAGS]).alias("early_critical_illness")
    )


def outcome_prevalence(outcome: DataFrame) -> DataFrame:
    return prevalence(outcome, [*FLAGS, "early_critical_illness"])


def finalize(master: DataFrame, outcome: DataFrame, caps=values.OUTLIER_CAPS) -> DataFrame:
    """Analysis table: outcome joined, older label dropped, outliers clipped."""
    target = outcome.select(
        to_number(F.col("stay_id"), "long").alias("stay_id"), "early_critical_illness", "icu_24h", "death_hosp"
    )
    joined = master.drop("target_admit_or_expire").join(target, "stay_id")
    clipped = joined.withColumns({c: clip_upper(F.col(c), cap) for c, cap in caps.items() if c in joined.columns})
    return exclude_matching(clipped, r"^.*_right$")


def analysis_tables(tables: dict[str, DataFrame], subgroups=values.COHORT_SUBGROUPS, windows=values.WINDOW_HOURS,
                    categories=values.LAB_CATEGORIES, vent_items=values.VENTILATION_ITEMS,
                    pressor_items=values.PRESSOR_ITEMS, vital_key: str = "stay_id") -> DataFrame:
    """The whole way from source tables to one analysis row per stay and window.

    The labelled cohort is stored once: seven steps start from it, and its known
    size decides how each of them joins.
    """
    base = cut_lineage(
        cohort_labels(cohort(tables["edstays"], tables["patients"], tables["topics"], subgroups), tables["admissions"])
    )
    labs = known_labs(tables["labevents"], tables["d_labitems"], categories)
    master = masters(
        base,
        vitals_summary(base, tables["vitalsign"], windows, key=vital_key),
        tables["triage"], tables["topics"],
        first_labs(base, labs, windows, categories=categories),
        windows,
    )
    outcome = outcomes(
        base, tables["icustays"], tables["procedureevents"], tables["inputevents"], tables["admissions"],
        vent_items, pressor_items,
    )
    return finalize(master, outcome)
