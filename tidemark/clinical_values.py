"""Word lists, codes and cut-offs that results depend on.

They are defaults of the job functions only; every operator takes its own rules
as parameters. Long label vocabularies (substring groups) are no constants:
load them with ``sources.rules.read_rule_groups``.
"""


# abbreviation = expansion, applied in this order.
ABBREVIATIONS = [
    ("cp", "chest pain"),
    ("chf", "congestive heart failure"),
    ("afib", "atrial fibrillation"),
    ("cad", "coronary artery disease"),
    ("palps", "palpitations"),
    ("sob", "shortness of breath"),
    ("doe", "dyspnea on exertion"),
    ("copd", "chronic obstructive pulmonary disease"),
    ("uri", "upper respiratory infection"),
    ("pna", "pneumonia"),
    ("pe", "pulmonary embolism"),
    ("cough", "cough"),
    ("abd", "abdominal"),
    ("n/v", "nausea and vomiting"),
    ("n/v/d", "nausea vomiting and diarrhea"),
    ("gib", "gastrointestinal bleed"),
    ("ruq", "right upper quadrant"),
    ("luq", "left upper quadrant"),
    ("rlq", "right lower quadrant"),
    ("llq", "left lower quadrant"),
    ("ams", "altered mental status"),
    ("h/a", "headache"),
    ("ha", "headache"),
    ("si", "suicidal ideation"),
    ("hi", "homicidal ideation"),
    ("sz", "seizure"),
    ("cva", "cerebrovascular accident"),
    ("tia", "transient ischemic attack"),
    ("loc", "loss of consciousness"),
    ("od", "overdose"),
    ("etoh", "alcohol"),
    ("sah", "subarachnoid hemorrhage"),
    ("mva", "motor vehicle accident"),
    ("mvc", "motor vehicle collision"),
    ("glf", "ground level fall"),
    ("lle", "left lower extremity"),
    ("rle", "right lower extremity"),
    ("lue", "left upper extremity"),
    ("rue", "right upper extremity"),
    ("lbp", "low back pain"),
    ("fx", "fracture"),
    ("lac", "laceration"),
    ("lacs", "lacerations"),
    ("htn", "hypertension"),
    ("dka", "diabetic ketoacidosis"),
    ("uti", "urinary tract infection"),
    ("ss", "sickle cell"),
    ("fever", "fever"),
    ("med", "medication"),
    ("meds", "medications"),
    ("eval", "evaluation"),
    ("c/o", "complains of"),
    ("s/p", "status post"),
    ("r/o", "rule out"),
    ("hx", "history"),
    ("h/o", "history of"),
    ("f/u", "follow up"),
    ("fu", "follow up"),
    ("pt", "patient"),
]

# Whole phrase : label of the row override, first match decides.
ROW_OVERRIDES = [
    ("chest pain", "Cardiac"),
    ("chest pressure", "Cardiac"),
    ("shortness of breath", "Respiratory"),
    ("shortness breath", "Respiratory"),
    ("breath shortness", "Respiratory"),
    ("dyspnea", "Respiratory"),
    ("suicidal ideation", "Psychiatric/MH"),
    ("homicidal ideation", "Psychiatric/MH"),
    ("abdominal pain", "GI/Abdominal"),
    ("abd pain", "GI/Abdominal"),
    ("back pain", "Musculoskeletal"),
    ("headache", "Neurological"),
    ("seizure", "Neurological"),
    ("stroke", "Neurological"),
    ("syncope", "Neurological"),
    ("dizziness", "Neurological"),
    ("altered mental status", "Neurological"),
    ("subdural hematoma", "Neurological"),
    ("fall", "Trauma/Injury"),
    ("motor vehicle accident", "Trauma/Injury"),
    ("gastrointestinal bleeding", "GI/Abdominal"),
    ("vaginal bleeding", "Genitourinary"),
    ("flank pain", "Genitourinary"),
    ("hematuria", "Genitourinary"),
    ("urinary tract infection", "Genitourinary"),
    ("hyperglycemia", "Endocrine/Metabolic"),
    ("hypoglycemia", "Endocrine/Metabolic"),
    ("diabetic ketoacidosis", "Endocrine/Metabolic"),
    ("anemia", "Hematology/Oncology"),
    ("alcohol intoxication", "Substance/Tox"),
    ("drug overdose", "Substance/Tox"),
    ("fever", "Infectious"),
    ("rash", "Dermatological"),
    ("allergic reaction", "Dermatological"),
]

# Whole phrase : label used while sweeping cluster settings.
SWEEP_OVERRIDES = [
    ("chest pain", "Cardiac"),
    ("chest pressure", "Cardiac"),
    ("palpitation", "Cardiac"),
    ("tachycardia", "Cardiac"),
    ("shortness of breath", "Respiratory"),
    ("shortness breath", "Respiratory"),
    ("breath shortness", "Respiratory"),
    ("dyspnea", "Respiratory"),
    ("suicidal ideation", "Psychiatric/MH"),
    ("homicidal ideation", "Psychiatric/MH"),
    ("abdominal pain", "GI/Abdominal"),
    ("abd pain", "GI/Abdominal"),
    ("nausea", "GI/Abdominal"),
    ("vomiting", "GI/Abdominal"),
    ("diarrhea", "GI/Abdominal"),
    ("back pain", "Musculoskeletal"),
    ("neck pain", "Musculoskeletal"),
    ("knee pain", "Musculoskeletal"),
    ("shoulder pain", "Musculoskeletal"),
    ("leg pain", "Musculoskeletal"),
    ("arm pain", "Musculoskeletal"),
    ("hip pain", "Musculoskeletal"),
    ("headache", "Neurological"),
    ("seizure", "Neurological"),
    ("stroke", "Neurological"),
    ("syncope", "Neurological"),
    ("dizziness", "Neurological"),
    ("altered mental status", "Neurological"),
    ("subdural hematoma", "Neurological"),
    ("weakness", "Neurological"),
    ("numbness", "Neurological"),
    ("fall", "Trauma/Injury"),
    ("motor vehicle accident", "Trauma/Injury"),
    ("laceration", "Trauma/Injury"),
    ("fracture", "Trauma/Injury"),
    ("head injury", "Trauma/Injury"),
    ("assault", "Trauma/Injury"),
    ("burn", "Trauma/Injury"),
    ("gastrointestinal bleeding", "GI/Abdominal"),
    ("vaginal bleeding", "Genitourinary"),
    ("flank pain", "Genitourinary"),
    ("hematuria", "Genitourinary"),
    ("urinary tract infection", "Genitourinary"),
    ("pelvic pain", "Genitourinary"),
    ("testicular", "Genitourinary"),
    ("dysuria", "Genitourinary"),
    ("hyperglycemia", "Endocrine/Metabolic"),
    ("hypoglycemia", "Endocrine/Metabolic"),
    ("diabetic ketoacidosis", "Endocrine/Metabolic"),
    ("anemia", "Hematology/Oncology"),
    ("alcohol intoxication", "Substance/Tox"),
    ("drug overdose", "Substance/Tox"),
    ("overdose", "Substance/Tox"),
    ("fever", "Infectious"),
    ("sepsis", "Infectious"),
    ("cellulitis", "Infectious"),
    ("abscess", "Infectious"),
    ("rash", "Dermatological"),
    ("allergic reaction", "Dermatological"),
    ("eye pain", "ENT/Eye"),
    ("ear pain", "ENT/Eye"),
    ("sore throat", "ENT/Eye"),
    ("epistaxis", "ENT/Eye"),
    ("dental", "ENT/Eye"),
]

# Expected label per phrase in the relabelling report.
EXPECTED_FIXES = [
    ("chest pain", "Cardiac"),
    ("dyspnea", "Respiratory"),
    ("suicidal ideation", "Psychiatric/MH"),
    ("abdominal pain", "GI/Abdominal"),
    ("fall", "Trauma/Injury"),
    ("dizziness", "Neurological"),
    ("hyperglycemia", "Endocrine/Metabolic"),
    ("anemia", "Hematology/Oncology"),
]

# Subgroups that make up the cohort.
COHORT_SUBGROUPS = [
    "GI/Abdominal", "Cardiac", "Neurological", "Trauma/Injury", "Respiratory", "Musculoskeletal",
    "Psychiatric/MH", "Infectious", "Genitourinary", "Substance/Tox", "Dermatological",
    "Endocrine/Metabolic", "Hematology/Oncology",
]

# Critical phrases looked for in topic words.
TOPIC_PHRASES = [
    "chest pain", "back pain", "dizziness", "gastrointestinal bleeding", "stroke", "stroke symptoms",
    "suicidal ideation", "shortness of breath", "seizure", "syncope", "fever", "abdominal pain",
]

# Critical phrases counted in the sweep.
SWEEP_PHRASES = [
    "chest pain", "back pain", "dizziness", "gastrointestinal bleeding", "stroke", "suicidal ideation",
    "shortness of breath", "seizure", "syncope", "fever", "abdominal pain", "headache",
]

# Stop words to keep, and domain words to add.
KEPT_STOP_WORDS = ["no", "not", "without", "before", "after", "during", "through", "under", "over"]
EXTRA_STOP_WORDS = [
    "patient", "pt", "presents", "present", "complains", "complained", "reports", "here", "seen", "evaluated",
    "evaluation", "eval", "rule", "out", "follow", "up", "status", "post", "history", "transfer", "admission",
]

# Lab label substring, category, output column; first match decides.
LAB_CATEGORIES = [
    ("white blood cells", "WBC", "wbc"),
    ("hemoglobin", "Hemoglobin", "hb"),
    ("platelet", "Platelet", "plt"),
    ("creatinine", "Creatinine", "cr"),
    ("sodium", "Sodium", "na"),
    ("potassium", "Potassium", "k"),
    ("bicarbonate", "Bicarbonate", "hco3"),
    ("lactate", "Lactate", "lactate"),
    ("glucose", "Glucose", "glucose"),
]
MEASURED_FLAGS = ["wbc", "hb", "plt", "cr", "lactate"]

# Item codes of the outcome components, and the folders searched.
VENTILATION_ITEMS = [225792]
PRESSOR_ITEMS = [221906, 221289, 221749, 221662, 222315, 221653]
SOURCE_FOLDERS = ["mimic/ed", "mimic/hosp", "mimic/icu", "mimic"]

# Windows in hours after arrival, grace before it, outlier caps, split year.
WINDOW_HOURS = {"0.5h": 0.5, "1h": 1.0, "2h": 2.0}
GRACE_HOURS = 0.25
OUTCOME_HOURS = 24.0
OUTLIER_CAPS = {"lactate": 30.0, "heartrate_max": 300.0}
SPLIT_YEAR = 2180

# Features of the models.
CATEGORICAL_FEATURES = ["gender", "race", "arrival_transport", "cc_system"]
NUMERIC_FEATURES = [
    "anchor_age", "triage_acuity", "triage_pain", "sbp_min", "sbp_max", "heartrate_max", "resprate_max",
    "o2sat_min", "temperature_max", "wbc", "hb", "plt", "cr", "na", "k", "hco3", "lactate", "glucose",
    "wbc_measured", "hb_measured", "plt_measured", "cr_measured", "lactate_measured",
]
ARRIVAL_FRAGMENTS = ["anchor_age", "triage_"]

# The swept cluster settings.
SWEEP_SIZES = [50, 75, 100, 125, 150, 175, 200, 250, 300, 400, 500, 600, 700]
SWEEP_SAMPLES = [3, 5, 7, 10, 15, 20, 25, 30, 40, 50, 60, 80, 100]
