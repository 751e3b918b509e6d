"""Declared schemas of the domain tables.

Stage files are read with these schemas, so a column never changes its type
between stages, however few distinct values it holds.
"""

from pyspark.sql import types as T

from pairbench.constants import SECTION_HEADERS


def _schema(*groups):
    return T.StructType(
        [T.StructField(name, dtype, True) for dtype, names in groups for name in names.split()]
    )


_LONG, _INT, _TEXT = T.LongType(), T.IntegerType(), T.StringType()
_TIME, _REAL = T.TimestampNTZType(), T.DoubleType()

VISITS = _schema(
    (_LONG, "person_id ed_visit_occurrence_id person_id2 agekey agekeyvalue "
            "admission_visit_occurrence_id visit_occurrence_id"),
    (_TIME, "arrival_datetime admissiondecision_datetime departure_datetime disposition_datetime"),
    (_TEXT, "departmentname departmentspecialty admissiondepartmentname "
            "admissiondepartmentspecialty eddisposition dischargedisposition acuitylevel"),
)
PATIENTS = _schema((_LONG, "person_id"), (_TEXT, "sex ethnicity firstrace multiracial"))
DURATIONS = _schema((_LONG, "durationkey"), (_INT, "days"))
NOTE_METADATA = _schema(
    (_LONG, "person_id deid_note_key visit_occurrence_id"),
    (_TEXT, "note_type encounter_type enc_dept_name enc_dept_specialty auth_prov_type prov_specialty"),
    (_TIME, "deid_service_date"),
)
NOTE_TEXT = _schema((_LONG, "deid_note_key"), (_TEXT, "note_text"))
CARE_SITES = _schema((_LONG, "care_site_id location_id"))
LOCATIONS = _schema((_LONG, "location_id"), (_TEXT, "location_source_value"))

# Visit columns that stay in the cohort next to the note columns.
COHORT_VISIT_COLUMNS = [
    "person_id", "ed_visit_occurrence_id", "person_id2", "admission_visit_occurrence_id",
    "visit_occurrence_id", "arrival_datetime", "admissiondecision_datetime",
    "departure_datetime", "disposition_datetime", "departmentname", "departmentspecialty",
    "admissiondepartmentname", "admissiondepartmentspecialty", "eddisposition", "acuitylevel",
    "sex", "ethnicity", "firstrace", "multiracial", "days", "edvisit_age",
]
DEMOGRAPHIC_COLUMNS = ["sex", "ethnicity", "firstrace", "multiracial"]

PAIRS = _schema(
    (_INT, "pair_class"),
    (_LONG, "slot"),
    (_TEXT, "visit_occurrence_id_A acuitylevel_A history_text_A"),
    (_INT, "seed_A"),
    (_TEXT, "visit_occurrence_id_B acuitylevel_B history_text_B"),
    (_INT, "seed_B"),
    (_TEXT, "visit_occurrence_id_combined acuitylevel_combined"),
    (_INT, "acuitylevel_int_A acuitylevel_int_B"),
    (_TEXT, "prompt"),
    (_INT, "prompt_tokens acuity_level_int_BminusA"),
    (_TEXT, "higher_acuity_patient shuffle_key"),
)
RESPONSES = _schema((_TEXT, "visit_occurrence_id_combined prompt response_json"))
ANNOTATIONS = _schema((_TEXT, "visit_occurrence_id_combined rater_label rater_label_binary"))
PREPARED_FLAGS = list(SECTION_HEADERS)
