"""Levels, headers, prompt text and sentinels.

The strings below are part of the data contract (they occur in stored notes,
prompts and results), so they are spelled out as they are.
"""

from itertools import combinations

# Ordinal acuity levels, most acute first.
ACUITY_RANK = {
    "Immediate": 1,
    "Emergent": 2,
    "Urgent": 3,
    "Less Urgent": 4,
    "Non-Urgent": 5,
}
UNSPECIFIED_ACUITY = "*Unspecified"

# Every pair of distinct levels, the more acute level first; the position of a
# pair in this list is its pair class.
PAIR_LEVELS = list(combinations(ACUITY_RANK, 2))

# Cohort filters.
MIN_AGE_YEARS = 18
DAYS_PER_YEAR = 365.25
NOTE_TYPE = "ED Provider Notes"
SPECIALTIES = ("Emergency Medicine", "UCSF")

# Flag column -> header searched for in the note.
SECTION_HEADERS = {
    "history_chiefcomplaint": "History Chief Complaint",
    "chiefcomplaint": "Chief Complaint",
    "systemsreview": "Review of Systems",
    "physicalexam": "Physical Exam",
    "edcourse": "ED Course",
    "initialassessment": "Initial Assessment",
    "plan": "Plan",
    "plan2": "Plan:",
}

# Spellings under which a section heading is accepted.
CHIEF_COMPLAINT = ("Chief Complaint", "CHIEF COMPLAINT")
PHYSICAL_EXAM = ("Physical Exam", "PHYSICAL EXAM")
INITIAL_ASSESSMENT = ("Initial Assessment", "INITIAL ASSESSMENT")
ED_COURSE = ("ED Course", "ED course", "ED COURSE")

SECTION_TEXTS = ("history_text", "examination_text", "assessment_plan_text")

# Sentinels that occur as output values.
NOT_EXTRACTED = "unable_to_extract"
CALL_FAILED = "scoring_call_failed"

# The prompt.
PROMPT_INTRO = (
    "You are an Emergency Department physician. Below are the symptoms of two "
    "different patients presenting to the Emergency Department, Patient A and "
    "Patient B. Please return which patient is of the highest acuity between "
    "these two patients. Please return one of two answers: '0: Patient A is of "
    "higher acuity' '1: Patient B is of higher acuity' Please do not return any "
    "additional explanation."
)
PROMPT_BEFORE_A = '  \n  Patient A: """'
PROMPT_BEFORE_B = '"""  \n  Patient B: """'
PROMPT_END = '"""'
# The same text with both histories blank, for counting its own tokens.
PROMPT_FRAME = (
    PROMPT_INTRO
    + '   \n  Patient A: """ """   \n  Patient B: """ """ '
)

# Sizes and budgets.
HISTORY_TOKEN_LIMIT = 2000
MODEL_TOKEN_LIMIT = 4097
INTRO_TOKENS = 94
ANSWER_RESERVE = 11
PAIRS_PER_CLASS = 1000
SPLIT_SEED = 7
SAMPLE_SEED = 42
TOKEN_RATE_PER_1000 = 0.06
QUOTA_CALLS = 295
QUOTA_SECONDS = 60.0
