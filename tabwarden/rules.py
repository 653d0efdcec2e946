"""Thresholds, patterns and labels that decide results.

Fixed values: they must stay as they are for verdicts to agree with earlier
screening runs. Patterns use explicit character classes only, so that the JVM,
RE2 and Python read them alike; none of them can backtrack more than linearly.
"""

# --- value samples shown per column -----------------------------------------
N_LONGEST = 10
N_RAREST = 20
N_RANDOM = 20
SEND_ALL_MAX_DISTINCT = 50
MAX_PER_PATTERN = 5
PATTERN_KINDS = ("email", "web", "long_digit")

# --- column cascade ---------------------------------------------------------
SMALL_NUMBER_BELOW = 1000
SHORT_TEXT_BELOW = 4
CATEGORY_MAX_DISTINCT = 20
CATEGORY_MIN_COUNT = 10
CATEGORY_MAX_RATIO = 0.1

# Name fragments that force a column in (matched anywhere, any case).
FORCED_NAME_PARTS = (
    "birth", "bday", "born", "dob", "yob", "mob",
    "edad", "nacimiento", "nacido", "fdn",
    "ethn", "race", "relig", "faith", "disab",
    "etnia", "etni", "raza", "discap",
)
# "age" forces a column in unless it ends one of these word stems.
AGE_PART = "age"
AGE_NOT_AFTER = ("aver", "percent", "stor", "mess", "im", "st", "cover", "langu", "w")

# --- participant IDs and IP addresses ---------------------------------------
PLATFORM_EXACT = "workerid"
PLATFORM_PART = "prolific"
PLATFORM_PART_UNLESS = ("mturk", "mturkcode")
VOLUME_SMALL_N = 30
VOLUME_SMALL_MATCHES = 3
VOLUME_FRACTION = 0.10
IP_STRICT_RATIO = 0.5

# --- coordinates ------------------------------------------------------------
GPS_WINDOW = 2
GPS_MAX_ABS = 180
GPS_KEPT_DECIMALS = 2          # a value with more decimals than this counts as precise
GPS_SENTINELS = (-97, 97, -98, 98, -99, 99, -999, 999, -9999, 9999)
GPS_SOUTH_LIMIT = -60
GPS_MAX_ONE_SIDED = 0.10
GPS_SAMPLE_ROWS = 2000
GPS_LAND_SHARE = 0.90
GPS_BUFFER = 0.01

# --- text patterns ----------------------------------------------------------
WS = r"\x09-\x0d\x1c-\x20\x85\p{Z}"            # white space, as a class body
WORD = r"\p{L}\p{N}_"                          # word characters, as a class body
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
EMAIL = rf"[{WORD}.+-]@[{WORD}-]+\.[a-zA-Z][a-zA-Z]"
WEB = rf"([hH][tT][tT][pP][sS]?://|[wW][wW][wW]\.)[^{WS}]"
# The digit test runs after every run of dashes and white space became one blank.
NINE_DIGITS = rf"(\p{{Nd}}[-{WS}]*){{9}}"         # quick test that rules most texts out
DIGIT_GAPS = rf"[-{WS}]+"
LONG_DIGITS = rf"(^|[^{WORD}.])\p{{Nd}}( ?\p{{Nd}}){{8}}\p{{Nd}}*($|[^{WORD}.])"
PROLIFIC_ID = rf"^[{WS}]*[0-9a-fA-F]{{24}}[{WS}]*$"
MTURK_ID = rf"^[{WS}]*[aA][a-zA-Z0-9]{{9,20}}[{WS}]*$"
IP_SHAPE = rf"^[{WS}]*[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}[{WS}]*$"
IP_OCTET = r"(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
IP_VALID = rf"^[{WS}]*{IP_OCTET}(\.{IP_OCTET}){{3}}[{WS}]*$"
# Private, reserved, loopback, link-local and carrier-grade ranges of valid addresses.
IP_PRIVATE = (
    rf"^[{WS}]*(0{{1,3}}(\.0{{1,3}}){{3}}|0?10\..*|127\..*|192\.168\..*|169\.254\..*"
    rf"|172\.0?(1[6-9]|2[0-9]|3[01])\..*|100\.(0?6[4-9]|0?[789][0-9]|1[01][0-9]|12[0-7])\..*)[{WS}]*$"
)

# --- classifier -------------------------------------------------------------
ATTEMPT_WAITS = (1, 5, 10)     # seconds before attempts 2, 3 and 4
MAX_ATTEMPTS = len(ATTEMPT_WAITS) + 1
EVALUATIONS = ("direct_pii", "internal_id", "possible_indirect", "not_pii", "consent")
DRY_RUN_EVALUATION = "test - not checked"

# --- files ------------------------------------------------------------------
SNIFF_LINES = 10
SNIFF_DELIMITERS = ("\t", ",", ";", "|")
ARCHIVE_ROUNDS = 10
JUNK_FILES = ("thumbs.db", "desktop.ini")
JUNK_FOLDER = "__macosx"
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- ledger -----------------------------------------------------------------
STATUS_PENDING = "pending"
STATUS_RUNNING = "running"
STATUS_DONE = "done"
STATUS_SKIP = "skip"
STATUS_ERROR = "error"
STATUS_NO_FILES = "error — no files found"
STATUS_RAR = ".rar archive present — extract manually or change archive format"

# --- overview labels, in display order --------------------------------------
OVERVIEW_LABELS = (
    ("package_name", "Package"),
    ("n_files_total", "Files found"),
    ("n_data_files", "Data files loaded"),
    ("n_columns_checked", "Columns checked"),
    ("n_direct_pii", "Flagged: direct PII"),
    ("n_indirect", "Flagged: possible indirect PII"),
    ("n_internal_id", "Flagged: internal ID"),
    ("n_warnings", "Warnings"),
    ("n_errors", "Errors"),
    ("model", "LLM model"),
    ("ended", "Run finished"),
)
UNFINISHED = "not finished (partial results)"
NO_RESULTS = "No variables were evaluated"
NO_SHEET = "—"
