"""Fixed values.

These must equal the reference service's values for the same results;
they are stated here together, in plain text, and used by the operators.
"""

# --- Fixed values: display defaults for missing data -------------------
UNKNOWN = "Unknown"
NO_SIGNATURE = "No signature"
UNNAMED_FIELD = "unnamed"
UNKNOWN_FIELD_TYPE = "Unknown type"

# --- Fixed values: preview lengths (characters) ------------------------
SIGNATURE_PREVIEW = 100
TYPE_DEFINITION_PREVIEW = 200
CLASS_DEFINITION_PREVIEW = 300
INSTANCE_PREVIEW = 100
PREVIEW_ELLIPSIS = "..."

# --- Fixed values: complexity score ------------------------------------
# score = len(signature) // 20 + 2 * count("->") + call sites // 3 + 2 * local definitions
SIGNATURE_CHARS_PER_POINT = 20
ARROW_TOKEN = "->"
ARROW_WEIGHT = 2
CALLS_PER_POINT = 3
LOCAL_DEFINITION_WEIGHT = 2

# --- Fixed values: import review ---------------------------------------
TEST_PACKAGE_MARKER = "test"

# --- Fixed values: type categories -------------------------------------
TYPE_CATEGORIES = ("DATA", "SUMTYPE", "TYPE", "NEWTYPE", "CLASS", "INSTANCE")

# --- Fixed values: default limits and thresholds -----------------------
LIMIT_MODULES = 100
LIMIT_SEARCH = 50
LIMIT_MOST_CALLED = 20
LIMIT_CALLERS = 50
LIMIT_CROSS_MODULE_CALLS = 100
LIMIT_COMPLEXITY = 50
MIN_COMPLEXITY = 5
LIMIT_LISTING = 100
LIMIT_SIMILAR = 10
SIMILARITY_THRESHOLD = 0.7
LIMIT_CODE_PATTERNS = 20
MIN_PATTERN_MATCHES = 3
LIMIT_GROUPS = 10
MIN_GROUP_SIZE = 2
LIMIT_CROSS_DEPENDENCIES = 50
DEPENDENCY_THRESHOLD = 1
LIMIT_POPULAR_IMPORTS = 20
SAMPLE_FUNCTIONS_PER_MODULE = 10
SAMPLE_INSTANCES_PER_CLASS = 10
SAMPLE_TYPES_PER_CATEGORY = 10
LOCATION_DEPENDENCIES = 5
MATCHED_LINES_SHOWN = 3

LIMIT_TYPE_FUNCTIONS = 20       # functions listed per type
BODY_LINES = 5                  # lines of a body shown first
BODY_PREVIEW = 200              # characters of a body shown first
