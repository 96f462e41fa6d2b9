"""Fixed values shared by suggestions, issue rules and steps."""

MISSING_TOKENS = ["?", "NA", "N/A", "unknown", "Unknown", "UNK", "-", "--", "null", "None", "missing"]
STEP_PLACEHOLDERS = ["N/A", "NA", "unknown", "?", "-"]
SUGGESTED_PLACEHOLDERS = ["N/A", "NA", "unknown", "?", "-", "--", "null", "None", "missing"]
BOOLEAN_TEXTS = ["true", "false", "yes", "no", "y", "n", "0", "1"]
TARGET_HINTS = ["target", "label", "class", "outcome", "response", "result", "y", "quality"]
ID_HINTS = ["id", "uuid", "guid", "key", "identifier"]
CODE_HINTS = ["zip", "zipcode", "postal", "postcode", "code", "fips"]
LEAKAGE_TERMS = ["target", "label", "outcome", "result", "approved", "final"]
SEVERITY_PENALTY = {"critical": 12.0, "warning": 5.0, "info": 1.5}
SEVERITY_RANK = {"critical": 0, "warning": 1, "info": 2}
SEVERITY_PRIORITY = {"critical": "critical", "warning": "high", "info": "low"}
PRIORITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}
