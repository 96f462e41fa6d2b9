"""Fixed values as the SQL states them, apart from the library's own, so that a wrong value in either shows."""

MISSING_TOKENS = ["?", "NA", "N/A", "unknown", "Unknown", "UNK", "-", "--", "null", "None", "missing"]
BOOLEAN_TEXTS = ["true", "false", "yes", "no", "y", "n", "0", "1"]
TARGET_HINTS = ["target", "label", "class", "outcome", "response", "result", "y", "quality"]
ID_HINTS = ["id", "uuid", "guid", "key", "identifier"]
CODE_HINTS = ["zip", "zipcode", "postal", "postcode", "code", "fips"]
LEAKAGE_TERMS = ["target", "label", "outcome", "result", "approved", "final"]
PARAMS = {
    'remove_duplicate_rows': {'subset': [], 'keep': 'first'},
    'replace_placeholder_values': {'placeholders': ['N/A', 'NA', 'unknown', '?', '-', '--', 'null', 'None', 'missing'], 'replacement': None},
    'numeric_imputation': {'strategy': 'median'},
    'categorical_imputation': {'strategy': 'constant', 'fill_value': '__MISSING__'},
    'text_basic_features': {'lowercase': False, 'strip_whitespace': True, 'create_length_feature': True, 'create_word_count_feature': True, 'drop_original': False},
    'add_missing_indicator': {'suffix': '_was_missing'},
    'outlier_clipping': {'method': 'iqr', 'iqr_multiplier': 1.5},
    'rare_category_grouping': {'min_frequency': 0.01, 'rare_label': '__RARE__', 'include_missing': False},
    'drop_columns': {},
}
REASONS = {
    'remove_duplicate_rows': 'Duplicate rows can usually be removed before modeling after domain review.',
    'replace_placeholder_values': 'Placeholder strings should be normalized to missing values before imputation.',
    'numeric_imputation': 'Median imputation is a conservative numeric default that is robust to outliers.',
    'categorical_imputation': 'A constant missing label preserves missingness as a model-visible category.',
    'text_basic_features': 'Text feature extraction normalizes missing text to an empty string and adds usable length features.',
    'add_missing_indicator': 'For this type, a missingness indicator is safer than changing the source value automatically.',
    'outlier_clipping': 'IQR clipping limits extreme numeric values while fitting thresholds from the training data.',
    'rare_category_grouping': 'Grouping rare categories reduces sparse categorical noise before encoding.',
}
STEP_ORDER = {
    'remove_duplicate_rows': 0,
    'drop_columns': 10,
    'replace_placeholder_values': 20,
    'add_missing_indicator': 30,
    'numeric_imputation': 40,
    'categorical_imputation': 45,
    'text_basic_features': 50,
    'outlier_clipping': 60,
    'rare_category_grouping': 70,
}
TITLES = {
    'remove_duplicate_rows': 'Remove duplicate rows',
    'replace_placeholder_values': 'Normalize placeholder missing values',
    'numeric_imputation': 'Impute numeric missing values',
    'categorical_imputation': 'Impute categorical missing values',
    'text_basic_features': 'Create basic text preprocessing features',
    'outlier_clipping': 'Clip numeric outliers',
    'rare_category_grouping': 'Group rare categories',
    'add_missing_indicator': 'Add missingness indicator columns',
}
DROP_TITLES = {
    'leakage': 'Review and drop leakage-prone columns',
    'cardinality': 'Drop likely identifier columns',
    'constant': 'Drop constant or near-constant columns',
}
ADVICE = {
    'target': 'This is not an in-place feature preprocessing step; handle it through split strategy, validation design, or model training settings.',
    'split': 'Resolve the split issue before trusting preprocessing previews or model validation.',
    'drift': 'Use train-only fitted preprocessing and inspect whether the split reflects deployment data.',
}
DROP_ID_REASON = 'Nearly unique columns often act as identifiers rather than reusable predictors.'
DROP_REASON = 'The flagged column is unlikely to add stable predictive value without further justification.'
