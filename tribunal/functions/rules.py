"""Fixed values of the rule engine: thresholds, weights, rule tables, texts.

Nothing here is computed.  Every operator reads its constants from this module,
so the whole policy can be audited (and returned as data, see
``operators.verdict.rule_catalogue``) in one place.
"""

# --- fixed values: input validation -----------------------------------------
MIN_ROWS = 20

# --- fixed values: problem detection ----------------------------------------
MAX_CLASS_COUNT = 20
MAX_CLASS_RATIO = 0.05
SAMPLE_VALUES = 5

RULE_TEXT_NON_NUMERIC = "Rule 1: Non-numeric dtype detected"
RULE_TEXT_BINARY = "Rule 2: Binary target (≤2 unique values)"
RULE_TEXT_LOW_CARDINALITY = "Rule 3: Low cardinality (%d unique values, %s%% ratio)"
RULE_TEXT_REGRESSION = "Rule 4: High cardinality numeric (%d unique values, %s%% ratio)"

# --- fixed values: preparation ----------------------------------------------
MAX_MISSING_RATIO = 0.50
MAX_CATEGORIES = 20
MISSING_CATEGORY = "nan"

# --- fixed values: feature selection ----------------------------------------
MIN_VARIANCE = 0.001
MAX_CORRELATION = 0.90
SIGNAL_HIGH = 0.66
SIGNAL_MEDIUM = 0.33

# --- fixed values: training -------------------------------------------------
N_FOLDS = 5
SEED = 42
NEIGHBOURS = 5

LOGISTIC = "Logistic Regression"
RIDGE = "Ridge Regression"
TREE = "Decision Tree"
FOREST = "Random Forest"
BOOSTING = "Gradient Boosting"
KNN = "K-Nearest Neighbors"

INTERPRETABILITY = {
    TREE: 10,
    LOGISTIC: 9,
    RIDGE: 9,
    FOREST: 6,
    BOOSTING: 4,
    KNN: 5,
}
DEFAULT_INTERPRETABILITY = 5

# --- fixed values: rubric ---------------------------------------------------
CLASSIFICATION = "classification"
REGRESSION = "regression"

# dimension -> weight, in scoring order
WEIGHTS = {
    CLASSIFICATION: {
        "accuracy": 0.30,
        "f1_macro": 0.30,
        "overfit_penalty": 0.25,
        "speed": 0.05,
        "interpretability": 0.10,
    },
    REGRESSION: {
        "r2": 0.35,
        "mae_score": 0.30,
        "overfit_penalty": 0.25,
        "speed": 0.05,
        "interpretability": 0.05,
    },
}

# (upper gap, penalty, label, description)
OVERFIT_RULES = [
    (0.02, 0.00, "No overfitting", "Train/test gap ≤ 2% — model generalises well."),
    (0.05, 0.10, "Slight overfitting", "Train/test gap 2–5% — minor memorisation."),
    (0.10, 0.25, "Moderate overfitting", "Train/test gap 5–10% — model partially memorises training data."),
    (0.20, 0.50, "High overfitting", "Train/test gap 10–20% — poor generalisation expected."),
    (1.00, 0.80, "Severe overfitting", "Train/test gap >20% — model is memorising, not learning."),
]
OVERFIT_BEYOND = (0.80, "Severe overfitting", "Train/test gap >20%")

# (upper seconds, score, label)
SPEED_RULES = [
    (1.0, 1.00, "Very fast"),
    (3.0, 0.80, "Fast"),
    (10.0, 0.55, "Moderate"),
    (30.0, 0.30, "Slow"),
    (1e9, 0.10, "Very slow"),
]
SPEED_BEYOND = (0.10, "Very slow")
DEFAULT_TRAINING_SECONDS = 99.0

DISQUALIFY_ACCURACY = 0.50
DISQUALIFY_R2 = 0.0
DISQUALIFY_GAP = 0.25
DISQUALIFICATION_TEXT = {
    "DQ1": "DQ1 — Accuracy below 50%: worse than random guessing on binary problems.",
    "DQ2": "DQ2 — Negative R²: model performs worse than a horizontal mean line.",
    "DQ3": "DQ3 — Overfit gap > 25%: model cannot be trusted on unseen data.",
    "DQ4": "DQ4 — Model training failed with an error.",
}
DISQUALIFIED_PREFIX = "Model failed one or more hard disqualification rules: "

# --- fixed values: explanation and report -----------------------------------
TOP_FEATURES = 5
REPORT_FEATURES = 10
SCREEN_FEATURES = 15
SHARE_HIGH = 66.0
SHARE_MEDIUM = 33.0
CONFIDENCE_HIGH = 0.75
CONFIDENCE_MEDIUM = 0.50
GAP_HIGH = 0.10
GAP_MEDIUM = 0.05

# --- fixed values: tokens a CSV cell may hold for "missing" ------------------
CSV_MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
