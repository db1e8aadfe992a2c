"""Fixed values of the loan-application data model.

Everything here is a constant that results depend on (column roles, the feature
dictionary, missing-value tokens, seeds, tuning grids), kept together and unchanged.
"""

from __future__ import annotations

# --- fixed values: column roles ------------------------------------------------
TARGET = "loan_status"
NUMERIC = (
    "person_age",
    "person_income",
    "person_emp_length",
    "loan_amnt",
    "loan_int_rate",
    "loan_percent_income",
    "cb_person_cred_hist_length",
)
CATEGORICAL = (
    "person_home_ownership",
    "loan_intent",
    "loan_grade",
    "cb_person_default_on_file",
)

# --- fixed values: feature dictionary (feature, description, type, source, relevance)
FEATURE_DICTIONARY = (
    ("person_age", "Age of the loan applicant in years", "Numerical",
     "Customer application form / KYC documents",
     "Indicates financial maturity and life stage"),
    ("person_income", "Annual income of the applicant in USD", "Numerical",
     "Salary slips, tax returns, bank statements",
     "Key indicator of repayment capacity"),
    ("person_home_ownership", "Home ownership status (RENT, OWN, MORTGAGE, OTHER)", "Categorical",
     "Customer application form / Address verification",
     "Indicates financial stability and asset ownership"),
    ("person_emp_length", "Employment length in years", "Numerical",
     "Employment verification / HR documents",
     "Job stability indicator affecting repayment reliability"),
    ("loan_intent",
     "Purpose of the loan (PERSONAL, EDUCATION, MEDICAL, VENTURE, DEBTCONSOLIDATION, HOMEIMPROVEMENT)",
     "Categorical", "Loan application form",
     "Risk varies by loan purpose; venture loans typically higher risk"),
    ("loan_grade", "Risk grade assigned to the loan (A-G, A being lowest risk)",
     "Categorical (Ordinal)", "Internal credit scoring system",
     "Pre-calculated risk tier based on initial assessment"),
    ("loan_amnt", "Requested loan amount in USD", "Numerical", "Loan application form",
     "Higher amounts increase exposure and default impact"),
    ("loan_int_rate", "Interest rate on the loan (%)", "Numerical",
     "Loan pricing system based on risk assessment",
     "Higher rates often assigned to higher risk borrowers"),
    ("loan_status", "Loan default status (0 = No Default, 1 = Default)", "Binary Target",
     "Loan performance tracking system",
     "Target variable - indicates whether borrower defaulted"),
    ("loan_percent_income", "Loan amount as percentage of annual income", "Numerical",
     "Calculated: loan_amnt / person_income",
     "Debt-to-income ratio; higher values indicate higher risk"),
    ("cb_person_default_on_file", "Historical default on credit bureau file (Y/N)",
     "Categorical (Binary)", "Credit Bureau report",
     "Strong predictor - past behavior predicts future behavior"),
    ("cb_person_cred_hist_length", "Length of credit history in years", "Numerical",
     "Credit Bureau report", "Longer history provides more data for risk assessment"),
)

# --- fixed values: CSV tokens read as missing (the pandas read_csv defaults) -----
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- fixed values: class labels and report texts ---------------------------------
CLASS_LABELS = {0: "No Default (Good)", 1: "Default (Bad)"}
STRATEGY_MEDIAN = "Median (skewed distribution)"
STRATEGY_MEAN = "Mean (normal distribution)"
STRATEGY_MODE = "Mode (most frequent value)"

# --- fixed values: sampling and validation ---------------------------------------
RANDOM_SEED = 42
TEST_SIZE = 0.2
CV_FOLDS = 5

# --- fixed values: learner names, in registry order --------------------------------
MODEL_NAMES = (
    "Logistic Regression", "Decision Tree", "Random Forest", "Gradient Boosting", "XGBoost",
    "LightGBM", "K-Nearest Neighbors", "Naive Bayes", "AdaBoost",
)

# --- fixed values: tuning grids (declared per model) ------------------------------
TUNING_GRIDS = {
    "Logistic Regression": {
        "C": [0.01, 0.1, 1, 10], "penalty": ["l1", "l2"], "solver": ["saga"], "max_iter": [1000],
    },
    "Random Forest": {
        "n_estimators": [100, 200], "max_depth": [10, 20, None],
        "min_samples_split": [2, 5], "min_samples_leaf": [1, 2],
    },
    "XGBoost": {
        "n_estimators": [100, 200], "max_depth": [3, 5, 7],
        "learning_rate": [0.01, 0.1], "subsample": [0.8, 1.0],
    },
    "LightGBM": {
        "n_estimators": [100, 200], "max_depth": [5, 10, -1],
        "learning_rate": [0.01, 0.1], "num_leaves": [31, 50],
    },
}
