"""Names and fixed values shared by all operators.

The block marked FIXED VALUES holds numbers and texts that must equal the
behaviour being reproduced (bin edges, labels, weights, thresholds, messages).
They are stated once, here, in their natural order.
"""

SEED = 42
LABEL = "Credit_Score"
ID = "borrower_id"

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reproduced behaviour)
# ---------------------------------------------------------------------------
CLASS_NAMES = ["Poor", "Standard", "Good"]  # label 0, 1, 2

LOG_FEATS = ["Annual_Income", "Monthly_Inhand_Salary", "Outstanding_Debt",
             "Total_EMI_per_month", "Amount_invested_monthly"]
CAT_COLS = ["Occupation", "Credit_Mix", "Payment_of_Min_Amount",
            "Age_Group", "Income_Bracket", "Delay_Bucket"]

# bins are right-closed intervals (lo, hi]; outside or missing -> "nan"
AGE_EDGES = [17, 25, 35, 45, 60, 75]
AGE_LABELS = ["18-25", "26-35", "36-45", "46-60", "61-75"]
INCOME_EDGES = [0, 30000, 70000, 120000, 1e9]
INCOME_LABELS = ["Low", "Medium", "High", "Very_High"]
DELAY_EDGES = [-1, 0, 15, 30, 62]
DELAY_LABELS = ["None", "Low", "Medium", "High"]
MISSING_BIN = "nan"
EXPM1_GUARD_MAX = 30  # income max below this => values are logged

# engineered features: (name, numerator, denominator, offset) for ratios
RATIO_FEATS = [
    ("Debt_to_Income", "Outstanding_Debt", "Annual_Income", 1e-3),
    ("EMI_to_Income", "Total_EMI_per_month", "Monthly_Inhand_Salary", 1e-3),
    ("Delayed_per_Loan", "Num_of_Delayed_Payment", "Num_of_Loan", 1.0),
    ("Investment_to_Income", "Amount_invested_monthly", "Monthly_Inhand_Salary", 1e-3),
    ("Cards_per_Account", "Num_Credit_Card", "Num_Bank_Accounts", 1.0),
]
# products: (name, left, right); the right factor has missing -> 0
PRODUCT_FEATS = [
    ("Util_x_Delay", "Credit_Utilization_Ratio", "Delay_from_due_date"),
    ("Debt_x_Inquiries", "Outstanding_Debt", "Num_Credit_Inquiries"),
]

# scorecard label: weights and scale divisors
SCORECARD = {
    "w_income": 0.25, "w_debt": 0.20, "w_delay": 0.15, "w_history": 0.12,
    "w_delayed": 0.10, "w_mix": 0.08, "w_util": 0.05,
    "debt_div": 4998.0, "delay_div": 62.0, "history_div": 35.0,
    "delayed_div": 22.0, "util_div": 50.0,
    "mix": {"Good": 1.0, "Standard": 0.5, "Bad": 0.0},
}
# the reference cut-offs are 0.38 / 0.65; the derived borrower view uses
# 0.46 / 0.58 so that all three classes are populated (see FIXTURES.md)
SCORECARD_CUTS = (0.46, 0.58)
# missing-value substitutes in the derived view (midpoints of the ranges)
SCORECARD_MISSING = {"Outstanding_Debt": 2499.0, "Delay_from_due_date": 31.0,
                     "Num_of_Delayed_Payment": 11.0, "Credit_Utilization_Ratio": 35.0}

# 300-850 score from class probabilities: int(300 + 200 p1 + 550 p2)
SCORE_BASE, SCORE_W1, SCORE_W2 = 300, 200, 550
SCORE_ZONES = [300, 580, 670, 740, 800, 850]
SCORE_ZONE_NAMES = ["300-580", "580-670", "670-740", "740-800", "800-850"]
SCORE_COLOUR = [(740, "green"), (580, "amber")]  # else "red"

# expected score range by annual income: (upper income bound, lo, hi)
EXPECTED_RANGE = [(30000, 400, 560), (80000, 540, 700), (150000, 650, 780)]
EXPECTED_RANGE_TOP = (700, 820)

# risk dimensions (0..100)
RISK_MIX = {"Good": 100.0, "Standard": 55.0, "Bad": 10.0}
RISK_MIX_DEFAULT = 10.0
RISK_DIM_NAMES = ["Payment History", "Debt Management", "Credit History",
                  "Credit Mix", "Credit Activity", "Savings & Income"]

# deviation from the Good profile: (feature, lower_is_better, display label)
DEVIATION_KEYS = [
    ("Outstanding_Debt", True, "Outstanding Debt"),
    ("Delay_from_due_date", True, "Avg Delay (days)"),
    ("Num_of_Delayed_Payment", True, "Delayed Payments"),
    ("Credit_History_Age", False, "Credit History (yrs)"),
    ("Credit_Utilization_Ratio", True, "Credit Utilisation %"),
    ("Debt_to_Income", True, "Debt-to-Income"),
    ("EMI_to_Income", True, "EMI-to-Income"),
    ("Annual_Income", False, "Annual Income"),
]

# insight rules, in order; the two range rules are exclusive (if / else)
INSIGHT_TEXT = {
    "high_delay": "⚠️ **High payment delays** — paying on or before due date is the single biggest positive action.",
    "debt_to_income": "⚠️ **Elevated debt-to-income ratio** — reducing outstanding debt will directly improve your score.",
    "high_utilisation": "⚠️ **Credit utilisation above 40%** — aim to keep it below 30% of your credit limit.",
    "short_history": "💡 **Short credit history** — maintaining existing accounts for longer builds a stronger track record.",
    "bad_mix": "💡 **Poor credit mix** — having a diverse combination of credit types signals lower risk to lenders.",
    "many_delayed": "⚠️ **Many delayed payments on record** — set up automatic payments to prevent future delays.",
    "many_inquiries": "⚠️ **High credit inquiry count** — multiple recent inquiries signal credit-seeking behaviour to lenders.",
    "above_range": "✅ **Above expected range ({lo}–{hi}) for your income bracket** — excellent financial discipline!",
    "below_range": "💡 **Below expected range ({lo}–{hi}) for your income bracket** — focus on the items flagged above.",
    "fallback": "✅ Your credit profile looks strong. Maintain consistent payment habits to stay here.",
}
INSIGHT_LIMITS = {"delay": 20, "debt_ratio": 0.3, "util": 40, "history": 3,
                  "delayed": 10, "inquiries": 8}
# emoji -> ASCII tag for plain-text export
EMOJI_TAGS = [("⚠️", "[!]"), ("✅", "[OK]"), ("💡", "[>]")]
PROBA_BAR_CELLS = 18
PROBA_BAR_FULL, PROBA_BAR_EMPTY = "█", "░"

# model settings
RFECV_MIN_FEATURES = 8
SMOTE_K = 5
KNN_K = 9
HIST_BINS_EDA = 40
HIST_BINS_PROFILE = 50
CALIBRATION_BINS = 10
MI_QUANTILE = 0.35
TEST_SHARE = 0.2
# ---------------------------------------------------------------------------

LABEL_MAP = {i: n for i, n in enumerate(CLASS_NAMES)}
NAME_TO_LABEL = {n: i for i, n in enumerate(CLASS_NAMES)}

# FIXED VALUES: column names of the borrower table, in schema order
NUMERIC_INPUTS = [
    "Age", "Annual_Income", "Monthly_Inhand_Salary", "Num_Bank_Accounts",
    "Num_Credit_Card", "Interest_Rate", "Num_of_Loan", "Delay_from_due_date",
    "Num_of_Delayed_Payment", "Changed_Credit_Limit", "Num_Credit_Inquiries",
    "Outstanding_Debt", "Credit_Utilization_Ratio", "Credit_History_Age",
    "Total_EMI_per_month", "Amount_invested_monthly", "Monthly_Balance",
]
STRING_INPUTS = ["Occupation", "Credit_Mix", "Payment_of_Min_Amount"]
INPUT_COLUMNS = [
    "Age", "Occupation", "Annual_Income", "Monthly_Inhand_Salary",
    "Num_Bank_Accounts", "Num_Credit_Card", "Interest_Rate", "Num_of_Loan",
    "Delay_from_due_date", "Num_of_Delayed_Payment", "Changed_Credit_Limit",
    "Num_Credit_Inquiries", "Credit_Mix", "Outstanding_Debt",
    "Credit_Utilization_Ratio", "Credit_History_Age", "Payment_of_Min_Amount",
    "Total_EMI_per_month", "Amount_invested_monthly", "Monthly_Balance",
]
BIN_COLUMNS = ["Age_Group", "Income_Bracket", "Delay_Bucket"]
ENGINEERED = [r[0] for r in RATIO_FEATS] + [p[0] for p in PRODUCT_FEATS]
# feature columns after rebin + encode (inputs then bins), then engineered
ENCODED_FEATURES = INPUT_COLUMNS + BIN_COLUMNS
ALL_FEATURES = ENCODED_FEATURES + ENGINEERED

# FIXED VALUES: input form bounds and allowed sets (data-quality rules)
FORM_BOUNDS = [
    ("Age", 18, 75), ("Num_Bank_Accounts", 1, 10), ("Num_Credit_Card", 0, 12),
    ("Num_of_Loan", 0, 9), ("Annual_Income", 5000, 500000), ("Outstanding_Debt", 0, 5000),
    ("Total_EMI_per_month", 0, 5000), ("Amount_invested_monthly", 0, 5000),
    ("Monthly_Balance", 0, 2000), ("Interest_Rate", 1, 34), ("Delay_from_due_date", 0, 62),
    ("Num_of_Delayed_Payment", 0, 22), ("Credit_Utilization_Ratio", 20, 50),
    ("Credit_History_Age", 0, 35), ("Num_Credit_Inquiries", 0, 17),
    ("Changed_Credit_Limit", 0, 30),
]
FORM_SETS = [
    ("Occupation", ["Scientist", "Teacher", "Engineer", "Entrepreneur", "Developer",
                    "Lawyer", "Doctor", "Journalist", "Manager", "Accountant",
                    "Musician", "Mechanic", "Writer", "Architect", "Media_Manager"]),
    ("Credit_Mix", ["Good", "Standard", "Bad"]),
    ("Payment_of_Min_Amount", ["Yes", "No", "NM"]),
]
