"""Lists, patterns and texts that results must agree on.

Everything here is data that fixes what a result looks like; the logic that uses
it lives in the operators and reports.
"""

# Text that a CSV reader takes as missing.
CSV_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Formats of the validation operator. The URL pattern is written
# without its nested repetition, which matches the same texts.
FORMAT_PATTERNS = {
    "email": r"(^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$)",
    "phone": r"(^\+?[\d\s\-\(\)]{7,20}$)",
    "url": r"^(https?:\/\/)?([\da-z\.-]+)\.([a-z\.]{2,6})[\\/\w \.-]*\/?$",
    "ip_address": r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$",
    "credit_card": (
        r"^(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|6(?:011|5[0-9][0-9])[0-9]{12}"
        r"|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|(?:2131|1800|35\d{3})\d{11})$"
    ),
    "aadhaar": r"^\s*[2-9]{1}[0-9]{3}[\s-]?[0-9]{4}[\s-]?[0-9]{4}\s*$",
    "numeric": r"^\s*-?\d+(\.\d+)?\s*$",
    "date": (
        r"^\s*(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{4})\s*(?:T| )?"
        r"(?:\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[\+-]\d{2}:\d{2})?)?\s*$"
    ),
}

# What may surround a number in messy text, and the number itself.
NUMBER_PATTERN = r"[-+]?\d[\d,]*(?:\.\d+)?"
ALLOWED_AROUND_NUMBER = r"[\w\s$€£₹¥₩₪%,.\-+/()@#&:]*"

# Standardising dates.
DATE_NAME_KEYWORDS = ["date", "time", "dob", "created", "updated", "stamp", "history"]
DATE_NOISE = r"(?i)(Purchased on|Order #[0-9]+ - |Date:|Originally:|On)"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# Number words.
UNITS = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
    "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen",
    "nineteen",
]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
SCALES_READ = ["thousand", "million", "billion"]

# Placeholders that stand for a missing value.
TEXT_SENTINELS = [
    "n/a", "na", "n.a.", "none", "null", "nil", "unknown", "not available", "missing",
    "undefined", "?", "-", "--", "tbd", "tba", "xxx",
]
NUMERIC_SENTINELS = [-999, -9999, -1, 999, 9999]
DOMINANT_PLACEHOLDERS = [
    "0", "-1", "-999", "9999", "n/a", "null", "unknown", "none", "na", "missing", "undefined", "-",
]

# Name keywords of the quality alerts.
NUMERIC_NAME_KEYWORDS = [
    "age", "price", "amount", "count", "total", "salary", "score", "qty", "quantity",
]
ALERT_DATE_KEYWORDS = ["date", "time", "dob", "created", "updated", "stamp"]

# Severity of each alert type.
ALERT_SEVERITY = {
    "missing_values": "medium",
    "placeholder_values": "medium",
    "mixed_type_numeric": "low",
    "mixed_type_worded": "low",
    "invalid_numeric_format": "high",
    "invalid_date_format": "high",
    "duplicate_rows": "high",
    "outliers": "medium",
    "class_imbalance": "medium",
    "skewed_distribution": "low",
    "constant_column": "low",
    "high_cardinality": "low",
}

# Recommended actions of the quality alerts (printf templates).
ALERT_ACTIONS = {
    "missing_mostly": "Column is mostly empty — consider dropping it or filling with a constant",
    "missing_some": "Fill with Mean / Median (numeric) or Mode (categorical)",
    "placeholder_values": (
        "%d placeholder values found (e.g. -999, N/A, unknown) — replace with NaN then impute"
    ),
    "mixed_type": "Convert entire column to Numeric (Text to Numeric)",
    "invalid_numeric_format": (
        "Use Format Validation (numeric) to remove invalid entries, or Convert Type"
    ),
    "invalid_date_format": (
        "Use Format Validation (date) to remove invalid entries, or Convert Type to Date"
    ),
    "duplicate_rows": (
        "%d duplicate rows — run Drop Duplicates before train/test split to prevent data leakage"
    ),
    "outliers": (
        "%d outliers (IQR) — cap, remove with Remove Outliers, or apply log/robust scaling"
    ),
    "class_imbalance": (
        "Majority class is %.0f%% of data, minority ‘%s’ is %.1f%% — "
        "apply SMOTE, undersampling, or class-weight adjustments before training"
    ),
    "skewed_distribution": (
        "Skewness %.2f (%s) — apply log transform, Box-Cox, or robust scaling"
    ),
    "constant_column": (
        "Column has only one unique value — drop it (provides no information for ML)"
    ),
    "high_cardinality": (
        "Likely an ID or primary key — drop or use target encoding; "
        "one-hot will explode dimensionality"
    ),
}

# Name keywords of the readiness findings.
SUSPICIOUS_NEGATIVE_NAMES = [
    "age", "count", "quantity", "qty", "price", "amount", "salary", "score", "rating",
    "duration", "distance", "weight", "height",
]
HIDDEN_DATE_NAMES = [
    "date", "time", "dt", "at", "on", "when", "day", "month", "year", "timestamp",
]

# Readiness findings as severity, category, title, suggested
# action, whether it can be fixed automatically, and by which operation.
FINDINGS = {
    "high_null_col": (
        "critical", "data_quality", "High Missing Data Rate",
        "Drop this column or use KNN imputation if the missing values carry signal",
        True, "drop_missing_specific",
    ),
    "zero_variance": (
        "critical", "ml_readiness", "Zero Variance Feature",
        "Drop this column before ML training.",
        True, "drop_columns",
    ),
    "high_cardinality": (
        "warning", "ml_readiness", "High Cardinality Categorical",
        "Drop this column if it is an identifier, or apply Binary encoding to reduce "
        "dimensionality",
        False, None,
    ),
    "id_leakage": (
        "info", "ml_readiness", "Potential ID Column Detected",
        "Confirm this is an ID column and drop it before ML training — ID columns leak row "
        "identity into models.",
        True, "drop_columns",
    ),
    "near_zero_variance": (
        "warning", "statistics", "Near-Zero Variance Feature",
        "Consider dropping or investigating why this column has almost no variation.",
        False, None,
    ),
    "skewed_dist": (
        "warning", "statistics", "Highly Skewed Distribution",
        "Apply log1p transformation for right-skewed columns, or square-root for moderately "
        "skewed. Linear models are sensitive to skewed inputs.",
        False, None,
    ),
    "suspicious_negatives": (
        "warning", "data_quality", "Suspicious Negative Values",
        "Negative values in '{col}' may be data entry errors. Investigate and consider capping "
        "at 0 or dropping.",
        False, None,
    ),
    "mixed_numeric": (
        "warning", "data_quality", "Numeric Values Stored as Text",
        "Use 'Convert to Numeric' normalization step",
        True, "convert_type_numeric",
    ),
    "hidden_datetime": (
        "warning", "structure", "Date Stored as Text",
        "Override this column's type to Date to unlock date-specific operations and time series "
        "features",
        False, None,
    ),
    "imbalanced_binary": (
        "warning", "ml_readiness", "Imbalanced Binary Label",
        "Apply SMOTE oversampling or random undersampling before training a classifier. "
        "Imbalanced labels cause models to predict the majority class for almost all inputs.",
        True, "handle_imbalance",
    ),
    "placeholder": (
        "critical", "data_quality", "Widespread Placeholder Value",
        "Replace '{value}' with NaN using the Replace Value operation, then handle as missing "
        "data.",
        False, None,
    ),
    "duplicate_rows": (
        "warning", "data_quality", "Duplicate Rows Detected",
        "Drop duplicate rows to prevent data leakage and train-test contamination.",
        True, "drop_duplicates",
    ),
    "high_corr": (
        "info", "statistics", "Extreme Collinearity",
        "Consider dropping one of these columns before training linear models to avoid "
        "multicollinearity. Tree-based models are unaffected.",
        False, None,
    ),
    "hr_age_tenure_conflict": (
        "warning", "consistency", "Age vs Tenure Logic Error",
        "Investigate these records for data entry errors on age or tenure.",
        False, None,
    ),
    "hr_salary_dept_outlier": (
        "warning", "statistics", "Department-Level Salary Outliers",
        "Review these entries with HR or cap them iteratively per department.",
        False, None,
    ),
    "fi_negative_amounts": (
        "info", "data_quality", "Negative Monetary Limits",
        "Investigate whether negative values should be treated as a separate transaction type or "
        "absolute-valued.",
        False, None,
    ),
    "hc_impossible_age": (
        "critical", "data_quality", "Physiologically Impossible Age",
        "Cap out of bounds values to NaN.",
        False, None,
    ),
    "hc_impossible_hr": (
        "critical", "data_quality", "Physiologically Impossible Heart Rate",
        "Replace outlier vital signs with NaN.",
        False, None,
    ),
}
WHOLE_TABLE = "(entire dataset)"

# Name keywords of the domain signals.
DOMAIN_KEYWORDS = {
    "hr": [
        "employee", "emp_id", "staff", "personnel", "worker", "headcount", "salary",
        "compensation", "pay", "wage", "ctc", "annual_income", "department", "dept", "division",
        "team", "business_unit", "hire_date", "joining_date", "join_date", "start_date", "tenure",
        "churn", "attrition", "resigned", "termination", "left_company", "performance", "rating",
        "score", "appraisal", "age", "gender", "designation", "title", "role", "level", "grade",
    ],
    "finance": [
        "transaction", "txn", "payment", "transfer", "amount", "debit", "credit", "balance",
        "account", "account_no", "account_id", "iban", "swift", "merchant", "vendor", "payee",
        "sender", "receiver", "fraud", "is_fraud", "fraudulent", "anomaly", "suspicious",
        "currency", "fx_rate", "exchange", "invoice", "order_id", "reference", "ref_no",
    ],
    "healthcare": [
        "patient", "patient_id", "mrn", "medical_record", "diagnosis", "icd", "icd_code", "icd9",
        "icd10", "cpt", "drg", "admission", "discharge", "los", "length_of_stay", "medication",
        "drug", "prescription", "dosage", "lab", "test", "result", "specimen", "pathology",
        "doctor", "physician", "provider", "npi", "blood_pressure", "bp", "heart_rate", "hr_bpm",
        "glucose", "bmi", "weight_kg", "height_cm", "vital",
    ],
    "ecommerce": [
        "product", "product_id", "sku", "asin", "item", "listing", "customer", "customer_id",
        "buyer", "user_id", "shopper", "order", "order_id", "cart", "basket", "purchase", "price",
        "unit_price", "list_price", "discount", "promo", "quantity", "qty", "units_sold", "stock",
        "inventory", "category", "subcategory", "brand", "seller", "rating", "review", "stars",
        "feedback", "return", "refund", "cancellation",
    ],
    "iot_sensor": [
        "device_id", "sensor_id", "device", "node", "gateway", "equipment", "reading",
        "measurement", "value", "metric", "temperature", "temp", "humidity", "pressure",
        "voltage", "current", "power", "rpm", "vibration", "flow_rate", "unit",
        "unit_of_measure", "uom", "timestamp", "event_time", "recorded_at", "sampled_at",
        "status", "state", "alert", "alarm", "threshold",
    ],
}
BINARY_TEXTS = ["0", "1", "true", "false", "yes", "no", "active", "inactive"]
CURRENCY_CODES = ["usd", "eur", "gbp", "inr", "jpy", "aud", "cad", "chf"]
MONEY_NAMES = ["amount", "txn", "transaction", "transfer"]
DEVICE_NAMES = ["device_id", "sensor_id", "node", "equipment"]
AGE_NAMES = ["age"]
TENURE_NAMES = ["tenure", "years_of_service", "experience"]
SALARY_NAMES = ["salary", "pay", "compensation"]
DEPARTMENT_NAMES = ["department", "dept", "division"]
HEART_RATE_NAMES = ["heart_rate", "hr_bpm"]

# Weight of each domain signal.
DOMAIN_WEIGHTS = {
    ("hr", "name"): 0.15,
    ("hr", "salary_values"): 0.20,
    ("hr", "age_values"): 0.15,
    ("hr", "binary_values"): 0.10,
    ("hr", "row_count"): 0.05,
    ("finance", "name"): 0.15,
    ("finance", "positive_floats"): 0.20,
    ("finance", "currency_codes"): 0.15,
    ("finance", "date_and_amount"): 0.15,
    ("healthcare", "name"): 0.15,
    ("healthcare", "vital_values"): 0.15,
    ("healthcare", "lab_values"): 0.10,
    ("ecommerce", "name"): 0.15,
    ("ecommerce", "percent_values"): 0.10,
    ("ecommerce", "quantity_and_price"): 0.15,
    ("iot_sensor", "name"): 0.15,
    ("iot_sensor", "row_count"): 0.20,
    ("iot_sensor", "has_date"): 0.15,
    ("iot_sensor", "few_devices"): 0.15,
}

# Readiness score weights and labels.
SCORE_WEIGHTS = {"critical": 0.15, "warning": 0.07, "info": 0.02, "suggestion": 0.0}
READINESS_LABELS = [(0.85, "Ready"), (0.65, "Almost Ready"), (0.40, "Needs Work")]
NOT_READY = "Not Ready"
