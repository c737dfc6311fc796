"""Fixed values.

Every list, set and pattern in this module is data the results depend on: change a
word here and a count or a label changes. Nothing else in the package hard-codes words.
"""

# --- missing-value tokens ---------------------------------------------------------
# compared after stripping whitespace and lower-casing
MISSING_WORDS = [
    "", "null", "none", "nan", "n/a", "na", "undefined",
    "-", "--", "?", "n/a.", "n.d.", "nd", "#n/a", "#na",
]

# compared exactly (case matters) while reading text files
NULL_SENTINELS = [
    "N/A", "NA", "n/a", "na", "N.A.", "N/A.", "N.A",
    "null", "NULL", "Null", "none", "None", "NONE", "NaN", "nan", "NAN",
    "-", "--", "---", "?", "??",
    "#N/A", "#NA", "#NULL!", "#REF!", "#VALUE!", "#DIV/0!", "#ERROR!",
    "missing", "Missing", "MISSING", "undefined", "Undefined", "UNDEFINED",
    "N.D.", "nd", "ND", "(null)", "(None)", "(none)", "(empty)",
]

# --- type detection ---------------------------------------------------------------
BOOLEAN_WORDS = [
    "true", "false", "yes", "no", "y", "n", "t", "f",
    "1", "0", "on", "off", "enabled", "disabled",
]

# (Spark pattern, shape the text must have); tried in this order
DATE_FORMATS = [
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("M-d-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("yyyy-M-d H:m:s", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
    ("d/M/yyyy H:m:s", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$"),
    ("M/d/yyyy H:m:s", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$"),
    ("yyyyMMdd", r"^\d{8}$"),
    ("d MMM yyyy", r"^\d{1,2} [A-Za-z]{3} \d{4}$"),
    ("MMMM d, yyyy", r"^[A-Za-z]{3,9} \d{1,2}, \d{4}$"),
    ("MMM d, yyyy", r"^[A-Za-z]{3} \d{1,2}, \d{4}$"),
    # ISO 8601 with a time: a T or a space, with or without seconds, fractions and zone
    ("ISO", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)? ?(Z|[+-]\d{2}:?\d{2})?$"),
    ("d/M/yyyy H:m", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}$"),
    ("M/d/yyyy H:m", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}$"),
    ("d/M/yyyy h:m[:s] a", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}(:\d{1,2})? [AP]M$"),
    ("M/d/yyyy h:m[:s] a", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}(:\d{1,2})? [AP]M$"),
]

# --- column-name hints ------------------------------------------------------------
ID_HINTS = [
    "id", "code", "key", "identifier", "primary", "uuid", "sk", "pk",
    "record", "ref", "no", "num", "number", "serial",
]
DATE_HINTS = [
    "date", "time", "timestamp", "datetime", "year", "month", "day",
    "period", "created", "updated", "modified", "dt", "at",
]
METRIC_HINTS = [
    "score", "mark", "grade", "gpa", "points", "total", "average", "attendance",
    "performance", "salary", "revenue", "sales", "profit", "cost", "rate",
    "value", "amount", "price",
]
SIGNED_NAMES = ["temperature", "change", "difference", "balance", "net"]

# first group with a keyword inside the column name wins
MEANING_TAGS = {
    "money": ["revenue", "sales", "income", "earnings", "profit", "amount", "price", "cost",
              "total", "value", "payment", "fee", "salary", "wage", "compensation", "ctc", "pay"],
    "customer": ["customer", "client", "buyer", "user", "account", "member", "consumer",
                 "patron", "subscriber"],
    "product": ["product", "item", "sku", "goods", "service", "article", "merchandise", "offering"],
    "date": ["date", "time", "timestamp", "created", "updated", "ordered", "shipped", "period",
             "month", "year", "day", "week"],
    "location": ["region", "city", "country", "state", "zone", "area", "location", "territory",
                 "branch", "store", "address"],
    "quantity": ["quantity", "qty", "units", "volume", "count", "number", "sold", "ordered",
                 "stock", "inventory"],
    "category": ["category", "type", "segment", "class", "group", "kind", "department", "dept",
                 "division", "team", "section"],
    "score": ["score", "grade", "rating", "gpa", "marks", "points", "rank", "index", "percentile"],
    "status": ["status", "flag", "active", "state", "stage", "phase", "condition", "result",
               "outcome"],
    "name": ["name", "title", "label", "description", "desc", "fullname", "firstname", "lastname"],
    "id": ["id", "key", "code", "number", "ref", "reference", "identifier", "no", "num"],
}

# first theme with a keyword inside any column name wins
THEMES = {
    "Sales / E-commerce": ["revenue", "sales", "order", "product", "price", "quantity", "customer",
                           "invoice", "transaction", "purchase"],
    "Finance": ["salary", "budget", "expense", "income", "profit", "loss", "balance", "account",
                "payment", "tax", "interest"],
    "Healthcare": ["patient", "diagnosis", "treatment", "symptom", "blood", "bmi", "age", "gender",
                   "hospital", "doctor"],
    "Education": ["student", "grade", "exam", "test", "score", "class", "teacher", "course",
                  "subject", "attendance", "gpa", "semester", "marks"],
    "HR / Workforce": ["employee", "department", "role", "hire", "salary", "job", "position",
                       "manager", "attrition", "tenure", "leave"],
    "Marketing": ["campaign", "click", "conversion", "impression", "channel", "ad", "social",
                  "email", "lead", "traffic", "engagement"],
}
DEFAULT_THEME = "Generic Tabular Dataset"

# --- user SQL ---------------------------------------------------------------------
DENIED_SQL_WORDS = ["DROP", "DELETE", "UPDATE", "ALTER", "INSERT", "TRUNCATE", "ATTACH"]

# --- questions --------------------------------------------------------------------
NUMBER_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9", "ten": "10", "eleven": "11", "twelve": "12",
    "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17",
    "eighteen": "18", "nineteen": "19", "twenty": "20", "thirty": "30", "forty": "40",
    "fifty": "50", "hundred": "100", "thousand": "1000",
}

# word or phrase -> the word that stands for it
SYNONYMS = {
    "records": "rows", "record": "rows", "entries": "rows", "entry": "rows", "observations": "rows",
    "observation": "rows", "instances": "rows", "instance": "rows", "samples": "rows", "examples": "rows",
    "example": "rows", "items": "rows", "item": "rows", "lines": "rows", "line": "rows",
    "best": "highest", "top": "highest", "maximum": "highest", "largest": "highest", "greatest": "highest",
    "most": "highest", "leading": "highest", "peak": "highest",
    "worst": "lowest", "bottom": "lowest", "minimum": "lowest", "smallest": "lowest", "least": "lowest",
    "fewest": "lowest",
    "mean": "average", "avg": "average",
    "how many": "count", "total": "count", "number of": "count",
    "display": "show", "give": "show", "send": "show", "fetch": "show", "get": "show",
    "view": "show", "list": "show", "print": "show", "provide": "show", "output": "show",
    "return": "show",
}

# order decides ties
INTENTS = {
    "SHOW_DATA": [
        "show", "display", "give", "send", "list", "print", "fetch", "get", "view", "see",
        "present", "output", "return", "render", "first", "last", "top", "bottom", "sample",
        "preview", "example", "rows", "row", "records", "record", "entries", "entry", "data",
        "observations", "observation", "instances", "instance"],
    "AGGREGATION": [
        "average", "avg", "mean", "sum", "total", "count", "max", "min", "maximum", "minimum",
        "highest", "lowest", "best", "worst", "largest", "smallest", "most", "least", "top",
        "bottom", "median", "mode", "std", "variance", "range", "percentage", "percent",
        "proportion", "ratio", "rate", "growth", "trend"],
    "VISUALIZATION": [
        "plot", "chart", "graph", "visualize", "visualise", "draw", "create", "bar", "pie",
        "line", "scatter", "column"],
    "METADATA": [
        "schema", "columns", "column", "describe", "description", "fields", "field", "datatypes",
        "datatype", "metadata", "structure", "info"],
}

STOP_WORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do",
    "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can", "need",
    "dare", "ought", "used", "to", "of", "in", "on", "at", "by", "for", "with", "about", "from",
    "into", "through", "during", "before", "after", "above", "below", "between", "out", "off",
    "over", "under", "then", "once", "here", "there", "when", "where", "why", "how", "all", "both",
    "each", "more", "other", "such", "no", "nor", "not", "only", "same", "so", "than", "too",
    "very", "just", "me", "my", "myself", "we", "our", "you", "your", "he", "him", "his", "she",
    "her", "it", "its", "they", "them", "their", "what", "which", "who", "this", "that", "these",
    "those", "i", "and", "or", "but", "if", "as", "up", "any", "make", "go", "let", "please",
]

CONTEXT_WORDS = [
    "row", "rows", "record", "records", "data", "show", "display", "average", "count", "sum",
    "total", "highest", "lowest", "first", "last", "top", "bottom", "sample", "preview", "filter",
    "sort", "group", "visualize", "chart", "graph", "plot", "schema", "column", "field", "missing",
    "null", "duplicate",
]

FOLLOW_UPS = [
    "yes", "ok", "okay", "sure", "next", "more", "show more", "continue", "go on", "and", "also",
    "what about", "explain", "show next", "next 10", "next page",
]

DATASET_PATTERNS = [
    r"\b(show|display|give|send|fetch|get|list|print|view|see)\b",
    r"\b(top|bottom|first|last)\s*(\d+)?\b",
    r"\b(sample|preview|example|examples)\b",
    r"\b(count|sum|avg|average|mean|max|min|total|highest|lowest|best|worst)\b",
    r"\b(filter|where|group\s+by|order\s+by|sort|rank)\b",
    r"\b(distribution|trend|pattern|outlier|correlation|insight)\b",
    r"\b(missing|null|duplicate|unique|distinct|blank|empty)\b",
    r"\b(row|rows|record|records|entry|entries|column|columns|field|fields)\b",
    r"\b(dataset|table|data|database)\b",
    r"\b(compare|versus|vs\.?|between)\b",
    r"\b(visuali[sz]e|chart|graph|plot|scatter|bar|pie|column)\b",
    r"\b(percentage|percent|proportion|share|ratio)\b",
    r"\b(year|month|date|quarter|period)\b",
    r"\b\d+\s*(rows?|records?|entries|items?)\b",
]

OFF_TOPIC_PATTERNS = [
    r"\bjoke\b", r"\bfunny\b", r"\blaugh\b", r"\bweather\b", r"\bforecast\b",
    r"\bprime minister\b", r"\belection\b", r"\bpolitics\b", r"\bcricket score\b", r"\bipl\b",
    r"\brecipe\b", r"\bcooking\b",
    r"\bwrite (a |an )?(poem|story|essay|code|program|function)\b",
    r"\btranslate\b", r"\bstock price\b", r"\bcrypto\b", r"\bbitcoin\b", r"\bnews\b",
    r"\bmovie\b", r"\bfilm\b", r"\bsong\b", r"\bmusic\b", r"\bchatgpt\b", r"\bopenai\b",
    r"\bsolve (this )?(math|equation|problem)\b", r"\btell me a\b", r"\bwho is the\b",
    r"\bwhat is \w+coin\b",
]

# substring rules of the fast intent check, most specific group first
CHART_PHRASES = [
    "plot", "chart", "bar chart", "pie chart", "line chart", "scatter", "histogram", "visualize",
    "visualise", "visualize it", "visualise it", "visualize this", "visualise this", "graph",
    "donut", "area chart", "show graph", "show chart", "create chart", "create a chart",
    "plot data", "analyze visually", "analyse visually", "visual", "draw chart", "generate chart",
    "make chart", "show plot", "show me a chart", "show a chart", "give me a chart",
]
SCHEMA_PHRASES = [
    "show columns", "list columns", "describe", "what columns", "column names", "data types",
    "schema", "metadata", "what are the columns", "show schema",
]
QUERY_PHRASES = [
    "show", "display", "give", "send", "fetch", "list", "view", "get", "first", "last", "top",
    "bottom", "sample", "preview", "example", "count", "average", "total", "sum", "minimum",
    "maximum", "highest", "lowest", "best", "worst", "filter", "where", "group by", "order by",
    "sort", "distinct", "unique", "missing", "null", "duplicate", "rows", "records", "entries",
    "select", "how many", "show all",
]

# substring rules that send a question to an operator, tried in this order
ROUTES = {
    "count": ["count", "how many", "total rows", "number of rows"],
    "rows": ["top", "first", "head", "preview", "show"],
    "duplicates": ["duplicate", "duplicated", "repeated"],
    "missing": ["missing", "null", "empty", "blank"],
    "distinct": ["unique", "distinct"],
    "highest": ["highest", "maximum", "max", "largest", "most"],
    "lowest": ["lowest", "minimum", "min", "smallest", "least"],
    "average": ["average", "mean", "avg"],
}
PLAIN_ROW_PHRASES = ["first", "preview", "show all", "show me"]

NUMERIC_NAME_HINTS = [
    "count", "sum", "total", "amount", "price", "sales", "revenue", "qty", "quantity", "age",
    "score", "rate", "value", "num", "number", "confirmed", "deaths", "recovered", "cases",
    "population", "salary", "profit",
]
DATE_NAME_HINTS = ["date", "time", "year", "month", "day"]
