"""Constants that results depend on. Everything in this file is a fixed value."""

# ---- risk scoring (fixed values) ----
ROLLING_ROWS = 50
VOLATILITY_LIMIT = 1.5
DEVIATION_FACTOR = 3.0
WEIGHT_VOLATILITY = 0.40
WEIGHT_DEVIATION = 0.35
WEIGHT_FRAUD = 0.25
HIGH_RISK = 0.6
SUSPICIOUS_RISK = 0.2
RISKY_EDGE = 0.5

# ---- severity buckets: (label, upper bound); the last one takes the rest (fixed values) ----
NO_RISK_LABEL = "0.00 (No Risk)"
SEVERITY_BUCKETS = [
    ("0.01–0.25 (Low)", 0.25),
    ("0.26–0.50 (Medium)", 0.50),
    ("0.51–0.75 (High)", 0.75),
]
CRITICAL_LABEL = "0.76–1.00 (Critical)"

# ---- limits (fixed values) ----
LEDGER_ROWS = 10
TOP_ROWS = 5
GRAPH_PULL = 300
DEFAULT_MAX_EDGES = 150
MAX_EDGES_RANGE = (10, 500)
MIN_RISK_RANGE = (0.0, 1.0)

# ---- channel of a transaction type: first rule with a contained word wins (fixed values) ----
CHANNEL_RULES = [
    ("Wire Transfer", ["structuring", "laundering", "smurfing", "wire"]),
    ("Card Purchase", ["takeover", "card", "purchase"]),
    ("Shell Transfer", ["layering", "investment", "shell"]),
]
CHANNEL_DEFAULT = "Transfer"
LEDGER_STATUS = "High Risk"

# ---- country codes, default us (fixed values) ----
COUNTRY_CODES = {
    "Nigeria": "ng",
    "Iran": "ir",
    "Myanmar": "mm",
    "Russia": "ru",
    "China": "cn",
    "United Arab Emirates": "ae",
    "Germany": "de",
    "United Kingdom": "gb",
    "Singapore": "sg",
    "United States": "us",
}
COUNTRY_CODE_DEFAULT = "us"

# ---- map fallback per country name: (risk, transactions) (fixed values) ----
COUNTRY_FALLBACK = {
    "United States": (0.72, 1420),
    "United States of America": (0.72, 1420),
    "Canada": (0.15, 450),
    "Mexico": (0.38, 230),
    "Brazil": (0.35, 350),
    "United Kingdom": (0.78, 890),
    "Germany": (0.81, 950),
    "Russia": (0.89, 410),
    "Nigeria": (0.82, 280),
    "Iran": (0.95, 120),
    "China": (0.86, 1800),
    "India": (0.50, 1500),
    "Myanmar": (0.93, 95),
    "Japan": (0.25, 620),
    "Australia": (0.20, 310),
    "South Africa": (0.30, 240),
    "Singapore": (0.75, 530),
    "Saudi Arabia": (0.45, 180),
    "United Arab Emirates": (0.84, 340),
}
REGION_RISK_DEFAULT = 0.15
REGION_COUNT_DEFAULT = 150

# ---- colour ramps (fixed values) ----
RISK_RAMP_FROM = (254, 226, 226)
RISK_RAMP_TO = (239, 68, 68)
RISK_RAMP_START = 0.2
RISK_FAINT = "rgba(239, 68, 68, 0.04)"
COUNT_RGB = (59, 130, 246)
COUNT_RAMP_START = 100
COUNT_RAMP_END = 2000
FAINT_OPACITY = 0.04

# ---- graph view (fixed values) ----
COMMUNITY_PALETTE = [
    "#4f46e5", "#10b981", "#f59e0b", "#ef4444", "#8b5cf6",
    "#ec4899", "#06b6d4", "#14b8a6", "#f97316", "#a855f7",
]
WEB_PALETTE = [
    "#6366f1", "#10b981", "#f59e0b", "#ef4444",
    "#8b5cf6", "#ec4899", "#06b6d4", "#14b8a6",
]
RISKY_EDGE_COLOR = "#f43f5e"
EDGE_COLOR = "#cbd5e1"
NODE_SIZE_BASE = 10
NODE_SIZE_PER_DEGREE = 4
RING_LABEL = "Fraud Syndicate Ring #"
CUSTOMER_PREFIX = "CUS"
ACCOUNT_PREFIX = "ACC"

# ---- knowledge base (fixed values) ----
CHUNK_WORDS = 300
PARAGRAPH_JOIN = "\n\n"
CHUNK_ID_FORMAT = "chunk_%04d"
PREVIEW_CHARS = 80
TOP_K = 5
VECTOR_LISTS = 5
CONTEXT_JOIN = "\n\n---\n\n"
NO_CONTEXT = "No relevant context found in the knowledge base."
TASK_DOCUMENT = "RETRIEVAL_DOCUMENT"
TASK_QUERY = "RETRIEVAL_QUERY"

# ---- query routing (fixed values) ----
FLASH_KEYWORDS = [
    "risk score",
    "quick",
    "current",
    "summary",
    "how much",
    "calculate",
    "total",
    "count",
    "average",
    "list",
    "show me",
    "what is the",
    "status",
    "balance",
]
TOPIC_RULES = [
    ("wire", ["wire"]),
    ("kyc", ["kyc", "escalat"]),
    ("credit", ["credit", "warn"]),
]
TOPIC_DEFAULT = "other"
FLASH_MODEL = "gemini-2.5-flash"
PRO_MODEL = "gemini-2.5-pro"
FLASH_LABEL_WORDS = ["Flash", "Simulated"]

# ---- frame of a prompt (fixed values) ----
PROMPT_CONTEXT = ("--- KNOWLEDGE BASE CONTEXT ---", "--- END CONTEXT ---")
PROMPT_SOURCES = "Source documents used: "
PROMPT_QUESTION = "User Question: "
