"""Fixed values that results depend on: word lists, patterns and weights."""

# Characters trimmed from both ends of a token.
PUNCTUATION = ".,;:!?\"'()[]{}/\\<>|=+-_*&^%$#@~`"
# The index rebuild trims the same set without the pipe character.
PUNCTUATION_REBUILD = ".,;:!?\"'()[]{}/\\<>=+-_*&^%$#@~`"

IDENTIFIER = "[A-Za-z_][A-Za-z0-9_./-]*"
PATH_TOKEN = "[A-Za-z0-9_.-]+"

ENTITY_ANCHORS = ["client", "handler", "service", "api", "task", "k8s", "module"]
SHAPE_ANCHORS = ["client", "handler", "service", "api", "task", "k8s"]
TECH_ANCHORS = ["grpc", "proto", "protobuf", "api", "service", "client", "server", "handler", "router", "endpoint", "redis", "kafka", "db", "sql", "queue"]
VAGUE_PHRASES = ["how it works", "general explanation", "architecture overview", "explain the code", "overview of system"]
HYDE_SKIP = ["implementation", "source code", "line", "function", "class", "file:"]

ARCHITECTURAL = [
    r"how\s+(are\s+we\s+)?using\s+",
    r"how\s+does\s+.*\s+work",
    r"what\s+is\s+the\s+(role|flow|process|lifecycle|pipeline)\s+of",
    r"explain\s+the\s+.*\s+(architecture|design|structure)",
    r"where\s+is\s+.*\s+(used|called|invoked)",
    r"which\s+components?\s+(use|call|depend)",
    r"describe\s+the\s+.*\s+(system|architecture|design)",
    r"what\s+components?\s+(are\s+involved|participate)",
    r"how\s+(do|does)\s+.*\s+(integrate|connect|communicate)",
    r"trace\s+the\s+.*\s+(path|flow|execution)",
]
IMPLEMENTATION = [
    r"where\s+is\s+.*\s+implemented",
    r"find\s+the\s+(implementation|source\s+code|definition)",
    r"show\s+me\s+the\s+(code|implementation|function|method)",
    r"what\s+(file|function|method|class)\s+",
    r"locate\s+",
    r"define\s+",
    r"signature\s+of",
]
FLOW_WORDS = ["flow", "process", "pipeline", "sequence"]
USAGE_WORDS = ["using", "work", "integrate", "connect"]
SYMBOLS = [r"\b([A-Z][A-Za-z0-9_]+(?:\.[A-Z][A-Za-z0-9_]+)*)\b", r"\b([a-z_][a-z0-9_]*(?:\.[a-z_][a-z0-9_]*)*)\b", r"\b([A-Z_]{2,})\b"]
ARCH_EXPANSIONS = ["request processing flow entry point handler", "integration dependencies call chain", "component interaction data flow"]
USAGE_PATHS = [["service", "handler", "controller"], ["middleware", "pipeline"], ["adapter", "connector"]]
USAGE_NAMES = ["handle", "process", "execute", "run", "start", "init"]

RATE_LIMIT_MARKS = ["429", "rate_limit", "too many requests"]
TRANSIENT_MARKS = ["connect", "timeout", "temporarily", "unavailable", "503", "502", "504"]

RRF_K = 10
K1, B = 1.5, 0.75
EXACT_BOOST = 0.35
BASE_K, MAX_K = 20, 50
CONFIDENCE_LIMIT, MIN_EVIDENCE = 0.58, 2
MRR_GATE, RECALL5_GATE = 0.15, 0.20
MAX_CHUNK_CHARS, MAX_PROMPT_CHARS = 2000, 30000
CHUNK_LINES = 200

LANGUAGES = {
    ".go": "go", ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "jsx", ".java": "java", ".rs": "rust", ".c": "c", ".h": "c",
    ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".sh": "bash", ".bash": "bash",
    ".sql": "sql", ".html": "html", ".htm": "html", ".css": "css", ".scss": "css", ".less": "css", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".lua": "lua", ".dockerfile": "dockerfile",
}
EXTRACTORS = {".go": "go", ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "typescript", ".jsx": "typescript"}
SKIPPED = [
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".svg", ".bmp", ".tiff", ".mp3", ".mp4", ".wav", ".avi", ".mov", ".zip", ".tar", ".gz", ".rar", ".7z", ".pdf", ".doc", ".docx",
    ".xls", ".xlsx", ".woff", ".woff2", ".ttf", ".eot", ".exe", ".so", ".dylib", ".dll", ".DS_Store", ".lock", ".min.js", ".min.css", ".map", ".wasm", ".pickle", ".pkl",
]
# Metric histograms: upper bucket edges in seconds.
LATENCY_BUCKETS = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0]
