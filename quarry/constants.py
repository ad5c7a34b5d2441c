"""Fixed values.

Everything in this module is a value that must equal the behaviour being
re-implemented (file-type lists, ignore lists, size limits, markers, model
routing defaults). They are listed plainly, in natural order, in one place.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: directory names skipped by the index scan (S1). The last entry
# is this engine's own index folder.
INDEX_IGNORE_DIRS = [
    "vendor", "node_modules", ".git", "bin", "obj", "var", "cache",
    ".venv", "venv", "__pycache__", "dist", "build", ".quarry",
]

# FIXED VALUES: file extensions the index scan keeps (S1), compared lower-cased.
INDEX_EXTENSIONS = [
    ".py", ".php", ".cs", ".ts", ".js", ".java", ".kt", ".go",
    ".rb", ".rs", ".c", ".cpp", ".h", ".jsx", ".tsx", ".vue",
    ".yaml", ".yml", ".toml", ".json", ".md",
]

# FIXED VALUES: directory names skipped by the code scan.
CODE_IGNORE_DIRS = [
    "vendor", "node_modules", ".git", "bin", "obj", "var", "cache",
    ".venv", "__pycache__", "dist", "build",
]

# FIXED VALUES: file extensions the code scan keeps.
CODE_EXTENSIONS = [
    ".py", ".php", ".cs", ".ts", ".js", ".java", ".kt", ".go",
    ".rb", ".rs", ".c", ".cpp", ".h", ".jsx", ".tsx", ".vue",
]

# FIXED VALUES: language map (ext, language, test framework, test prefix,
# test suffix).
LANGUAGE_MAP = [
    (".py", "Python", "pytest", "test_", ".py"),
    (".php", "PHP", "phpunit", "", "Test.php"),
    (".cs", "C#", "xunit", "", "Tests.cs"),
    (".kt", "Kotlin", "junit", "", "Test.kt"),
    (".ts", "TypeScript", "jest", "", ".spec.ts"),
    (".js", "JavaScript", "jest", "", ".spec.js"),
]
GENERIC_LANGUAGE = "Generic"

# FIXED VALUES: chunking (G1).
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200

# FIXED VALUES: payload limits and the marker of a cut file. (The notice of a
# cut payload is free text.)
MAX_PAYLOAD_CHARS = 15000
PAYLOAD_TRUNCATION_NOTICE = (
    "\n\n[cut here: the rest of the change set does not fit this prompt]"
)
MAX_FILE_CHARS = 30000
TRUNCATED_MARKER = "\n...[truncated]"
CHARS_PER_TOKEN = 3
QUERY_PREFIX_CHARS = 500
PREVIEW_CHARS = 500
DEDUP_PREFIX_CHARS = 100

# FIXED VALUES: edit-block pattern (G2; lazy, dot matches newline), corpus file
# header (A3), text for a missing file summary (A7), viewer placeholder.
EDIT_BLOCK_RE = r"(?s)<{4}\s*SEARCH\s+file:(.+?)\n(.*?)\n={4}\s*REPLACE\n(.*?)\n>{4}"
FILE_HEADER = "### File: "
FAILED_SUMMARY = "(Failed to summarize)"
WAITING_TEXT = "Waiting for response..."

# FIXED VALUES: verdict sentinel (T12) and the reasoning tags.
ALL_CLEAR_SENTINEL = "NO_VULNERABILITIES_FOUND"
THINK_OPEN = "<think>"
THINK_CLOSE = "</think>"

# FIXED VALUES: document types, in job order, with their display labels.
DOC_TYPES = [
    ("tutorial", "Tutorial"),
    ("howto", "How-to Guide"),
    ("reference", "Reference"),
    ("explanation", "Explanation"),
]

# FIXED VALUES: probe texts for the sampled analysis plan (G4), in order.
PROBES = [
    "Core domain logic, business rules, and service layer",
    "API endpoints, controllers, and route handlers",
    "Database models, repositories, and data access layer",
    "Configuration, dependency injection, and bootstrapping",
    "Error handling, validation, and exception management",
]

# FIXED VALUES: retrieval query prefixes (T5).
REVIEW_QUERY_PREFIX = "Classes, interfaces, and modules related to: "
AUDIT_QUERY_PREFIX = "Callers, usages, or inputs to: "
TESTS_QUERY_PREFIX = "Dependencies, interfaces, or traits used by "

# FIXED VALUES: model routing defaults (J10): purpose, model ('' = default
# model), context size, output cap.
DEFAULT_MODEL = "gemma4"
EMBEDDING_MODEL = "nomic-embed-text"
DEFAULT_NUM_CTX = 8192
DEFAULT_NUM_PREDICT = 4096
ROUTES = [
    ("coding", "", 8192, 4096),
    ("fast", "", 4096, 512),
    ("review", "", 12288, 4096),
    ("embedding", EMBEDDING_MODEL, DEFAULT_NUM_CTX, DEFAULT_NUM_PREDICT),
]
# Purposes checked against the installed model catalog (J9), in report order.
CHECKED_PURPOSES = ["default", "fast", "coding", "review"]

# FIXED VALUES: default retrieval depth and embedding width.
TOP_K = 5
EMBED_DIM = 256
