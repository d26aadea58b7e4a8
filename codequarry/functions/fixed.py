"""Fixed values that results depend on: word lists, tables, patterns and formats.

Fixed values, in natural order.
"""

SKIP_DIRS = [
    "node_modules", ".yarn", ".pnp", ".venv", "venv", "__pycache__", ".eggs", "dist", "build", "target", "out", "_build", "cmake-build-debug", "cmake-build-release",
    ".git", ".svn", ".hg", ".idea", ".vscode", "vendor", "third_party", "third-party", "generated", ".cache", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".codequarry", "_repos",
]
SKIP_FILES = ["package-lock.json", "yarn.lock", "Pipfile.lock", "poetry.lock", "Cargo.lock", "composer.lock", "Gemfile.lock", "go.sum", ".DS_Store", "Thumbs.db"]
CODE_EXTENSIONS = [
    ".py", ".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx", ".java", ".kt", ".scala", ".go", ".rs", ".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".cs", ".rb", ".php", ".swift", ".dart", ".lua",
    ".sh", ".bash", ".zsh", ".fish", ".r", ".md", ".rst", ".toml", ".yaml", ".yml", ".json", ".xml", ".html", ".css", ".scss", ".sql", ".tf", ".proto",
]
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".webp", ".tiff", ".raw", ".mp3", ".wav", ".ogg", ".flac", ".mp4", ".avi", ".mkv", ".mov",
    ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar", ".whl", ".jar", ".war", ".ear", ".apk", ".ipa", ".pyc", ".pyo", ".so", ".dll", ".dylib", ".exe", ".o", ".a", ".lib", ".pdb", ".class",
    ".ttf", ".otf", ".woff", ".woff2", ".eot", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".db", ".sqlite", ".sqlite3", ".lock",
]
LANGUAGE_BY_EXTENSION = {
    ".py": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".kt": "kotlin", ".scala": "scala",
    ".go": "go", ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".cs": "csharp", ".rb": "ruby", ".php": "php", ".swift": "swift", ".dart": "dart", ".lua": "lua",
    ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".fish": "shell", ".r": "r", ".sql": "sql", ".proto": "protobuf",
}
MAX_FILE_BYTES = 1_000_000
GITHUB_URL = r"^https?://github\.com/([^/]+)/([^/]+?)(?:\.git)?/?$"

STOP_WORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "shall", "should", "may",
    "might", "must", "can", "could", "about", "above", "after", "again", "all", "also", "and", "any", "because", "before", "between", "both", "but", "by",
    "came", "come", "each", "for", "from", "get", "got", "he", "her", "here", "him", "his", "how", "i", "if", "in", "into", "it", "its", "just", "let", "like",
    "make", "many", "me", "more", "most", "much", "my", "no", "not", "now", "of", "on", "one", "only", "or", "other", "our", "out", "over", "own", "said",
    "same", "she", "so", "some", "still", "such", "take", "than", "that", "their", "them", "then", "there", "these", "they", "this", "those", "through", "to",
    "too", "under", "up", "us", "very", "want", "way", "we", "well", "what", "when", "where", "which", "while", "who", "whom", "why", "with", "you", "your",
    "tell", "explain", "show", "describe", "give", "please", "code", "codebase", "repository", "repo", "project", "work", "works", "used", "using", "use",
]

#: Question types in the order of their tests: by the question's beginning, then by words it holds.
QUESTION_STARTS = [
    ("how", ["how does", "how do", "how is", "how are", "how to"]),
    ("what", ["what does", "what do", "what is", "what are", "what's"]),
    ("why", ["why does", "why do", "why is", "why are"]),
    ("where", ["where does", "where do", "where is", "where are"]),
    ("list", ["list", "enumerate", "show all", "find all"]),
]
QUESTION_WORDS = [
    ("compare", ["difference between", "compare", "vs", "versus"]),
    ("purpose", ["purpose", "role", "responsible", "does this do", "does it do"]),
    ("overview", ["architecture", "structure", "overview", "organize", "layout"]),
    ("debug", ["error", "bug", "issue", "fix", "wrong", "fail", "broken"]),
]

MAX_CODE_CHARS = 8000
TRUNCATED = "\n... [truncated]"
EXPANSION_DECAY = 0.7
BLOCK_OVERHEAD_TOKENS = 6
NO_CONTEXT = "(no code context available)"
FALLBACK_ANSWER = "I don't have enough context to answer this question. No relevant code chunks were found in the index."
