"""Word lists and tables that results depend on."""

# Words left out of full-text queries.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could "
    "should may might can in on at to for of and or but if with by from as it its "
    "i me my we our you your he she his her they their what which who how when "
    "where why this that these those"
).split()

# Directories that are never entered.
IGNORED_DIRS = (
    ".git .github .svn .hg "
    "__pycache__ .venv venv .tox .pytest_cache .mypy_cache VectorEnv htmlcov .eggs "
    "node_modules .next .nuxt .output .expo .turbo .nx dist build out storybook-static "
    "public mocks playwright-report test-results .gradle .m2 target .cargo "
    ".terraform .serverless .firebase .idx genkit .gemini "
    ".idea .vs .vscode .continue .claude .ollama .redhat .cache "
    "Modelfiles .code-index .fileSystem-index .obsidian AppData .rustup google-cloud-sdk"
).split() + [
    "Saved Games",
    "My Games",
    "American Truck Simulator",
    "Euro Truck Simulator 2",
    "Rockstar Games",
    "Telltale Games",
    "Paradox Interactive",
    "Epic Games",
    "steamapps",
]

# A directory that is entered only below the parent named.
ONLY_BELOW = {"functions": "firebase"}

# Extensions of files that are not indexed.
IGNORED_EXTS = (
    ".pyc .pyo .so .dll .exe .bin .wasm .obj .o "
    ".zip .tar .gz .bz2 .xz .7z .rar .jar .whl .egg "
    ".png .jpg .jpeg .gif .bmp .tiff .tif .webp .ico .svg .heic .raw "
    ".mp3 .mp4 .avi .mov .mkv .wav .flac .ogg .m4a "
    ".ttf .otf .woff .woff2 .eot "
    ".db .sqlite .sqlite3 .mdb .accdb "
    ".lock .DS_Store .class .pdb .lib .a .faiss .map "
    ".iso .gpg .aes .tmp .swp .dat .parquet .log "
    ".sii .navcache .scs .sav .save .vdf"
).split()

# Names of files that are not indexed, and beginnings of such names.
IGNORED_NAMES = (
    ".env credentials.json service-account.json .DS_Store Thumbs.db desktop.ini "
    "package-lock.json yarn.lock pnpm-lock.yaml poetry.lock Pipfile.lock Cargo.lock "
    "composer.lock Gemfile.lock"
).split()
IGNORED_PREFIXES = [".env."]

OOXML = "application/vnd.openxmlformats-officedocument"

# MIME type by extension.
MIME_BY_EXT = {
    ".docx": f"{OOXML}.wordprocessingml.document",
    ".doc": "application/msword",
    ".xlsx": f"{OOXML}.spreadsheetml.sheet",
    ".xls": "application/vnd.ms-excel",
    ".pptx": f"{OOXML}.presentationml.presentation",
    ".ppt": "application/vnd.ms-powerpoint",
    ".md": "text/markdown",
    ".txt": "text/plain",
    ".csv": "text/csv",
    ".html": "text/html",
    ".htm": "text/html",
    ".xml": "text/xml",
    ".json": "application/json",
    ".yaml": "text/yaml",
    ".yml": "text/yaml",
    ".toml": "application/toml",
    ".pdf": "application/pdf",
    ".rs": "text/x-rust",
    ".py": "text/x-python",
    ".js": "text/javascript",
    ".jsx": "text/javascript",
    ".ts": "text/typescript",
    ".tsx": "text/typescript",
    ".go": "text/x-go",
    ".java": "text/x-java",
    ".c": "text/x-c",
    ".cpp": "text/x-c++",
    ".cxx": "text/x-c++",
    ".cc": "text/x-c++",
    ".h": "text/x-c",
    ".hpp": "text/x-c",
    ".cs": "text/x-csharp",
    ".rb": "text/x-ruby",
    ".sh": "text/x-sh",
    ".sql": "text/x-sql",
    ".kt": "text/x-kotlin",
    ".swift": "text/x-swift",
    ".r": "text/x-r",
    ".ini": "text/plain",
    ".env": "text/plain",
}
DEFAULT_MIME = "application/octet-stream"

# Chunking method by MIME type; the label of all others.
METHODS = {
    f"{OOXML}.spreadsheetml.sheet": "xlsx/v1",
    "text/markdown": "markdown/v1",
    "text/plain": "plaintext/v1",
    "application/pdf": "pdf/v1",
    f"{OOXML}.wordprocessingml.document": "docx/v1",
    "text/csv": "csv/v1",
    "text/typescript": "typescript/v1",
    "text/javascript": "typescript/v1",
    "application/javascript": "typescript/v1",
    "text/x-rust": "rust/v1",
    "text/x-python": "plaintext/v1",
    "_default": "generic/v1",
}
LAST_METHOD = "generic/v1"

# Symbols spelt out in names and queries.
SYMBOLS = {"c++": " cpp ", "c#": " csharp ", "f#": " fsharp ", ".net": " dotnet "}

MAX_FILE_SIZE = 50 * 1024 * 1024
LIKE_PREFIX = 64 * 1024
TIER1_TOKENS, TIER2_TOKENS = 500, 1500
BYTES_PER_TOKEN = 3
STRUCTURAL_THRESHOLD, COHERENCE_THRESHOLD = 50, 0.6
RRF_K = 60
EDGE_TYPES = ("LINKS_TO", "REFERENCES", "EMBEDS")
