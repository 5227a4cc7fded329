"""Table schemas and fixed value tables."""

from __future__ import annotations

from pyspark.sql import types as T

SYMBOL = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("signature", T.StringType()),
        T.StructField("doc_comment", T.StringType()),
        T.StructField("visibility", T.StringType()),
        T.StructField("line", T.IntegerType()),
    ]
)

# One row per indexed file; key (project, file_path).
FILES = T.StructType(
    [
        T.StructField("project", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("symbols", T.ArrayType(SYMBOL)),
        T.StructField("symbol_names", T.StringType()),
        T.StructField("searchable", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("last_parsed_epoch", T.LongType()),
    ]
)

# One row per import edge; key (project, source_path, target_path, specifier).
IMPORTS = T.StructType(
    [
        T.StructField("project", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("target_path", T.StringType()),
        T.StructField("specifier", T.StringType()),
        T.StructField("symbols", T.ArrayType(T.StringType())),
        T.StructField("updated_at_epoch", T.LongType()),
    ]
)

# One row per path of a project's last version-control status; key (project, path).
# Kept long so that a very dirty tree is many rows and never one giant map.
SNAPSHOTS = T.StructType(
    [
        T.StructField("project", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("updated_at_epoch", T.LongType()),
    ]
)

# Search index: one row per text with its length and its place, one per token and block of texts. A block is a stored
# file of texts; ``gaps`` are the places of a list's texts, each less the one before it, ``tfs`` the token's numbers in them.
DOCS = T.StructType([T.StructField(n, T.StringType()) for n in ("project", "file_path", "block")] + [T.StructField(n, T.LongType()) for n in ("place", "dl")])
POSTINGS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("token", "block")] + [T.StructField(n, T.ArrayType(T.LongType())) for n in ("gaps", "tfs")]
)

# ---- Fixed values: these must equal the established tool's for equal results. ----

LANGUAGE_BY_EXTENSION = {
    "ts": "typescript",
    "tsx": "tsx",
    "js": "javascript",
    "jsx": "javascript",
    "mjs": "javascript",
    "cjs": "javascript",
    "rs": "rust",
    "rb": "ruby",
    "ex": "elixir",
    "exs": "elixir",
}

SKIPPED_DIRECTORIES = (
    "node_modules",
    ".git",
    "dist",
    "build",
    ".next",
    ".nuxt",
    "coverage",
    ".turbo",
    ".cache",
    ".output",
    "target",
    "_build",
    "deps",
    ".elixir_ls",
    "vendor",
    ".bundle",
)

SYMBOL_KINDS = (
    "function", "class", "interface", "type", "enum", "const", "let", "var",
    "struct", "trait", "impl", "macro", "module", "unknown",
)

VISIBILITIES = ("exported", "default_export", "public", "pub_crate", "pub_super", "private")
PUBLIC_VISIBILITIES = ("public", "exported", "default_export", "pub_crate")

# Extensions a JavaScript-family import may resolve to, in probing order.
SCRIPT_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs")

# Extensions that make a word of a prompt look like a file.
MENTION_EXTENSIONS = (
    "ts", "tsx", "js", "jsx", "rs", "rb", "ex", "exs", "py", "go", "java", "c", "h", "cpp", "hpp",
    "css", "scss", "vue", "svelte", "json", "toml", "yaml", "yml", "md",
)

DEFAULT_MAX_DEPTH = 2
DEFAULT_MAX_RESULTS = 20
DEFAULT_SEARCH_LIMIT = 10
ENTRY_SEARCH_LIMIT = 5
SUFFIX_LIMIT = 3
HIGH_FAN_IN = 5
TOOL_LIST_CAP = 8
COMPACT_LIST_CAP = 5
CYCLE_NODE_CAP = 20
