"""Path predicates and path parts as Column expressions, with the fixed values that they use."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions and their languages.
LANGUAGES = {".rs": "rust", ".ts": "ts", ".tsx": "tsx", ".js": "js", ".mjs": "js", ".cjs": "js", ".jsx": "jsx", ".py": "py", ".md": "md", ".markdown": "md"}
# Directories that are never indexed, at any depth and in any case (and this project's own).
SKIPPED = (
    ".git .hg .svn .canopyql .idea .vscode .cache node_modules bower_components jspm_packages .pnpm-store .yarn vendor deps site-packages "
    "target dist build out output outputs coverage .next .nuxt .svelte-kit .turbo .parcel-cache .gradle Pods DerivedData .venv venv __pycache__ "
    ".tox .mypy_cache .pytest_cache .ruff_cache archive archives .agents .claude .cursor tmp logs"
).split()
SKIPPED_PATTERN = r"(?i)(^|/)(third[-_]party|" + "|".join(re.escape(d) for d in SKIPPED) + ")(/|$)"
# Paths of bundled code and of tests.
VENDOR_PATTERN = r"(^|/)(node_modules|vendor|third_party|thirdparty|external|extern|\.cargo|registry|site-packages|dist-packages|Godeps)(/|$)"
TEST_PATTERN = r"(?i)(^|/)(tests?|__tests__|specs?|samples?|bench|benchmarks?)(/|$)|\.(test|spec|_test|_spec)\.[a-z]+$"
MAX_BYTES = 2 * 1024 * 1024


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language(path: Column) -> Column:
    """The language by extension; null for files that are not indexed."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), extension(path))


def family(path: Column) -> Column:
    """Names are linked within a family; ``other`` goes with every family."""
    return F.when(path.endswith(".rs"), "rs").when(path.rlike(r"\.(ts|tsx|js|jsx|mjs)$"), "ts").otherwise("other")


def is_vendor(path: Column) -> Column:
    return path.rlike(VENDOR_PATTERN)


def is_test(path: Column) -> Column:
    return path.rlike(TEST_PATTERN)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def under(path: Column, prefix: Column) -> Column:
    """path is prefix or lies below it."""
    return (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def prefixes(path: Column) -> Column:
    """All leading parts of a path, itself included: the equi-join form of a longest-prefix match."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def skipped(path: Column, extra: list[str] | None = None) -> Column:
    """Excluded from indexing: the fixed directories, and extra names, prefixes or * patterns from the root."""
    out = path.rlike(SKIPPED_PATTERN)
    for raw in extra or []:
        v = raw.strip().replace("\\", "/").removeprefix("./").strip("/")
        if not v:
            continue
        if "*" in v:
            out = out | path.rlike("^" + "[^/]*".join(re.escape(x) for x in v.split("*")) + "(/|$)")
        elif "/" in v:
            out = out | under(path, F.lit(v))
        else:
            out = out | F.array_contains(F.split(path, "/"), v)
    return out
