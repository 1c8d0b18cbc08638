"""Path rules: language, exclusions and repository scope."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Slug | content type | structured | suffixes.
LANGUAGE_ROWS = """
python     | text/x-python        | yes | .py .pyi
javascript | text/javascript      | yes | .js .mjs .cjs
jsx        | text/jsx             | yes | .jsx
typescript | text/typescript      | yes | .ts .mts .cts
tsx        | text/tsx             | yes | .tsx
java       | text/x-java-source   | no  | .java
c          | text/x-c             | no  | .c .h
cpp        | text/x-c++           | no  | .cc .cpp .cxx .hpp .hh .hxx
csharp     | text/x-csharp        | no  | .cs
go         | text/x-go            | no  | .go
rust       | text/x-rust          | no  | .rs
ruby       | text/x-ruby          | no  | .rb
php        | text/x-php           | no  | .php
sql        | text/x-sql           | no  | .sql
markdown   | text/markdown        | no  | .md .markdown
json       | application/json     | no  | .json
yaml       | application/yaml     | no  | .yml .yaml
toml       | application/toml     | no  | .toml
shell      | text/x-shellscript   | no  | .sh .bash
html       | text/html            | no  | .html .htm
css        | text/css             | no  | .css .scss
text       | text/plain           | no  | .txt .rst .cfg .ini .env
"""
# Files known by name alone.
NAMED_FILES = {"dockerfile": "text", "makefile": "text", "readme": "markdown", "license": "text"}

# Directories never indexed.
EXCLUDED_DIRECTORIES = (
    ".git .hg .svn node_modules bower_components vendor .venv venv env site-packages "
    "__pycache__ .mypy_cache .pytest_cache .ruff_cache .tox dist build out target obj "
    ".next .nuxt .turbo .gradle .terraform coverage htmlcov .idea .vscode"
).split()
# Generated files never indexed.
EXCLUDED_NAMES = (
    "package-lock.json yarn.lock pnpm-lock.yaml poetry.lock cargo.lock composer.lock "
    "gemfile.lock go.sum"
).split()
EXCLUDED_SUFFIXES = (".min.js", ".min.css", ".bundle.js", ".map", ".lock")

MAX_PATH_CHARS = 1_000


def language_rows() -> list[tuple[str, str, bool, str]]:
    """(slug, content type, structured, suffix or whole name) per lookup key."""
    rows, by_slug = [], {}
    for line in LANGUAGE_ROWS.strip().splitlines():
        slug, content_type, structured, suffixes = (part.strip() for part in line.split("|"))
        by_slug[slug] = (slug, content_type, structured == "yes")
        rows += [(*by_slug[slug], suffix) for suffix in suffixes.split()]
    return rows + [(*by_slug[slug], name) for name, slug in NAMED_FILES.items()]


def language_of(path: Column) -> Column:
    """Struct (slug, content_type, parseable) of a path, null when unsupported.

    The fixed table is a constant map in the expression, so no join is planned for it.
    """
    entries = []
    for slug, content_type, parseable, key in language_rows():
        entries += [
            F.lit(key),
            F.struct(
                F.lit(slug).alias("slug"),
                F.lit(content_type).alias("content_type"),
                F.lit(parseable).alias("parseable"),
            ),
        ]
    return F.try_element_at(F.create_map(*entries), language_key(path))


def file_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def language_key(path: Column) -> Column:
    """Last suffix, else the whole name. A leading dot starts no suffix, so ``.env`` has no key."""
    name = file_name(path)
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return F.when(suffix != "", suffix).when(~name.startswith("."), name)


def exclusion_reason(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    directories = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    name = file_name(path)
    generated = name.isin(*EXCLUDED_NAMES)
    for suffix in EXCLUDED_SUFFIXES:
        generated = generated | name.endswith(suffix)
    banned = F.array(*(F.lit(name) for name in EXCLUDED_DIRECTORIES))
    return F.when(F.arrays_overlap(directories, banned), "excluded_directory").when(
        generated, "excluded_file"
    )


def in_repository_scope(path: Column, max_chars: int = MAX_PATH_CHARS) -> Column:
    """A plain relative path: no root, drive, backslash, NUL, empty, dot or dot-dot part."""
    cleaned = F.trim(path)
    segments = F.split(cleaned, "/")
    return F.coalesce(
        (F.length(cleaned).between(1, max_chars))
        & ~cleaned.contains("\\")
        & ~cleaned.contains("\x00")
        & (F.substring(cleaned, 2, 1) != ":")
        & ~F.exists(segments, lambda part: part.isin("", ".", "..")),
        F.lit(False),
    )


def is_env_file(path: Column) -> Column:
    """``.env`` and its variants, but not templates meant to be shared."""
    return file_name(path).rlike(r"^\.env(\..+)?$") & ~file_name(path).rlike(
        r"\.(example|sample|template)$"
    )
