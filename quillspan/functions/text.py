"""Text, path and number functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def search_tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits of more than two bytes, repeats kept."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]", " "), " +"), lambda x: F.octet_length(x) > 2)


STOP_WORDS = tuple("a an and are by does for from how in is of on that the this to what where with".split())


def ranking_tokens(c: Column) -> Column:
    """Distinct lower-case words of letters, digits, ``_`` and ``$``, longer than one character, without stop words."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_$]", " "), " +"), lambda x: F.length(x) > 1)
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, STOP_WORDS)))


def path_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[/._-]+"), lambda x: x != "")


def identifier_words(c: Column) -> Column:
    """``parseHTTPRequest2x`` is parse, http, request2, x: breaks at case changes, after digits and at symbols."""
    spaced = F.regexp_replace(F.regexp_replace(c, r"(\p{Lu}+)(\p{Lu}\p{Ll})", "$1 $2"), r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(spaced, r"[^\p{L}\p{N}]+", " ")), " +"), lambda x: x != "")


def identifier_variants(c: Column) -> Column:
    """Lower-case, compact, snake and kebab spellings, each once."""
    words = identifier_words(c)
    return F.array_distinct(F.array(F.lower(c), F.array_join(words, ""), F.array_join(words, "_"), F.array_join(words, "-")))


def basename(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, r"\\", "/"), "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def path_matches(path: Column, wanted: Column) -> Column:
    """Equal, or ``wanted`` is a suffix at a segment's start."""
    return (path == wanted) | path.endswith(F.concat(F.lit("/"), wanted))


def estimated_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / 4)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def cosine(a: Column, b: Column) -> Column:
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def line_slice(text: Column, first: Column, last: Column) -> Column:
    """Lines first..last (from 1) of a text, clamped to what is there."""
    lines = F.split(text, "\n", -1)
    start = F.greatest(first, F.lit(1))
    return F.array_join(F.slice(lines, start, F.greatest(F.least(last, F.size(lines)) - start + 1, F.lit(0))), "\n")


def truncated(text: Column, most: int = 30) -> Column:
    """The first ``most`` lines, with a line that counts the rest."""
    lines = F.split(text, "\n", -1)
    more = F.size(lines) - most
    return F.when(more > 0, F.concat(F.array_join(F.slice(lines, 1, most), "\n"), F.lit("\n... ("), more.cast("string"), F.lit(" more lines)"))).otherwise(text)


def safe_branch(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9_-]", "_")


def bucket(value: Column, edges: list[tuple[float, str]], last: str) -> Column:
    """The label of the first edge that the value doesn't exceed."""
    out = None
    for edge, label in edges:
        out = F.when(value <= edge, label) if out is None else out.when(value <= edge, label)
    return out.otherwise(last)


def redacted(c: Column) -> Column:
    """Passwords in URLs and values of key-like settings replaced by ``***``."""
    return F.regexp_replace(F.regexp_replace(c, "(://[^:/@ ]+):[^@/ ]+@", "$1:***@"), "(?i)((?:api[_-]?key|token|secret|password)[\"']?[=:] ?)[^ ,;&]+", "$1***")


def glob_regex(pattern: str) -> str:
    """An anchored regex for a glob with ``**``, ``*``, ``?`` and ``{a,b}``; a leading ``**/`` matches the root too."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if ch == "{" and "}" in pattern[i:]:
            out, depth = out + "(?:", depth + 1
        elif ch == "}" and depth:
            out, depth = out + ")", depth - 1
        elif ch == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(ch) or re.escape(ch)
        i += 1
    return f"^{out}$"


def matches_any(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(glob_regex(g) for g in globs)) if globs else F.lit(False)


LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "py": "python", "rs": "rust", "go": "go", "java": "java", "rb": "ruby", "php": "php", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp", "swift": "swift", "sh": "bash", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "md": "markdown", "cls": "apex", "m": "matlab"}


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(known[extension(path)], F.lit("text"))
