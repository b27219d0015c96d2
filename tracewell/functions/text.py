"""Column expressions over paths, edits, patches and keys; all stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and stems that make a key secret, prefixes of tags and metadata that a framework sets by itself, and
#: invocation parameters that say nothing about sampling.
SECRET_WORDS = ("key", "apikey", "token", "secret", "password", "passwd", "pwd", "auth", "bearer")
SECRET_STEMS = ("secret", "password", "credential", "authoriz", "apikey", "privatekey")
FRAMEWORK_TAGS = ("seq:step:", "graph:step:", "map:key:", "langsmith:")
RUN_PREFIXES = ("langgraph_", "ls_", "lc_")
RUN_KEYS = ("checkpoint_ns", "thread_id", "run_id", "run_name")
NOT_SAMPLING = ("tools", "functions", "model", "model_name", "_type")
REDACTED = "[redacted]"
PATCH_LINE = r"(?m)^\*\*\* (?:Add File|Update File|Move to|Delete File): (.*)$"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def glob_regex(glob: str) -> str:
    """A glob as a regular expression over the whole string: * is any run, separators too; ? is one character; all else is itself."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"([^\w\s/])", r"\\\1", c) for c in glob) + "$"


def glob_match(value: Column | str, globs: list[str]) -> Column:
    """Whether any of the globs fits the value."""
    found = F.lit(False)
    for g in globs:
        found = found | _col(value).rlike(glob_regex(g))
    return found


def basename(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^/\\]*)$", 1)


def path_safe(value: Column | str) -> Column:
    """An injective escape for file names: anything but letters, digits and - becomes _ and six hex digits."""
    chars = F.filter(F.split(_col(value), ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c: F.when(c.rlike("^[A-Za-z0-9-]$"), c).otherwise(F.concat(F.lit("_"), F.lower(F.lpad(F.hex(F.ascii(c)), 6, "0"))))), "")


def is_secret_key(key: Column | str) -> Column:
    """Whole words or safe stems: authorization is secret, author isn't; token is, tokens isn't."""
    words = F.split(F.lower(_col(key)), "[^a-z0-9]+")
    return F.exists(words, lambda w: w.isin(*SECRET_WORDS) | w.rlike(f"^({'|'.join(SECRET_STEMS)})"))


def redact(values: Column | str) -> Column:
    """A map with the values of secret keys replaced."""
    return F.transform_values(_col(values), lambda k, v: F.when(is_secret_key(k), F.lit(REDACTED)).otherwise(v))


def caller_tags(tags: Column | str) -> Column:
    """Tags of the caller, sorted: those that the framework adds are dropped."""
    return F.array_sort(F.filter(_col(tags), lambda t: ~t.rlike(f"^({'|'.join(FRAMEWORK_TAGS)})")))


def caller_metadata(values: Column | str) -> Column:
    """Metadata of the caller: what frameworks stamp on a run is dropped, secrets are redacted."""
    return redact(F.map_filter(_col(values), lambda k, v: ~k.rlike(f"^({'|'.join(RUN_PREFIXES)})") & ~k.isin(*RUN_KEYS)))


def sampling_params(values: Column | str) -> Column:
    """Invocation parameters that change how a model samples, redacted."""
    return redact(F.map_filter(_col(values), lambda k, v: ~k.isin(*NOT_SAMPLING)))


def literal_edit(original: Column, old: Column, new: Column, replace_all: Column) -> Column:
    """The text after an edit, of all or the first occurrence; null if anything is null or the old text isn't there."""
    first = F.concat(F.substring(original, F.lit(1), F.instr(original, old) - 1), new, F.substring(original, F.instr(original, old) + F.length(old), F.length(original)))
    there = original.isNotNull() & new.isNotNull() & F.contains(original, old)
    return F.when(there & (old == ""), F.when(~replace_all, F.concat(new, original))).when(there & replace_all, F.replace(original, old, new)).when(there, first)


def strict_edit(content: Column, old: Column, new: Column, replace_all: Column) -> Column:
    """The text after an edit that must match once, or at least once if all are replaced; else null."""
    times = F.when(old != "", (F.length(content) - F.length(F.replace(content, old, F.lit("")))) / F.length(old)).otherwise(F.lit(0))
    return F.when((times == 1) | (replace_all & (times > 1)), F.replace(content, old, new))


def lines_of(text: Column | str) -> Column:
    """The lines of a text with their terminators; an empty text has none."""
    return F.filter(F.split(_col(text), "(?<=\n)"), lambda x: x != "")


def as_lines(lines: Column | str) -> Column:
    """Lines joined, with a final terminator; nothing for none."""
    return F.when(F.size(_col(lines)) > 0, F.concat(F.array_join(_col(lines), "\n"), F.lit("\n"))).otherwise(F.lit(""))


def line_edit(previous: Column | str, removed: Column | str, added: Column | str) -> Column:
    """(text, refusal) after a run of lines is replaced by another, or why that can't be known.

    Refusals, in this order: Ambiguous and NotFound if the run isn't there exactly once; UnterminatedAtEof if it ends at a last line without
    terminator and lines before it would be left; TerminatorsNotEstablished if lines are added where other terminators than \\n are in use.
    """
    text, removed, added = _col(previous), _col(removed), _col(added)

    def edited(x: Column) -> Column:
        lines, bare = x["lines"], x["bare"]
        n, k = F.size(lines), F.size(removed)
        run = F.greatest(k, F.lit(1))
        at = F.filter(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: (k > 0) & (i + k - 1 <= n) & (F.slice(bare, i, run) == removed))
        return placed(lines, n, k, at)

    def placed(lines: Column, n: Column, k: Column, at: Column) -> Column:
        return F.element_at(F.transform(F.array(at), lambda found: outcome(lines, n, k, found)), 1)

    def outcome(lines: Column, n: Column, k: Column, at: Column) -> Column:
        first = F.coalesce(F.try_element_at(at, F.lit(1)), F.lit(1))
        head, tail = F.slice(lines, 1, first - 1), F.slice(lines, first + k, F.greatest(n - first - k + 1, F.lit(0)))
        foreign = F.exists(lines, lambda x: x.endswith("\r\n")) & (F.size(added) > 0)
        refusal = (
            F.when(F.size(at) > 1, "Ambiguous").when(F.size(at) == 0, "NotFound")
            .when((first + k - 1 == n) & ~text.rlike("\n\\z"), "UnterminatedAtEof").when(foreign, "TerminatorsNotEstablished")
        )
        new = F.transform(added, lambda x: F.concat(x, F.lit("\n")))
        return F.struct(F.when(refusal.isNull(), F.concat(F.array_join(head, ""), F.array_join(new, ""), F.array_join(tail, ""))).alias("text"), refusal.alias("refusal"))

    # An array of one is a way to name a value: what is under transform is computed once, not for each place.
    split = F.transform(F.array(lines_of(text)), lambda x: F.struct(x.alias("lines"), F.transform(x, lambda y: F.regexp_replace(y, "\r?\n$", "")).alias("bare")))
    return F.element_at(F.transform(split, edited), 1)


def patch_paths(patch: Column | str) -> Column:
    """The paths that a patch document names, in order, once each."""
    found = F.transform(F.regexp_extract_all(_col(patch), F.lit(PATCH_LINE), F.lit(1)), lambda p: F.trim(p))
    return F.array_distinct(F.filter(found, lambda p: p != ""))


def is_safe_id(value: Column | str) -> Column:
    return _col(value).rlike(r"^[A-Za-z0-9._:-]{1,128}$") & ~_col(value).rlike(r"^\.*$")


def is_uuid(value: Column | str) -> Column:
    return _col(value).rlike("^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")


def refuses_path(path: Column | str) -> Column:
    """Whether a virtual path is refused: parents, home and drive letters."""
    return _col(path).rlike(r"(^|[/\\])\.\.([/\\]|$)|^~|^[A-Za-z]:")


def normal_path(path: Column | str) -> Column:
    """A virtual path from its root, without . and empty segments, as POSIX normalises it; null if it is refused.

    Exactly two leading slashes stay two; a backslash is turned into a slash only after the segments are cleaned.
    """
    path = _col(path)
    parts = F.array_join(F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".")), "/")
    lead = F.when(path.rlike("^//(?!/)"), "//").otherwise("/")
    joined = F.concat(lead, F.when((parts == "") & ~path.startswith("/"), ".").otherwise(parts))
    return F.when(~refuses_path(path), F.replace(joined, F.lit("\\"), F.lit("/")))
