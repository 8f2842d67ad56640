"""Text columns: tokens, slugs, keys, paths, digests. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import STOPWORDS

_EDGE = ".,;:()"


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens of over two characters that aren't stopwords, in order of first sight; null is empty."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([a-zA-Z0-9+/#.\-]+)"), F.lit(1))
    bare = F.transform(found, lambda t: F.lower(F.btrim(t, F.lit(_EDGE))))
    return F.array_distinct(F.filter(bare, lambda t: (F.length(t) > 2) & ~t.isin(*STOPWORDS)))


def slug(text: Column) -> Column:
    """Lower case, runs of other characters as one hyphen, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), F.lit("-"))


def space_slug(text: Column) -> Column:
    return F.array_join(F.split(F.lower(F.trim(text)), r"\s+"), "-")


def package_slug(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_")


def ticket_keys(text: Column, projects: tuple[str, ...] = ("PAY", "JIRA", "ENG", "OPS")) -> Column:
    """Distinct ticket keys of the projects, sorted; null is empty."""
    pattern = rf"\b((?:{'|'.join(projects)})-\d+)\b"
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))))


def normal_email(text: Column) -> Column:
    """Lower case, without a +tag."""
    return F.regexp_replace(F.lower(F.trim(text)), r"\+[^@]*@", "@")


def noreply_login(text: Column) -> Column:
    """Login in a code host's noreply address, else null."""
    login = F.regexp_extract(text, r"(?i)^(?:(\d+)\+)?([^@+]+)@users\.noreply\.github\.com$", 2)
    return F.when(login != "", F.lower(login))


def is_revert(message: Column) -> Column:
    return message.rlike(r'(?i)^\s*Revert\s+"')


def path_tokens(paths: Column) -> Column:
    """path: of each path and dir: of each of its directories, distinct and sorted."""
    clean = F.filter(paths, lambda p: p.isNotNull() & (p != ""))

    def one(p: Column) -> Column:
        parts = F.split(p, "/")
        depth = F.size(parts) - 1
        at = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
        folders = F.transform(at, lambda i: F.concat(F.lit("dir:"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
        return F.array_append(folders, F.concat(F.lit("path:"), p))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(clean, one))))


def signature(found: Column) -> Column:
    """Directory tokens where there are any, else component, label, project, service and ticket tokens."""
    folders = F.filter(found, lambda t: t.startswith("dir:"))
    rest = F.filter(found, lambda t: t.rlike("^(component|label|project|service|ticket):"))
    return F.when(F.size(folders) > 0, folders).otherwise(rest)


def digits(text: Column) -> Column:
    """The first run of digits as a number, else null."""
    return F.nullif(F.regexp_extract(text, r"\d+", 0), F.lit("")).try_cast("bigint")


def evidence_id(*parts: Column) -> Column:
    """EV- and the first eight hexadecimal digits of the joined parts' SHA-256."""
    return F.concat(F.lit("EV-"), F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 8))


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def first_line(text: Column) -> Column:
    return F.split(text, "\n")[0]
