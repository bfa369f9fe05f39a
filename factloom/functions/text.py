"""Text expressions, all built-in and null-safe unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import fixed


def normalized(text: Column) -> Column:
    """Lower case, whitespace runs (Unicode) as one blank, none at the ends; '' for null."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.regexp_replace(F.regexp_replace(lowered, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def plain_tokens(text: Column) -> Column:
    """Distinct runs of a-z0-9 of the lower-cased text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9]+)"), F.lit(1))))


def lexical_tokens(text: Column) -> Column:
    """Plain tokens of three characters or more that aren't stopwords, sorted."""
    long = F.filter(plain_tokens(text), lambda t: F.length(t) >= 3)
    return F.array_except(long, F.array(*(F.lit(w) for w in fixed.STOPWORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token arrays; 0 when either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def negated(text: Column) -> Column:
    """Whether a statement has a negator outside code spans and double quotes."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("\u2019"), F.lit("'"))
    t = F.regexp_replace(F.regexp_replace(t, r"`[^`]*`", " "), r'"[^"\n]*"', " ")
    return t.rlike("(?i)" + fixed.NEGATORS)


def one_line(text: Column) -> Column:
    """Line breaks of all kinds as blanks, code fences as quotes, comment marks split, none at the ends."""
    t = F.translate(F.coalesce(text, F.lit("")), "\r\n\u2028\u2029\u0085", "     ")
    t = F.replace(t, F.lit("```"), F.lit("'''"))
    t = F.replace(F.replace(t, F.lit("<!--"), F.lit("<! --")), F.lit("-->"), F.lit("-- >"))
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def first_sentence(text: Column, limit: int = 220) -> Column:
    """Up to the first . ! or ? before a blank, cut at a word when longer than the limit."""
    t = one_line(text)
    s = F.regexp_extract(t, r"^(.*?[.!?])(?:\s|$)", 1)
    s = F.when(s == "", t).otherwise(s)
    return F.when(F.length(s) <= limit, s).otherwise(F.regexp_replace(F.substring(s, 1, limit), r"\s+\S*$", ""))


def tag_list(tags: Column) -> Column:
    """Trimmed, non-empty, distinct tags, sorted; case is kept."""
    each = F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda t: F.trim(t))
    return F.array_sort(F.array_distinct(F.filter(each, lambda t: t != "")))


def slug(tags: Column, id_: Column) -> Column:
    """Up to four tags cleaned to a-z0-9 and dashes, else the start of the id."""
    clean = F.transform(tag_list(F.lower(tags)), lambda t: F.regexp_replace(F.regexp_replace(t, "[^a-z0-9]+", "-"), "^-+|-+$", ""))
    joined = F.array_join(F.slice(F.filter(clean, lambda t: t != ""), 1, 4), "-")
    return F.when(joined != "", joined).otherwise(F.substring(id_, 1, 8))


def age_text(ts: Column, now: Column) -> Column:
    """just now, Nm, Nh or Nd; the time itself when it lies ahead, '' for null."""
    s = F.unix_timestamp(now) - F.unix_timestamp(ts)
    unit = lambda n, u: F.concat(F.floor(s / n).cast("string"), F.lit(u))
    shown = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.when(ts.isNull(), "").when(s < 0, shown).when(s < 60, "just now").when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def stem_of(namespace: Column) -> Column:
    return F.regexp_replace(F.lower(namespace), r"[\s:_\-.]+", "")


def near_miss(namespace: Column) -> Column:
    """A misspelling of the global namespace."""
    return stem_of(namespace).isin(*fixed.NEAR_MISS_STEMS) & (namespace != fixed.GLOBAL_NAMESPACE)


def remote_key(url: Column, forge: str | None = None) -> Column:
    """host/org/repo of a git remote in ssh or http form, lower-case host, without user, port and .git; null otherwise.

    A remote behind a proxy of this machine, whose path is git/org/repo, gets the host that the proxy stands for: `forge`, or without
    one the public default. A forge that is empty or no host name switches that off.
    """
    u = F.regexp_replace(F.trim(url), r"(\.git)?/*$", "")
    parts = r"^(?:[a-z+]+://)?(?:[^@/]+@)?([^:/]+)(?::\d+)?[:/]+(.+)$"
    host, path = F.lower(F.regexp_extract(u, parts, 1)), F.regexp_extract(u, parts, 2)
    key = F.when((host != "") & path.contains("/"), F.concat(host, F.lit("/"), path))
    to = fixed.FORGE if forge is None else forge.strip().lower()
    if not re.match(r"[a-z0-9](?:[a-z0-9.\-]*[a-z0-9])?(?::\d+)?\Z", to):
        return key
    behind = host.rlike(r"^(localhost|127\.\d+\.\d+\.\d+)$") & path.rlike(r"^(?i)git/[^/]+/[^/]+$")
    return F.when(behind, F.concat(F.lit(to + "/"), F.substring(path, F.lit(5), F.length(path)))).otherwise(key)


def file_key(namespace: Column) -> Column:
    """A reversible file name: letters, digits, dot and dash stay, every other character becomes _XX for each UTF-8 byte."""
    one = lambda c: F.when(c.rlike(r"^[A-Za-z0-9.\-]$"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "_$1"))
    return F.array_join(F.transform(F.split(namespace, ""), one), "")


def scrubbed(text: Column) -> Column:
    """An error text without addresses and paths."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[A-Za-z][A-Za-z0-9+.-]*://\S+", "<uri>")
    return F.regexp_replace(t, r"(?:[A-Za-z]:)?(?:[\\/][^\s\\/:'\"]+){2,}", "<path>")


def public_url(url: Column) -> Column:
    """A URL without user and password and without its whole query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@", "$1"), r"[?#].*$", "")


def is_risky(tags: Column) -> Column:
    """Whether a record carries the tag of text that tries to give instructions."""
    return F.array_contains(tag_list(tags), "prompt-injection-risk")
