"""Text and identifier functions as column expressions: they run in the JVM, inside generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NOT_SALIENT, SINGULAR

PREFIX = r"^\[([\d\-: ]+)\]\s*"
_TOKEN = r"(?U)([A-Za-z0-9][\w.\-/]*)"
_MONTHS = {m: f"{i:02d}" for i, m in enumerate("january february march april may june july august september october november december".split(), 1)}
_MONTHS |= {m[:3]: n for m, n in _MONTHS.items()}


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_prefix(x) -> Column:
    """Content without its leading ``[date]``."""
    return F.regexp_replace(col(x), PREFIX, "")


def prefix_time(x) -> Column:
    """The leading date as a timestamp; null where there is none or it can't be read."""
    raw = F.trim(F.regexp_extract(col(x), PREFIX, 1))
    return F.coalesce(F.try_to_timestamp(raw, F.lit("yyyy-MM-dd HH:mm")), F.try_to_timestamp(raw, F.lit("yyyy-MM-dd")))


def turn_number(x) -> Column:
    """The number in ``12`` or ``t12``; null for anything else."""
    return F.nullif(F.regexp_extract(F.trim(col(x).cast("string")), r"^t?(\d+)$", 1), F.lit("")).try_cast("int")


def bounded(term: str) -> str:
    """A pattern that finds a term between word boundaries."""
    return r"(?U)\b" + re.sub(r"([^\w\s])", r"\\\1", term) + r"\b"


def has_term(x, term: str) -> Column:
    return col(x).rlike(bounded(term))


def stem(x) -> Column:
    """Lower case without -ing, -ed, or a plural's ending."""
    w = F.lower(F.trim(col(x)))
    n = F.length(w)
    return (
        F.when(w.endswith("ing"), F.substr(w, F.lit(1), n - 3))
        .when(w.endswith("ed"), F.substr(w, F.lit(1), n - 2))
        .when(w.rlike("(s|x|z|ch|sh)es$"), F.substr(w, F.lit(1), n - 2))
        .when(w.endswith("s") & ~w.endswith("ss"), F.substr(w, F.lit(1), n - 1))
        .otherwise(w)
    )


def tokens_of(x) -> Column:
    return F.regexp_extract_all(col(x), F.lit(_TOKEN), 1)


def _bare(t: Column) -> Column:
    return F.regexp_replace(F.lower(t), r"[.\-/]+$", "")


def _is_salient(t: Column) -> Column:
    return t.rlike(r"(?U)\d") | (t.rlike("^[A-Z]") & ~_bare(t).isin(sorted(NOT_SALIENT)))


def salient_tokens(x) -> Column:
    """Distinct values of a statement in order: tokens with a digit, and capitalised ones that aren't common words."""
    return F.array_distinct(F.transform(F.filter(tokens_of(x), _is_salient), _bare))


def statement_template(x) -> Column:
    """The statement's skeleton, with <v> for each value."""
    # the set of values is bound once, as an element, lest it be made anew for each token
    skeleton = lambda values: F.array_join(F.transform(F.transform(tokens_of(x), _bare), lambda t: F.when(F.array_contains(values, t), F.lit("<v>")).otherwise(t)), " ")
    return F.transform(F.array(salient_tokens(x)), skeleton)[0]


def token_count(x) -> Column:
    """Estimated tokens: a quarter of the characters, at least 1 for text, 0 for none."""
    n = F.length(F.coalesce(col(x), F.lit("")))
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.floor(n / 4)))


def content_id(prefix: str, x) -> Column:
    """A prefix and the first 12 hexadecimal digits of the content's SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(col(x).cast("binary"), 256), 1, 12))


def slug(x) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(x))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def cluster_id(subject, category) -> Column:
    return F.concat_ws("_", F.lit("cluster"), slug(subject), slug(category))


def canonical_category(x) -> Column:
    names = F.create_map(*[F.lit(v) for kv in SINGULAR.items() for v in kv])
    return F.coalesce(F.try_element_at(names, col(x)), col(x))


def weight_tier(confidence) -> Column:
    c = col(confidence)
    return F.when(c < 0.60, "surface").when(c < 0.85, "deep").otherwise("core")


def relevance(confidence, stability, relations) -> Column:
    n = F.greatest(F.size(F.coalesce(col(relations), F.array())), F.lit(0))
    return F.greatest(F.lit(0.01), col(confidence) * (0.5 + col(stability)) * (1 + F.least(F.lit(0.5), 0.05 * n)))


def infer_subject(x) -> Column:
    """The capitalised word that the content begins with; null if there is none."""
    return F.nullif(F.regexp_extract(strip_prefix(x), "^([A-Z][a-zA-Z]+)", 1), F.lit(""))


def spoken_date(x) -> Column:
    """``8:56 pm on 20 July, 2023`` as ``2023-07-20 20:56`` and ``May 8, 2023`` as ``2023-05-08``; other texts stay."""
    low = F.lower(F.trim(col(x)))
    months = F.create_map(*[F.lit(v) for kv in _MONTHS.items() for v in kv])
    full, day = r"(\d+):(\d+)\s*(am|pm)\s+on\s+(\d+)\s+([a-z]+),?\s+(\d{4})", r"([a-z]+)\s+(\d+),?\s+(\d{4})"
    g = [F.regexp_extract(low, full, i) for i in range(7)]
    d = [F.regexp_extract(low, day, i) for i in range(4)]
    number = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    month = lambda c: F.coalesce(F.try_element_at(months, c), F.lit("01"))
    hour = number(g[1])
    hour = F.when((g[3] == "pm") & (hour < 12), hour + 12).when((g[3] == "am") & (hour == 12), F.lit(0)).otherwise(hour)
    return (
        F.when(low.rlike(full), F.format_string("%s-%s-%02d %02d:%02d", g[6], month(g[5]), number(g[4]), hour, number(g[2])))
        .when(low.rlike(day), F.format_string("%s-%s-%02d", d[3], month(d[1]), number(d[2])))
        .otherwise(col(x))
    )


def slashed_date(x) -> Column:
    """``2023/05/20 (Sat) 02:21`` as ``2023-05-20 02:21``."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(col(x), r"\(\w+\)", ""), "/", "-"), r"\s+", " "))


def raw_time(x) -> Column:
    """A timestamp in one of the five forms that messages use, or null."""
    forms = ("yyyy-MM-dd HH:mm", "yyyy-MM-dd", "MMMM d, yyyy h:mm a", "MMMM d, yyyy", "h:mm a 'on' d MMMM, yyyy")
    text = F.trim(col(x))
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)\bam\b", "AM"), r"(?i)\bpm\b", "PM")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms])


def elided(x, most: int = 3000, head: int = 2000, tail: int = 800) -> Column:
    """A long message's beginning and end, with a mark between them."""
    c = col(x)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, head), F.lit("\n...[truncated]...\n"), F.right(c, F.lit(tail)))).otherwise(c)


def elapsed_text(start, end) -> Column:
    """``2 days, 3 hours`` or ``3 hours, 20 minutes``."""
    s = F.unix_timestamp(col(end)) - F.unix_timestamp(col(start))
    days = F.floor(s / 86400)
    rest = s - days * 86400
    hours = F.floor(rest / 3600)
    return F.when(days > 0, F.format_string("%d days, %d hours", days, hours)).otherwise(F.format_string("%d hours, %d minutes", hours, F.floor((rest % 3600) / 60)))


def without_fence(x) -> Column:
    """A reply without the code fence around it."""
    ends = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return ends(F.regexp_replace(F.regexp_replace(ends(col(x)), "^```(json)?", ""), "```$", ""))


def next_fit(items: Column, size, limit: float) -> Column:
    """The batch number of each item: a batch closes when the next item would exceed the limit."""
    zero = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("used"))

    def step(acc, x):
        s = size(x).cast("long")
        full = (acc["used"] > 0) & (acc["used"] + s > limit)
        n = F.when(full, acc["n"] + 1).otherwise(acc["n"])
        return F.struct(F.concat(acc["out"], F.array(n)).alias("out"), n.alias("n"), F.when(full, s).otherwise(acc["used"] + s).alias("used"))

    return F.aggregate(items, zero, step, lambda acc: acc["out"])


def sentences(x) -> Column:
    """Pieces between sentence ends or line ends, trimmed, blanks dropped."""
    # trim takes a second argument, which transform would fill with the piece's number
    return F.filter(F.transform(F.split(col(x), r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")
