"""Tags and key phrases of a text.

Where spaCy and its small English model are installed they can be plugged in; what is built in
is a rule-based approximation: capitalised runs are people unless a list or a cue says place or
time, and words are reduced by their endings and looked up in short lists. Both are
functions of a text alone and run as Arrow functions on batches, once per row at writing time.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FILLER, QUESTION_WORDS, STOPWORDS
from . import text as X

VERBS = frozenset("befriend boss care date dislike divorce employ hate help know like live love marry meet own prefer support trust visit work".split())
KIN = frozenset("boss boyfriend brother child children colleague coworker daughter employee employer family father friend girlfriend husband kid mother parent partner relative roommate sibling sister son spouse wife".split())
EVENTS = frozenset("anniversary birthday camp celebration ceremony concert event exhibition fair festival funeral game graduation hike marathon meeting party play race run show sport travel trip vacation wedding".split())
CONCEPTS = frozenset("accomplishment achievement belief career conflict dream education failure feeling goal health hobby interest lifestyle mood occupation plan situation status success volunteering".split())
_TIME = frozenset("monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december today yesterday tomorrow tonight morning evening afternoon weekend week month year".split())
_PLACE_CUES = frozenset("at from in near to".split())
_NOT_NAMES = frozenset("a an and are but did do does he hello her here hey hi his how i i'm i've is it my no oh or our she so thanks that the their there these they this those was we well were what when where who why yes you".split())
_IRREGULAR = {"met": "meet", "knew": "know", "known": "know", "went": "go", "ran": "run", "married": "marry", "kids": "kid", "wives": "wife", "parties": "party"}
_VERB_ENDINGS = frozenset("am are be been did do does feel felt get go goes got had has hate have is know like love made make said say take think thought took want was went were".split())
_PLAIN = STOPWORDS | QUESTION_WORDS | FILLER | _NOT_NAMES | _PLACE_CUES
_ENDS = re.compile(r"[.!?\n]\s*$")
_WORD = re.compile(r"[^\W_][\w'’-]*", re.UNICODE)


_KNOWN = VERBS | KIN | EVENTS | CONCEPTS
_COMMON = _KNOWN | STOPWORDS


@lru_cache(1 << 16)
def lemma(word: str) -> str:
    """A word's likely base form."""
    w = word.lower()
    if w in _IRREGULAR:
        return _IRREGULAR[w]
    forms = [w, w[:-1] if w.endswith("s") else w, w[:-2] if w.endswith(("es", "ed")) else w, w[:-1] if w.endswith("ed") else w, w[:-3] + "y" if w.endswith("ies") else w, w[:-3] if w.endswith("ing") else w, w[:-3] + "e" if w.endswith("ing") else w]
    return next((f for f in forms if f in _KNOWN), w)


def tags(text: str | None) -> list[str]:
    """The text's tags in order, with repeats."""
    words = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(text or "")]
    kinds: list[str | None] = []
    for i, (w, start, _) in enumerate(words):
        before = text[words[i - 1][2] : start] if i else ""
        low = w.lower().removesuffix("'s").removesuffix("’s")
        first = i == 0 or bool(_ENDS.search(before))
        kind = None
        if low in _TIME or re.fullmatch(r"(19|20)\d\d", w):
            kind = "[time]"
        elif w[0].isupper() and low not in _NOT_NAMES and not (first and lemma(low) != low) and not (first and low in _COMMON):
            cue = i > 0 and words[i - 1][0].lower() in _PLACE_CUES
            kind = "[location]" if cue and not first else "[person]"
        kinds.append(kind)
    out, i = [], 0
    while i < len(words):
        if kinds[i]:
            kind, end = kinds[i], words[i][2]
            out.append(kind)
            i += 1
            while i < len(words) and kinds[i] == kind and not text[end : words[i][1]].strip():
                end = words[i][2]
                i += 1
            continue
        base = lemma(words[i][0])
        if base in KIN:
            if "[person]" not in kinds[i + 1 : i + 3]:
                out.append("[relation]")
        elif base in VERBS:
            out.append("[relation]")
        elif base in EVENTS:
            out.append("[event]")
        elif base in CONCEPTS:
            out.append("[concept]")
        i += 1
    return out


def keywords(text: str | None, limit: int = 4) -> list[str]:
    """Phrases of two or more content words first, then single ones, distinct regardless of case."""
    content, phrases, run = [], [], []

    def close():
        if len(run) > 1:
            phrases.append(" ".join(run))
        content.extend(run)
        run.clear()

    end = 0
    for m in _WORD.finditer(text or ""):
        w, low = m.group(), m.group().lower()
        if text[end : m.start()].strip():
            close()
        end = m.end()
        verbal = lemma(low) in VERBS or low in _VERB_ENDINGS or low.endswith(("ly",))
        if len(low) < 3 or low in _PLAIN or verbal:
            close()
        else:
            run.append(w)
    close()
    seen, out = set(), []
    for w in phrases + content:
        if w.lower() not in seen:
            seen.add(w.lower())
            out.append(w)
    return out[:limit]


def tag_counts(tags) -> Column:
    """How often each tag is in an array of tags, as a map."""
    t = F.coalesce(X.col(tags), F.array().cast("array<string>"))
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(t)), lambda x: F.struct(x, F.size(F.filter(t, lambda y: y == x)).alias("n"))))


def tags_udf(function: Callable[[str | None], list[str]] = tags):
    """An Arrow function from texts to tags."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(function)

    return run


def keywords_udf(limit: int = 4, function: Callable[[str | None, int], list[str]] = keywords):
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: function(t, limit))

    return run


def heads(text: str, expansions: dict[str, list[str]], relations: dict[str, dict[str, list[str]]], cap: int = 16, most_concepts: int = 8, most_relations: int = 6) -> list[str]:
    """Search heads of a query: itself, names, pairs of nouns, single words; then room for concept and relation vocabulary."""
    words = [re.sub(r"[^\w]", "", w) for w in text.split()]
    low = [w.lower() for w in words]
    plain = [text]
    if len(words) > 1:
        plain += [w for w in words[1:] if w and w[0].isupper() and w.lower() not in STOPWORDS]
        telling = [x not in STOPWORDS and len(x) > 2 for x in low]
        plain += [f"{words[i]} {words[i + 1]}" for i in range(len(words) - 1) if telling[i] and telling[i + 1] and low[i] not in QUESTION_WORDS][:2]
        plain += [x for x in low if len(x) >= 3 and x.isalpha() and x not in STOPWORDS | QUESTION_WORDS | FILLER]
    lowered = text.lower()
    found = [w for k, ws in expansions.items() if re.search(rf"\b{re.escape(k)}\b", lowered) for w in ws]
    special = list(dict.fromkeys(found))[:most_concepts]
    stems = {stem(x) for x in low if x}
    kin = [e for s, rs in relations.items() if s in lowered for r, es in rs.items() if stem(r) in stems or r in lowered for e in es]
    special = list(dict.fromkeys(special + list(dict.fromkeys(kin))[:most_relations]))
    plain = list(dict.fromkeys(plain))[: max(1, cap - len(special))]
    return list(dict.fromkeys(plain + special))[:cap]


def stem(word: str) -> str:
    """The same as functions.text.stem, for code on the driver."""
    w = word.strip().lower()
    for ending, cut in (("ing", 3), ("ed", 2)):
        if w.endswith(ending):
            return w[:-cut]
    if re.search("(s|x|z|ch|sh)es$", w):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w
