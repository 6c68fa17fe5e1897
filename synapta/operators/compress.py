"""Shortening a conversation: the beginning and the end stay, a model recollects what lies between."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

SUMMARY = "[Recollection of earlier turns]"
_LIMITS = ((re.compile("gemini", re.I), 1_000_000), (re.compile("claude", re.I), 200_000), (re.compile("gpt-4|gpt-5|o1|o3", re.I), 128_000), (re.compile("llama|mistral|gemma|phi", re.I), 8_192))
_FORMS = ("%Y-%m-%d %H:%M", "%Y-%m-%d", "%B %d, %Y %I:%M %p", "%B %d, %Y", "%I:%M %p on %d %B, %Y")


def context_limit(explicit: int | None = None, model: str | None = None) -> int:
    """The given limit, or SYNAPTA_CONTEXT_LIMIT, or that of the model's family; else an error."""
    if explicit:
        return int(explicit)
    if os.environ.get("SYNAPTA_CONTEXT_LIMIT"):
        return int(os.environ["SYNAPTA_CONTEXT_LIMIT"])
    for pattern, limit in _LIMITS:
        if model and pattern.search(model):
            return limit
    raise ValueError("give a context limit or a known model")


def chat_tokens(messages: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, tokens) of chats: three to begin the reply, and three a message beside its role, content and name."""
    name = F.when(F.col("name").isNotNull(), 1 + X.token_count("name")).otherwise(0) if "name" in messages.columns else F.lit(0)
    return messages.groupBy(key).agg((F.lit(3) + F.sum(3 + X.token_count("role") + X.token_count("content") + name)).cast("long").alias("tokens"))


def tails(messages: DataFrame, protect: int = 2) -> DataFrame:
    """(session_id, tail_start) for messages (session_id, pos, content) with pos from 0.

    The tail is at most ten messages and a tenth of the tokens, at least one message; sums run back from
    the end, and the first message that doesn't fit ends them.
    """
    w = Window.partitionBy("session_id")
    m = messages.withColumns({"t": X.token_count("content"), "n": F.count("*").over(w)})
    m = m.withColumn("most", F.floor(F.sum("t").over(w) * 0.10)).withColumn("back", F.sum("t").over(w.orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)))
    fits = (F.col("n") - F.col("pos") <= 10) & (F.col("pos") >= protect) & ((F.col("pos") == F.col("n") - 1) | (F.col("back") <= F.col("most")))
    return m.groupBy("session_id").agg(F.greatest(F.coalesce(F.min(F.when(fits, F.col("pos"))), F.max("n")), F.lit(protect + 1)).cast("int").alias("tail_start"))


def _tokens(text: str) -> int:
    return max(1, len(text) // 4) if text else 0


def _time(text: str) -> datetime | None:
    for pattern in (r"Date:\s*([^\n]+)", r"^\[([\d\-: ]+)\]"):
        found = re.search(pattern, text)
        for form in _FORMS if found else ():
            try:
                return datetime.strptime(found[1].strip(), form)
            except ValueError:
                continue
    return None


def divider(last: str, now: datetime) -> str:
    """What stands between two sessions: when the last one ended and how long ago that was."""
    then = _time(last)
    ago = "Unknown"
    if then:
        gap = now - then
        hours = gap.seconds // 3600
        ago = f"{gap.days} days, {hours} hours" if gap.days > 0 else f"{hours} hours, {gap.seconds % 3600 // 60} minutes"
    rule = "-" * 50
    ended = then.strftime("%Y-%m-%d %H:%M") if then else "Unknown"
    return f"{rule}\n[Session Ended at: {ended}]\n[Time Elapsed since compression: {ago}]\n[New Session Started at: {now:%Y-%m-%d %H:%M}]\n{rule}"


def compress(messages: list[dict], model: Callable[[str], str], limit: int, now: datetime, end: bool = False, previous: str | None = None, threshold: float = 0.65, protect: int = 2) -> tuple[list[dict], str | None]:
    """(messages, recollection) of one conversation of {role, content, is_compressed_summary}; unchanged while it is short."""
    n = len(messages)
    size = [_tokens(str(m.get("content") or "")) for m in messages]
    total = sum(size)
    if n <= protect + 4 or (not end and total < threshold * limit):
        return messages, previous
    start, used = n, 0
    for i in range(n - 1, protect - 1, -1):
        if n - i > 10 or (used + size[i] > int(total * 0.10) and n - i > 1):
            break
        used += size[i]
        start = i
    start = max(start, protect + 1)
    told = []
    for m in messages[protect : n if end else start]:
        if m.get("is_compressed_summary"):
            previous = str(m["content"]).removeprefix(SUMMARY).strip()
        else:
            told.append(m)
    summary = f"{SUMMARY}\n\n{previous}" if previous else ""
    if told:
        parts = []
        for m in told:
            c = str(m.get("content") or "")
            c = c if len(c) <= 3000 else f"{c[:2000]}\n...[truncated]...\n{c[-800:]}"
            parts.append(f"[{str(m.get('role', 'unknown')).upper()}]: {c}")
        before = f"So far:\n{previous}\n\nAdd these turns:\n" if previous else "Turns:\n"
        try:
            previous = model(before + "\n\n".join(parts) + "\n\nRecollect this in the first person, in order, with quotes, names and dates, and nothing else.").strip()
            summary = f"{SUMMARY}\n\n{previous}"
        except Exception as error:  # noqa: BLE001 - whatever the model raises is a failed call
            summary = f"{SUMMARY}\n\n[No recollection: {error}]"
    out = messages[:protect] + ([{"role": "user", "content": summary, "is_compressed_summary": True}] if summary else []) + messages[start:]
    if end:
        out = [*out, {"role": "system", "content": divider(str(messages[-1].get("content") or ""), now), "is_session_divider": True}]
    return out, previous


def compress_sessions(messages: DataFrame, model: Callable[[str], str], limit: int, now: datetime, end: bool = False) -> DataFrame:
    """(session_id, pos, role, content, is_compressed_summary, is_session_divider) of all sessions, one task each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("pos").to_dict("records")
        out, _ = compress(rows, model, limit, now, end)
        return pd.DataFrame({"session_id": str(pdf["session_id"].iloc[0]), "pos": range(len(out)), "role": [m["role"] for m in out], "content": [m["content"] for m in out], "is_compressed_summary": [bool(m.get("is_compressed_summary")) for m in out], "is_session_divider": [bool(m.get("is_session_divider")) for m in out]})

    return messages.groupBy("session_id").applyInPandas(run, "session_id string, pos int, role string, content string, is_compressed_summary boolean, is_session_divider boolean")
