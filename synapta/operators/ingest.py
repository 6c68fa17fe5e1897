"""Conversation events into the append-only memory record: chunks with identifiers made of their content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import Tunables


def words_hard_split(sentence: Column, target: int) -> Column:
    """Words packed up to the target; a word counts at least one token."""
    words = F.filter(F.split(sentence, r"\s+"), lambda w: w != "")
    return _packed(words, lambda w: F.greatest(X.token_count(w), F.lit(1)), target)


def _packed(pieces: Column, size, target: float) -> Column:
    """Pieces joined by spaces in next-fit batches."""
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"), F.lit(0).cast("long").alias("used"))

    def step(acc, p):
        n = size(p).cast("long")
        full = (acc["cur"] != "") & (acc["used"] + n > target)
        cur = F.when(full | (acc["cur"] == ""), p).otherwise(F.concat(acc["cur"], F.lit(" "), p))
        return F.struct(F.when(full, F.array_append(acc["out"], acc["cur"])).otherwise(acc["out"]).alias("out"), cur.alias("cur"), F.when(full, n).otherwise(acc["used"] + n).alias("used"))

    return F.aggregate(pieces, zero, step, lambda acc: F.when(acc["cur"] != "", F.array_append(acc["out"], acc["cur"])).otherwise(acc["out"]))


def chunk_text(x, target: int = Tunables().chunk_tokens, overshoot: float = Tunables().chunk_overshoot) -> Column:
    """Chunks of about ``target`` tokens: whole sentences packed, too long ones split by words; short text stays whole."""
    text = F.regexp_replace(X.col(x), r"^\s+|\s+$", "")
    pieces = F.flatten(F.transform(X.sentences(text), lambda s: F.when(X.token_count(s) > target * overshoot, words_hard_split(s, target)).otherwise(F.array(s))))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).when(X.token_count(text) <= target, F.array(text)).otherwise(_packed(pieces, X.token_count, target))


def short_time(events: DataFrame, now: Column | None = None) -> Column:
    """The column ts in the form of the prefix: timestamps are formatted, texts are read as ``spoken_date`` reads them, null becomes ``now`` if that is given."""
    form = "yyyy-MM-dd HH:mm"
    kind = dict(events.dtypes)["ts"]
    out = F.date_format("ts", form) if kind.startswith("timestamp") or kind == "date" else X.spoken_date(F.trim("ts"))
    return out if now is None else F.coalesce(out, F.date_format(now, form))


def memory_chunks(events: DataFrame, t: Tunables = Tunables(), now: Column | None = None) -> DataFrame:
    """Memory rows of events (text, source, ts, session_id, turn_id, speaker, ingested_at, seq).

    ts is a timestamp or text (``short_time``). The same event always gives the same ids, so a replay adds nothing
    when rows are inserted if absent.
    """
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    e = events.withColumns({"text": text, "ts": short_time(events, now)}).where("text <> ''")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    e = e.withColumn("event_id", X.content_id("evt_", F.concat(blank("ts"), F.lit("|"), blank("source"), F.lit("|"), blank("speaker"), F.lit("|"), F.col("text"))))
    chunks = e.withColumn("chunks", chunk_text("text", t.chunk_tokens, t.chunk_overshoot)).withColumn("chunk_count", F.size("chunks"))
    rows = chunks.select("*", F.posexplode("chunks").alias("chunk_index", "chunk"))
    body = F.when(F.col("speaker").isNotNull() & (F.col("speaker") != ""), F.concat("speaker", F.lit(": "), "chunk")).otherwise(F.col("chunk"))
    content = F.when(F.col("ts").isNotNull() & (F.col("ts") != ""), F.concat(F.lit("["), "ts", F.lit("] "), body)).otherwise(body)
    return rows.select(
        X.content_id("mem_", F.concat("event_id", F.lit(":"), F.col("chunk_index").cast("string"), F.lit(":"), "chunk")).alias("id"),
        F.lit("memory").alias("category"), content.alias("content"), F.lit(1.0).alias("confidence"), "source", "event_id", "ingested_at",
        "chunk_index", "chunk_count", F.col("session_id").cast("string").alias("session_id"), F.col("turn_id").cast("string").alias("turn_id"), "speaker", F.lit(None).cast("timestamp").alias("reviewed_at"), "seq",
    )


def turn_events(turns: DataFrame) -> DataFrame:
    """Events of turns (content, role, session_id, turn_id, ingested_at, seq): a leading ``Date:`` line becomes ts, a leading ``Name:`` the speaker."""
    content = F.regexp_replace("content", r"^\s+|\s+$", "")
    dated = F.col("content").startswith("Date:")
    t = turns.withColumn("content", content).where("content <> ''")
    t = t.withColumns({"ts": F.when(dated, X.spoken_date(F.trim(F.regexp_extract("content", r"^Date:([^\n]*)", 1)))), "body": F.trim(F.when(dated, F.regexp_replace("content", r"^Date:[^\n]*\n?", "")).otherwise(F.col("content")))})
    name = r"(?Us)^([A-Z][\w \-'.]{0,40}?):\s+(.*)$"
    speaker = F.nullif(F.regexp_extract("body", name, 1), F.lit(""))
    text = F.when(speaker.isNotNull(), F.regexp_extract("body", name, 2)).otherwise(F.col("body"))
    return t.select(text.alias("text"), F.coalesce("role", F.lit("user_input")).alias("source"), "ts", "session_id", "turn_id", speaker.alias("speaker"), "ingested_at", "seq")
