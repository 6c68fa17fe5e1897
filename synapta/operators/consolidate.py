"""From raw memory to beliefs with a language model: batches, prompts, tolerant replies, rollups.

The model is a function from a prompt to a reply. It runs inside Arrow functions on the executors,
one call a batch, and its failures are a status in the row rather than an exception.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..lineage import checkpointed
from ..schema import Tunables
from .ordering import next_fit, placed

Model = Callable[[str], str]
FACT = "struct<content: string, category: string, instance: string, subject: string, relation: string, entities: array<string>>"
BELIEF = "struct<content: string, term: string, aliases: array<string>, source_indices: array<int>, category: string, instance: string, subject: string, relation: string, entities: array<string>>"
MERGED = "struct<content: string, source_indices: array<int>>"


def salvage(raw: str | None):
    """The complete leading objects of a cut-off reply's first array, under the array's key; None if there are none."""
    start = (raw or "").find("[")
    if start < 0:
        return None
    before = raw[:start].rstrip()
    key = re.search(r'"([^"]+)"\s*:$', before)
    decode, at, items = json.JSONDecoder().raw_decode, start + 1, []
    while True:
        at += len(raw[at:]) - len(raw[at:].lstrip(" \t\r\n,"))
        if at >= len(raw) or raw[at] == "]":
            break
        try:
            item, at = decode(raw, at)
        except ValueError:
            break
        items.append(item)
    if not items:
        return None
    return {key[1]: items} if key else items


def parse(reply: str):
    """A reply's JSON, without its code fence; what can be saved of a cut-off one; None if nothing can."""
    text = re.sub(r"```$", "", re.sub(r"^```(json)?", "", reply.strip())).strip()
    try:
        return json.loads(text)
    except ValueError:
        return salvage(reply)


def _text(x) -> str:
    return str(x or "").strip()


def _names(x) -> list[str]:
    return [_text(e) for e in x if _text(e)] if isinstance(x, list) else []


def _numbers(x) -> list[int]:
    out = []
    for v in x if isinstance(x, list) else []:
        try:
            out.append(int(v))
        except (TypeError, ValueError):
            continue
    return out


def items(data, key: str) -> list[dict]:
    """The list under a key, or a bare list; texts become contents, other things and empty contents are dropped."""
    found = data.get(key) if isinstance(data, dict) else data
    out = []
    for x in found if isinstance(found, list) else []:
        x = {"content": x} if isinstance(x, str) else x
        if isinstance(x, dict) and _text(x.get("content")):
            out.append(x)
    return out


def facts(data) -> list[dict]:
    """Facts of an extraction; a tag counts only with what it needs."""
    out = []
    for x in items(data, "facts"):
        category, instance, subject, relation, entities = _text(x.get("category")), _text(x.get("instance")), _text(x.get("subject")), _text(x.get("relation")), _names(x.get("entities"))
        f = {"content": _text(x["content"])}
        if category and instance:
            f |= {"category": category, "instance": instance}
        if subject and (category or (relation and entities)):
            f["subject"] = subject
        if relation and entities:
            f |= {"relation": relation, "entities": entities}
        out.append(f)
    return out


def reviews(data) -> list[dict]:
    """Beliefs of a review."""
    keys = ("term", "category", "instance", "subject", "relation")
    return [{"content": _text(x["content"]), **{k: _text(x.get(k)) for k in keys}, "aliases": _names(x.get("aliases")), "entities": _names(x.get("entities")), "source_indices": _numbers(x.get("source_indices"))} for x in items(data, "beliefs")]


def merges(data) -> list[dict]:
    """Groups of a synthesis that name three facts or more."""
    found = [{"content": _text(x["content"]), "source_indices": _numbers(x.get("source_indices"))} for x in items(data, "merged")] if isinstance(data, dict) else []
    return [x for x in found if len(x["source_indices"]) >= 3]


def ask(prompts: DataFrame, model: Model, kind: str, reader: Callable, prompt: str = "prompt") -> DataFrame:
    """Add (status, items, tokens_in, tokens_out): status is ok, unparsed or failed; tokens are estimates."""

    @F.pandas_udf(f"struct<status: string, items: array<{kind}>, tokens_in: bigint, tokens_out: bigint>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = []
            for p in texts:
                used = max(1, len(p) // 4)
                try:
                    reply = model(p)
                except Exception:  # noqa: BLE001 - whatever the model raises is a failed call
                    rows.append(("failed", [], used, 0))
                    continue
                data = parse(reply)
                rows.append(("unparsed" if data is None else "ok", [] if data is None else reader(data), used, max(1, len(reply) // 4)))
            yield pd.DataFrame(rows, columns=["status", "items", "tokens_in", "tokens_out"])

    return prompts.withColumn("__r", run(prompt)).select(*prompts.columns, "__r.*")


#: The order in which memory is reviewed: by time over all sessions, undated rows first.
CHRONOLOGICAL = (F.asc_nulls_first, "time"), (F.asc_nulls_first, "ingested_at"), (F.asc, "chunk"), (F.asc, "seq"), (F.asc, "id")


def _order() -> list[Column]:
    return [f(c) for f, c in CHRONOLOGICAL]


def unreviewed(memory: DataFrame) -> DataFrame:
    """Memory that no review has seen, with its time; a blank mark is none."""
    mark = F.coalesce(F.trim(F.col("reviewed_at").cast("string")), F.lit("")) == ""
    m = memory.where((F.col("category") == "memory") & mark)
    return m.withColumns({"time": X.prefix_time("content"), "chunk": F.coalesce("chunk_index", F.lit(0))})


def chronological(memory: DataFrame) -> DataFrame:
    """Unreviewed memory with its place, from 1, in time over all sessions."""
    return placed(unreviewed(memory), _order())


def batches(rows: DataFrame, key: str, order: list[str], text: str, limit: int) -> DataFrame:
    """(key, batch, rows) with rows in order, closed before a batch would exceed the limit in tokens."""
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*rows.columns).alias("row")))).alias("rows"))
    g = g.withColumn("n", X.next_fit(F.col("rows"), lambda r: X.token_count(r["row"][text]), limit))
    e = g.select(key, F.explode(F.arrays_zip("n", "rows")).alias("z")).select(key, F.col("z.n").alias("batch"), F.col("z.rows.row").alias("row"), *[F.col(f"z.rows.{o}").alias(f"__{o}") for o in order])
    return e.groupBy(key, "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct(*[f"__{o}" for o in order], "row"))), lambda x: x["row"]).alias("rows"))


def numbered(rows, text: str) -> Column:
    """Rows as lines ``1. …``."""
    return F.array_join(F.transform(X.col(rows), lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(r[text], F.lit("")))), "\n")


REVIEW = "Read this record of conversation excerpts, in time order, and state the lasting beliefs that it supports.\n\nRecord:\n"
REVIEW_FORM = '\n\nAnswer with JSON only: an object with the list beliefs; each has content, term, aliases (a list), source_indices (line numbers) and, where they apply, category, instance, subject, relation and entities. Write in the third person, make dates absolute, keep names and details; an empty list is a good answer.'
EXTRACT_FORM = '\n\nState each fact of these turns by itself. Answer with JSON only: an object with the list facts; each has content and, where they apply, category, instance, subject, relation and entities.'
SYNTHESIS_FORM = '\n\nWhich three or more of these facts are parallel items about one person that one sentence could list? Answer with JSON only: an object with the list merged; each has content and source_indices; none is a good answer.'


def review(memory: DataFrame, model: Model, t: Tunables = Tunables()) -> tuple[DataFrame, DataFrame]:
    """(beliefs formed, chunk ids reviewed) from unreviewed memory, a call per batch of all sessions in time.

    Failed calls leave their chunks for the next run; unreadable replies don't. A belief names its chunks in memory_refs
    and carries the latest date among them. The model is called once a batch; its answers are written to the checkpoint folder.
    """
    asked = checkpointed(reviewed_batches(memory, model, t)).where("status <> 'failed'")
    return formed_beliefs(asked), asked.select(F.explode("rows.id").alias("id"))


def reviewed_batches(memory: DataFrame, model: Model, t: Tunables = Tunables()) -> DataFrame:
    """(batch, rows, prompt, status, items, tokens_in, tokens_out) of a review: unreviewed memory in time, in batches of bounded tokens."""
    u = unreviewed(memory).select("id", "content", "time", "ingested_at", "chunk", "seq")
    u = next_fit(u, _order(), X.token_count("content"), t.review_tokens)
    key = ["time", "ingested_at", "chunk", "seq", "id"]  # structs sort nulls first
    b = u.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct(*key, "content"))), lambda r: F.struct(r["id"].alias("id"), r["content"].alias("content"), r["time"].alias("time"))).alias("rows"))
    return ask(b.withColumn("prompt", F.concat(F.lit(REVIEW), numbered("rows", "content"), F.lit(REVIEW_FORM))), model, BELIEF, reviews)


def formed_beliefs(asked: DataFrame) -> DataFrame:
    """Belief rows of a review's answers, with their batch and pos."""
    x = asked.select("batch", "rows", F.posexplode("items").alias("pos", "i"))
    x = x.withColumn("sources", _named("i.source_indices", "rows"))
    latest = F.date_format(F.array_max(F.transform("sources", lambda s: s["time"])), "yyyy-MM-dd HH:mm")
    content = F.when(latest.isNotNull(), F.concat(F.lit("["), latest, F.lit("] "), F.col("i.content"))).otherwise(F.col("i.content"))
    formed = x.select("batch", "pos", content.alias("content"), F.transform("sources", lambda s: s["id"]).alias("memory_refs"), "i.term", "i.aliases", "i.category", "i.instance", "i.subject", "i.relation", "i.entities")
    return formed.withColumns({"id": X.content_id("bel_nr_", "content"), "source": F.lit("nightly_review"), "layer": F.lit(2), "confidence": F.lit(1.0)})


def _named(indices: str, rows: str) -> Column:
    """The rows that 1-based positions name; positions out of range are dropped."""
    return F.transform(F.filter(indices, lambda k: (k >= 1) & (k <= F.size(rows))), lambda k: F.element_at(rows, k))


def stamp(memory: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """Memory with reviewed_at set where a review saw it."""
    seen = done.select("id", F.lit(True).alias("__seen")).distinct()
    return memory.join(seen, "id", "left").withColumn("reviewed_at", F.when(F.col("__seen"), now).otherwise(F.col("reviewed_at"))).select(*memory.columns)


def extract(turns: DataFrame, model: Model, t: Tunables = Tunables()) -> DataFrame:
    """Facts, with ids, of turns (session_id, content): the ``Date:`` line is the date, lines are sent in batches."""
    dated = F.col("content").startswith("Date:")
    d = turns.withColumn("date", F.when(dated, X.spoken_date(F.trim(F.regexp_extract("content", r"^Date:([^\n]*)", 1)))))
    d = d.withColumn("text", F.trim(F.when(dated, F.regexp_replace("content", r"^Date:[^\n]*\n?", "")).otherwise(F.col("content")))).where("text <> ''")
    lines = F.split("text", "\n")
    d = d.select("session_id", "date", F.posexplode(F.arrays_zip(lines.alias("line"), X.next_fit(lines, X.token_count, t.extraction_tokens).alias("batch"))).alias("pos", "z"))
    g = d.groupBy("session_id", "date", F.col("z.batch").alias("batch")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("z.line").alias("line")))), lambda r: r["line"]), "\n").alias("text"))
    asked = ask(g.withColumn("prompt", F.concat(F.lit("Date: "), F.coalesce("date", F.lit("")), F.lit("\n"), "text", F.lit(EXTRACT_FORM))), model, FACT, facts)
    f = asked.select("session_id", "date", "batch", F.posexplode("items").alias("pos", "i")).select("session_id", "date", "batch", "pos", "i.*")
    content = F.when(F.coalesce("date", F.lit("")) != "", F.concat(F.lit("["), "date", F.lit("] "), "content")).otherwise(F.col("content"))
    return f.withColumn("content", content).withColumns({"id": X.content_id("bel_", "content"), "source": F.lit("session_summarization"), "confidence": F.lit(1.0)})


def synthesise(found: DataFrame, model: Model) -> DataFrame:
    """Additional beliefs that list three or more of a session's facts; their relations name the facts."""
    w = Window.partitionBy("session_id").orderBy("batch", "pos")
    n = found.withColumn("n", F.row_number().over(w))
    g = n.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id", "content"))), lambda r: r).alias("rows"), F.max("date").alias("date")).where(F.size("rows") >= 3)
    asked = ask(g.withColumn("prompt", F.concat(numbered("rows", "content"), F.lit(SYNTHESIS_FORM))), model, MERGED, merges)
    x = asked.select("rows", "date", "session_id", F.explode("items").alias("i"))
    x = x.withColumn("relations", F.transform(_named("i.source_indices", "rows"), lambda r: r["id"])).where(F.size("relations") >= 3)
    content = F.when(F.coalesce("date", F.lit("")) != "", F.concat(F.lit("["), "date", F.lit("] "), F.col("i.content"))).otherwise(F.col("i.content"))
    x = x.select("session_id", content.alias("content"), "relations")
    return x.withColumns({"id": X.content_id("bel_synth_", F.concat(F.lit("synth:"), "content")), "category": F.lit("premises"), "source": F.lit("turn_synthesis"), "confidence": F.lit(1.0)})


def rollups(groups: DataFrame, beliefs: DataFrame, model: Model, prefix: str, source: str) -> DataFrame:
    """(key and belief columns) One-sentence summaries of groups (key, id): their relations name the members; failed calls give none."""
    m = groups.join(beliefs.select("id", "content"), "id").groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("relations"), F.array_join(F.array_sort(F.collect_list("content")), "\n").alias("lines"))

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        def one(p):
            try:
                return model(p).strip() or None
            except Exception:  # noqa: BLE001 - whatever the model raises is a failed call
                return None

        return prompts.map(one)

    out = m.withColumn("content", run(F.concat(F.lit("Say in one sentence what these have in common, with two or three highlights.\n"), "lines"))).where("content is not null")
    return out.select("key", X.content_id(prefix, "key").alias("id"), F.lit("premises").alias("category"), "content", F.lit(1.0).alias("confidence"), F.lit(source).alias("source"), "relations")


def linked(groups: DataFrame) -> DataFrame:
    """(group_id, id) of the rows that 1-based positions name, from groups (group_id, source_indices, rows) with rows in order; what is no position is dropped."""
    numbers = F.filter(F.transform("source_indices", lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    return groups.withColumn("__i", numbers).select("group_id", F.explode(_named("__i", "rows")).alias("r")).select("group_id", "r.id")
