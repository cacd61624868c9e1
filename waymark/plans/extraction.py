"""Extraction of all documents at once: each goes to the job of its source, and all jobs have one signature.

A job gets documents (document_id, title, content, fetched_at) and a setting, and returns raw claims: document_id and the
columns of RAW that it knows. Many sources share a job, so the plan has a branch for each job in use, however many sources
there are; the documents are read once, written by job, and each job reads its own part.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from . import jobs

#: Where documents go that no job reads.
NONE = "-"

RAW = {
    "feature_id": "long", "mention": "string", "ref": "string", "type": "string", "status": "string", "severity": "int", "valid_from": "date", "valid_to": "date",
    "schedule": "boolean", "needs_review": "boolean", "evidence": "string",
}


@dataclass(frozen=True)
class Setting:
    """What jobs may need beside documents: the day, and an ordered dictionary of (feature_id, pattern)."""

    as_of: dt.date | str
    dictionary: list[tuple[int, str]] = field(default_factory=list)


Job = Callable[[DataFrame, Setting], DataFrame]


def raw(claims: DataFrame) -> DataFrame:
    """document_id and the columns of RAW, null where a job doesn't know them."""
    return claims.select(F.col("document_id").cast("long").alias("document_id"), *((F.col(c) if c in claims.columns else F.lit(None)).cast(t).alias(c) for c, t in RAW.items()))


def _tag(mention: Column | str, ref: Column | None = None) -> Column:
    """Document, reference and mention in one key, so that jobs that group by a name keep documents apart."""
    return F.concat_ws("\n", F.col("document_id").cast("string"), F.coalesce(ref.cast("string") if ref is not None else F.lit(""), F.lit("")), F.coalesce(F.col(mention) if isinstance(mention, str) else mention, F.lit("")))


def _untag(claims: DataFrame, tag: str) -> DataFrame:
    parts = F.split(F.col(tag), "\n", 3)
    return raw(claims.withColumns({"document_id": parts[0], "ref": parts[1], "mention": parts[2]}).withColumn("evidence", F.col("mention")))


def _items(docs: DataFrame, schema: str) -> DataFrame:
    """The objects of the JSON array in each document; a document that isn't one gives none."""
    return docs.select("document_id", F.inline(F.from_json("content", f"array<struct<{schema}>>")))


def notices(docs: DataFrame, setting: Setting) -> DataFrame:
    found = jobs.notices_to_claims(docs.select(F.col("document_id").alias("doc_id"), "title", F.col("content").alias("text")), setting.dictionary)
    return raw(found.withColumnsRenamed({"doc_id": "document_id", "summary": "evidence"}))


def digests(docs: DataFrame, setting: Setting) -> DataFrame:
    found = jobs.digest_to_claims(docs.select(F.col("document_id").alias("doc_id"), F.to_date("fetched_at").alias("posted"), F.col("content").alias("text")), setting.dictionary)
    return raw(found.withColumnRenamed("doc_id", "document_id"))


def live_board(docs: DataFrame, setting: Setting) -> DataFrame:
    items = _items(docs, "sector:string,lift:string,kind:string,is_pending:boolean,is_open:boolean")
    found = jobs.live_board_to_claims(items.withColumn("sector", _tag("sector")))
    return _untag(found.withColumn("sector", F.when(F.col("lift").isNull(), F.col("sector")).otherwise(F.concat_ws("\n", F.substring_index("sector", "\n", 2), "lift"))), "sector")


def calendar(docs: DataFrame, setting: Setting) -> DataFrame:
    rows = _items(docs, "season:string,title:string,subtitle:string,start:date,end:date").filter("start is not null")
    return _untag(jobs.calendar_to_claims(rows.withColumn("title", _tag("title", F.col("season")))), "title")


def timetable(docs: DataFrame, setting: Setting) -> DataFrame:
    return _untag(jobs.timetable_to_claims(docs.select(_tag("title").alias("doc_id"), F.col("content").alias("text"))), "doc_id")


def wiki(docs: DataFrame, setting: Setting) -> DataFrame:
    entries = _items(docs, "ref:string,name:string,state:string,guarded:boolean,modified:date")
    return _untag(jobs.wiki_states_to_claims(entries.withColumn("cand_id", _tag("name", F.col("ref")))), "cand_id")


def availability(docs: DataFrame, setting: Setting) -> DataFrame:
    days = _items(docs, "entity:string,day:date,state:string")
    return _untag(jobs.availability_to_claims(days.withColumn("entity", _tag("entity")), setting.as_of), "entity")


def booking(docs: DataFrame, setting: Setting) -> DataFrame:
    days = _items(docs, "entity:string,day:date,state:string")
    return _untag(jobs.booking_to_claims(days.withColumn("entity", _tag("entity")), setting.as_of), "entity")


def wardens(docs: DataFrame, setting: Setting) -> DataFrame:
    """Blocks are parted by empty lines; a line without a year is of the year in which the document was fetched."""
    blocks = docs.select(_tag("title").alias("doc_id"), F.year("fetched_at").alias("year"), F.posexplode(F.split("content", r"\n\s*\n")).alias("block", "text"))
    lines = blocks.select("doc_id", "year", "block", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return _untag(jobs.warden_seasons_to_claims(lines).withColumn("schedule", F.lit(True)), "doc_id")


def reports(docs: DataFrame, setting: Setting) -> DataFrame:
    rows = _items(docs, "route:string,report_id:long,day:date,severity:int")
    return _untag(jobs.reports_to_claims(rows.withColumn("route", _tag("route")), setting.as_of), "route")


#: All jobs by name. A policy table says which job reads which source.
REGISTRY: dict[str, Job] = {f.__name__: f for f in (notices, digests, live_board, calendar, timetable, wiki, availability, booking, wardens, reports)}


def extract(docs: DataFrame, policy: DataFrame, setting: Setting, registry: dict[str, Job] = REGISTRY) -> tuple[DataFrame, DataFrame]:
    """(raw claims of all documents with source_id and fetched_at, documents that no job of the registry reads).

    docs: document_id, source_id, title, content, fetched_at; policy: source_id, job. A source without a policy, or with a
    job that isn't registered, is skipped and reported.
    """
    told = docs.select("document_id", "source_id", "title", "content", "fetched_at").join(policy.select("source_id", "job"), "source_id", "left")
    known = F.coalesce(F.col("job").isin(*registry), F.lit(False))
    routed = written(told.withColumn("job", F.when(known, F.col("job")).otherwise(NONE)), "routed", by="job")
    used = {r["job"] for r in policy.filter(known).select("job").distinct().collect()}  # at most as many as are registered
    claims = docs.sparkSession.createDataFrame([], ", ".join(f"{c} {t}" for c, t in {"document_id": "long", **RAW}.items()))
    for name in registry:
        if name in used:
            claims = claims.unionByName(raw(registry[name](routed.filter(F.col("job") == name).drop("job"), setting)))
    read = claims.join(routed.filter(F.col("job") != NONE).select("document_id", "source_id", "fetched_at"), "document_id")
    return read, routed.filter(F.col("job") == NONE).select("document_id", "source_id")


def statements(found: DataFrame) -> DataFrame:
    """Resolved raw claims as rows of the claims table: observed when their document was fetched, arrived in its order."""
    seen = F.to_date("fetched_at")
    out = found.withColumn("id", F.concat_ws("/", F.col("document_id").cast("string"), F.coalesce("ref", F.lit("")), "type", F.col("feature_id").cast("string")))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("id"))
    return out.select(
        "id", "feature_id", "source_id", "document_id", (F.unix_seconds("fetched_at") * 1000 + place).alias("seq"), "type", "status", "severity", seen.alias("observed_at"), seen.alias("last_seen_at"),
        "valid_from", "valid_to", F.coalesce("needs_review", F.lit(False)).alias("needs_review"), F.lit(None).cast("date").alias("reviewed_at"), F.coalesce("schedule", F.lit(False)).alias("schedule"),
        F.lit(None).cast("date").alias("superseded_at"), F.lit(None).cast("string").alias("superseded_by"), F.lit(None).cast("string").alias("retired_reason"), "evidence",
    )
