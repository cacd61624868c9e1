"""Extraction jobs (documents or JSON rows to claims) and end-to-end tables, composed of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import docs as do
from ..operators import facts as fa
from ..operators import lifecycle as li
from ..operators import review as rv
from ..operators import season as se
from ..operators import serve as sv
from ..operators import status as st
from ..operators.common import first_by
from ..sources.shared import written
from ..streaming.incremental import confirm

# Raw words of sources and what they mean (type, status, severity).
HUT_STATES = {"SERVICED": ("opening", "open", 0), "UNSERVICED": ("opening", "unstaffed", 1), "CLOSED": ("closure", "closed", 2)}
WARDEN_HEADING = "periode de gardiennage"
WIKI_STATES = {"ferme": ("closure", "closed", 2), "detruit": ("closure", "closed", 3), "ouvert": ("opening", "open", 0)}


def _meaning(column, table: dict) -> tuple:
    known = F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, v[0] + "|" + v[1] + "|" + str(v[2]))))
    parts = F.split(known[column], r"\|")
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2)).cast("int")


# What folded words of a closure mean in English.
GLOSSES = [("eboulement|chute de pierres", "rockfall"), ("avalanche", "avalanche"), ("travaux", "works"), ("crue|inondation", "flood"), ("vent", "wind")]


def english_summary(kind: Column, window: Column, text_: Column) -> Column:
    """Act and window in English; a closure also says why, as far as its words are in the lexicon."""
    act = F.when(kind == "opening", "Reopened ").otherwise("Closed ")
    told = F.concat(act, F.coalesce(se.describe_window(window["start"], window["end"]), F.lit("without dates")))
    why = text.glosses(text_, GLOSSES)
    return F.when((kind == "closure") & (F.size(why) > 0), F.concat(told, F.lit(" ("), F.array_join(why, ", "), F.lit(")"))).otherwise(told)


def status_vocabulary(items: DataFrame, column: str, table: dict) -> tuple[DataFrame, DataFrame]:
    """(items with type, status, severity by their raw word; words outside the table with their counts, not guessed at)."""
    kind, status, severity = _meaning(F.col(column), table)
    told = items.withColumns({"type": kind, "status": status, "severity": severity})
    return told.filter("type is not null"), do.unknown_values(items, column, list(table))


def notices_to_claims(notices: DataFrame, dictionary: list[tuple[int, str]]) -> DataFrame:
    """Notices (doc_id, title, text): the title decides the type, title and body name the features, the first window of
    the title, else of the body, dates the claim; an undated one is unknown. One claim for each feature."""
    typed = notices.withColumn("type", text.classify_title(F.col("title"))).filter("type is not null")
    windowed = typed.withColumn("w", F.coalesce(dates.extract_date_window(F.col("title")), dates.extract_date_window(F.col("text"))))
    named = do.dictionary_mentions(typed.select("doc_id", F.concat_ws(" ", "title", "text").alias("text")), dictionary)
    claims = named.join(windowed, "doc_id").select(
        "doc_id",
        "feature_id",
        "type",
        F.when(F.col("type") == "opening", "open").otherwise("closed").alias("status"),
        F.when(F.col("type") == "opening", 0).otherwise(2).alias("severity"),
        F.col("w.start").alias("valid_from"),
        F.col("w.end").alias("valid_to"),
        F.col("w.rule").alias("date_rule"),
        F.when(F.col("w").isNotNull(), 0.9).otherwise(0.6).alias("confidence"),
        english_summary(F.col("type"), F.col("w"), F.concat_ws(" ", "title", "text")).alias("summary"),
    )
    return rv.widen_single_day_opening(rv.demote_unbounded(claims))


def digest_to_claims(digests: DataFrame, dictionary: list[tuple[int, str]], days: int = 21) -> DataFrame:
    """Digests (doc_id, posted, text): each sentence judged by itself, the first of each feature and type kept, its window
    `days` days from the posted day and marked inferred."""
    pieces = digests.select("doc_id", "posted", F.posexplode(text.split_sentences(F.col("text"))).alias("place", "sentence"))
    judged = pieces.withColumn("type", text.classify_sentence(F.col("sentence"))).filter("type is not null")
    flat = text.fold(F.col("sentence"))
    hits = F.array_distinct(F.array_compact(F.array(*(F.when(flat.rlike(p), F.lit(f)) for f, p in dictionary))))
    named = judged.withColumn("feature_id", F.explode(hits))
    won = do.first_claim_wins(named, ["feature_id", "type"])
    return won.select(
        "doc_id", "feature_id", "type", F.when(F.col("type") == "opening", "open").otherwise("restricted").alias("status"), F.when(F.col("type") == "opening", 0).otherwise(2).alias("severity"),
        F.col("posted").alias("valid_from"), F.date_add("posted", days).alias("valid_to"), F.lit(True).alias("inferred"), F.lit(0.8).alias("confidence"), F.col("sentence").alias("evidence"),
    )


def live_board_to_claims(items: DataFrame) -> DataFrame:
    """Board items (sector, lift, kind, is_pending, is_open): one claim for each sector and one for each lift; trails are skipped."""
    lifts = items.filter("kind = 'lift'")
    sectors = se.sector_rollup(lifts, ["sector"]).select(
        "sector", F.lit(None).cast("string").alias("lift"), "status", "severity", F.when(F.col("pending"), "outside_hours").alias("closure_kind"), F.col("note").alias("summary")
    )
    own = lifts.select(
        "sector",
        "lift",
        F.when(F.col("is_pending"), "unknown").when(F.col("is_open"), "open").otherwise("closed").alias("status"),
        F.when(F.col("is_pending") | F.col("is_open"), 0).otherwise(1).alias("severity"),
        F.when(F.col("is_pending"), "outside_hours").alias("closure_kind"),
        F.col("lift").alias("summary"),
    )
    return sectors.unionByName(own).withColumn("type", F.lit("operational_status"))


def calendar_to_claims(rows: DataFrame) -> DataFrame:
    """Season rows (season, title, subtitle, start, end) to opening claims that plan and don't assert."""
    return rows.select(
        "title", F.lit("opening").alias("type"), F.lit("unknown").alias("status"), F.lit(0).alias("severity"), F.lit(True).alias("schedule"), F.col("start").alias("valid_from"), F.col("end").alias("valid_to")
    )


def timetable_to_claims(pages: DataFrame) -> DataFrame:
    """Periods `du .. au ..` of pages (doc_id, text), each once and with both ends."""
    found = F.array_distinct(F.regexp_extract_all(text.fold_typography(F.col("text")), F.lit(r"(du \d{1,2}(?:\s*er)? [a-z]+(?: \d{4})? au \d{1,2} [a-z]+ \d{4})"), F.lit(1)))
    w = pages.select("doc_id", F.explode(found).alias("period")).withColumn("w", dates.extract_date_window(F.col("period"))).filter("w.start is not null and w.end is not null")
    return w.select("doc_id", F.lit("opening").alias("type"), F.lit("unknown").alias("status"), F.lit(True).alias("schedule"), F.col("w.start").alias("valid_from"), F.col("w.end").alias("valid_to"))


def wiki_states_to_claims(entries: DataFrame) -> DataFrame:
    """Entries (cand_id, name, state, guarded, modified): a state in words, else unguarded means unstaffed; silence and decoys give nothing."""
    kind, status, severity = _meaning(text.fold(F.col("state")), WIKI_STATES)
    judged = entries.filter(~text.is_decoy(F.col("name"))).withColumns({"kind_": kind, "status_": status, "severity_": severity})
    unguarded = F.col("kind_").isNull() & ~F.coalesce("guarded", F.lit(True))
    return judged.filter(F.col("kind_").isNotNull() | unguarded).select(
        "cand_id", F.coalesce("kind_", F.lit("opening")).alias("type"), F.coalesce("status_", F.lit("unstaffed")).alias("status"), F.coalesce("severity_", F.lit(1)).alias("severity"),
        (F.coalesce("severity_", F.lit(0)) == 3).alias("needs_review"), F.col("modified").alias("observed_at"),
    )


def availability_to_claims(days: DataFrame, as_of) -> DataFrame:
    """Days (entity, day, state) to one claim for the run of equal days that holds as_of."""
    kind, status, severity = _meaning(F.col("state"), HUT_STATES)
    return se.run_around(days, as_of).select(
        "entity", kind.alias("type"), status.alias("status"), severity.alias("severity"), F.col("start").alias("valid_from"), F.col("end").alias("valid_to"),
        F.when(F.col("state") == "CLOSED", "outside_hours").alias("closure_kind"), (F.col("state") == "SERVICED").alias("wardened"),
    ).filter("type is not null")


def booking_to_claims(days: DataFrame, as_of, states: tuple[str, ...] = ("available",)) -> DataFrame:
    """Bookable days to an opening from as_of to the season's last day, with how many days can be had; full isn't closed."""
    windows = se.season_from(days, as_of)
    return se.bookable_in_window(days, windows, states).select(
        "entity", F.lit("opening").alias("type"), F.lit("open").alias("status"), F.lit(0).alias("severity"), F.col("start").alias("valid_from"), F.col("end").alias("valid_to"), "bookable"
    )


def season_lines(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, block, place, line, year) with flat, label and rest: what stands before a colon labels its line; a
    label alone labels the lines of its block after it, up to the next one. The heading of a block is no label."""
    flat, cut = text.fold(F.trim("line")), F.instr("line", ":")
    label = F.trim(F.when(cut > 0, F.substr(F.col("line"), F.lit(1), cut - 1)))
    rest = F.trim(F.when(cut > 0, F.substr(F.col("line"), cut + 1)).otherwise(F.col("line")))
    heading = F.regexp_replace(flat, r"[\s:.-]+$", "") == WARDEN_HEADING
    own = lines.withColumns({"flat": flat, "rest": rest, "own": F.when(text.fold(label) != WARDEN_HEADING, F.nullif(label, F.lit("")))}).filter((F.col("flat") != "") & ~heading)
    dated = F.col("flat").rlike(r"^(ouverture|fermeture)")
    before = Window.partitionBy("doc_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = F.last(F.when((F.col("rest") == "") & ~dated, F.col("own")), True).over(before)
    return own.withColumn("label", F.when(dated, carried).otherwise(F.coalesce("own", carried)))


def open_close_pairs(lines: DataFrame) -> DataFrame:
    """(doc_id, block, label, valid_from, valid_to) from lines of season_lines: the last opening and the last closing line of
    a block and label are one season if they are in order. Labelled seasons of one block stay apart."""
    window = dates.extract_date_window(F.col("line"))
    read = lines.filter(F.col("flat").rlike(r"^(ouverture|fermeture)")).withColumns({"opens": F.startswith("flat", F.lit("ouverture")), "w": window})
    ends = read.groupBy("doc_id", "block", "label").agg(
        F.max_by("w.start", F.when(F.col("opens") & F.col("w.start").isNotNull(), F.col("place"))).alias("valid_from"),
        F.max_by("w.end", F.when(~F.col("opens") & F.col("w.end").isNotNull(), F.col("place"))).alias("valid_to"),
    )
    return ends.filter("valid_from < valid_to")


def warden_seasons_to_claims(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, block, place, line, year) to warden seasons: both ends on one line, by their days or in words, or an
    opening line and a closing line of one block and label."""
    read = season_lines(lines)
    said = F.when(text.fold(F.col("rest")).rlike(r"\b(du|dal) "), F.col("rest")).otherwise(F.concat(F.lit("du "), "rest"))
    window, coarse = dates.extract_date_window(said), dates.extract_coarse_window(F.col("rest"), F.col("year"))
    whole = read.filter(~F.col("flat").rlike(r"^(ouverture|fermeture)") & (F.col("rest") != "")).withColumns({"w": window, "c": coarse})
    days = F.coalesce(F.col("w.start") < F.col("w.end"), F.lit(False))
    whole = whole.filter(days | F.col("c").isNotNull()).select(
        "doc_id", "label", F.when(days, F.col("w.start")).otherwise(F.col("c.start")).alias("valid_from"), F.when(days, F.col("w.end")).otherwise(F.col("c.end")).alias("valid_to"), (~days).alias("approximate")
    )
    pairs = open_close_pairs(read).select("doc_id", "label", "valid_from", "valid_to", F.lit(False).alias("approximate"))
    return whole.unionByName(pairs).select("*", F.lit("opening").alias("type"), F.lit("open").alias("status"), F.lit(0).alias("severity"), F.lit(True).alias("wardened"))


def reports_to_claims(reports: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Newest report of each route as a condition: advisory, unknown in status, `days` days long, never a closure."""
    return first_by(reports, ["route"], F.desc("day"), F.desc("report_id")).select(
        "route", F.lit("condition").alias("type"), F.lit("unknown").alias("status"), "severity", F.col("day").alias("valid_from"), F.date_add("day", days).alias("valid_to"), F.lit(True).alias("advisory")
    )


def readings_to_claims(readings: DataFrame, docs: DataFrame, types: tuple[str, ...], statuses: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Stored model readings to (claims, rejects): each is held against its document, dated by its own words, and always waits for review."""
    checked = do.validate_claims(readings, docs, types, statuses)
    dated = checked.filter("reject_reason is null").withColumn("w", F.coalesce(dates.extract_date_window(F.col("dates_text")), dates.assume_year(F.col("dates_text"), F.col("year"))))
    claims = dated.withColumns({"valid_from": F.col("w.start"), "valid_to": F.col("w.end"), "date_rule": F.col("w.rule"), "needs_review": F.lit(True)}).drop("w", "reject_reason")
    return rv.demote_undated(claims), checked.filter("reject_reason is not null")


def read_again(
    docs: DataFrame, extractor: Callable[[DataFrame], DataFrame], columns: list[str], check: Callable[[DataFrame], Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(documents with the reason why one can't be read or null, claims that the extractor reads from the others)."""
    judged = docs.withColumn("error", check(docs) if check else F.lit(None).cast("string"))
    seen = judged.select("document_id", F.to_date("fetched_at").alias("seen_"))
    read = extractor(judged.filter("error is null").drop("error")).join(seen, "document_id").withColumn("observed_at", F.col("seen_")).drop("seen_")
    return judged, read.select(*columns)


def re_extract_report(judged: DataFrame, read: DataFrame) -> DataFrame:
    """Every document with its error and number of claims; of read_again alone, nothing being written, a dry run."""
    counts = read.groupBy("document_id").agg(F.count(F.lit(1)).alias("claims"))
    return judged.select("document_id", "error").join(counts, "document_id", "left").withColumn("claims", F.coalesce("claims", F.lit(0)))


def re_extract(docs: DataFrame, extractor: Callable[[DataFrame], DataFrame], stored: DataFrame, check: Callable[[DataFrame], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(claims after one extractor has read all stored documents again, report of every document: claims, error).

    Nothing is fetched, and a claim is as old as its document (observed_at from fetched_at). check gives a reason against a
    document, or null: one that can't be read records it, keeps its stored claims and doesn't stop the rest.
    """
    judged, read = read_again(docs, extractor, stored.columns, check)
    read = written(read, "read_again")
    return li.supersede_by_document(stored, read), re_extract_report(judged, read)


def apply_claims(stored: DataFrame, arrived: DataFrame, sources: DataFrame, as_of, runs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(live claims, status of touched features) after claims have arrived: reviews are inherited before anything is
    replaced, replaced and lifted claims retire, and with runs the unmentioned. Every step reads what the last has written."""
    reviewed = li.inherit_review(arrived, stored).drop("review_note").select(*stored.columns)
    every = written(li.append_statements(stored, reviewed), "every")
    live = li.settle(every, runs, sources)
    touched = st.touched_features(arrived, every.join(live.select("id"), "id", "left_anti"))
    return live, st.current_status(live.join(touched, "feature_id", "left_semi"), sources, as_of)


def arrive(
    docs: DataFrame, stored_docs: DataFrame, extract: Callable[[DataFrame], DataFrame], resolve: Callable[[DataFrame], tuple[DataFrame, DataFrame]], columns: list[str]
) -> dict[str, DataFrame]:
    """What fetched documents bring, before any stored claim is touched: documents, claims (columns), queue, counters.

    Of documents (document_id, source_id, content_hash, fetched_at) with equal source and content the earliest is kept, if
    it isn't a repeat of a stored one. New documents are extracted and resolved; what finds no feature goes to the queue.
    """
    keys = ["source_id", "content_hash"]
    known = stored_docs.select(*keys).distinct()
    first = written(li.keep_first_document(docs, keys, F.col("fetched_at"), F.col("document_id")).join(known, keys, "left_anti"), "fresh")
    claims, queue = resolve(extract(first))
    claims = written(claims.select(*columns), "claims")
    counters = docs.groupBy("source_id").agg(F.count(F.lit(1)).alias("documents"))
    for name, rows in (("fresh", first), ("claims", claims), ("queued", queue)):
        counters = counters.join(rows.groupBy("source_id").agg(F.count(F.lit(1)).alias(name)), "source_id", "left")
    return {"documents": first, "claims": claims, "queue": queue, "counters": counters.fillna(0)}


def ingest_batch(
    docs: DataFrame, stored_docs: DataFrame, stored: DataFrame, extract: Callable[[DataFrame], DataFrame], resolve: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
    runs: DataFrame, sources: DataFrame, as_of,
) -> dict[str, DataFrame]:
    """One batch from fetched documents to status: documents, live, status, queue, counters.

    What arrives is as in arrive; a repeat of a stored document is a sighting that confirms its claims. Then reviews,
    replacement, lifting, retirement and status as in apply_claims.
    """
    keys = ["source_id", "content_hash"]
    new = arrive(docs, stored_docs, extract, resolve, stored.columns)
    known = stored_docs.select(*keys, F.col("document_id").alias("known_id"))
    sightings = docs.join(known, keys).select(F.col("known_id").alias("document_id"), F.to_date("fetched_at").alias("seen_at"))
    live, status = apply_claims(confirm(stored, sightings).select(*stored.columns), new["claims"], sources, as_of, runs)
    return {"documents": new["documents"], "live": live, "status": status, "queue": new["queue"], "counters": new["counters"]}


def feature_list(features: DataFrame, claims: DataFrame, sources: DataFrame, facts: DataFrame, as_of) -> DataFrame:
    """The list that readers see: status, season, other notices, doubt and number of facts of each active feature."""
    status = st.current_status(claims, sources, as_of)
    view = sv.features_view(features.filter("active"), status, claims, sources)
    season = se.season_status(claims, as_of).select("feature_id", "season", "reason")
    counts, merged = st.other_notice_counts(claims, status, as_of), fa.merge_fact_values(facts, sources).groupBy("feature_id").agg(F.count(F.lit(1)).alias("facts"))
    joined = view.join(season, "feature_id", "left").join(counts, "feature_id", "left").join(merged, "feature_id", "left")
    return joined.withColumns(
        {"doubt": st.doubt(st.is_stale(as_of), st.is_overdue(as_of)), "other_notices": F.coalesce("other_notices", F.lit(0)), "facts": F.coalesce("facts", F.lit(0))}
    ).select("feature_id", "name", "status", "season", "reason", "doubt", "other_notices", "facts", "parent_name")


def feature_detail(features: DataFrame, claims: DataFrame, sources: DataFrame, facts: DataFrame, as_of, feature_id: int) -> DataFrame:
    """One feature of the list with its history, other notices, children, facts and last report; each array holds what one
    feature has, in order."""
    own, me = claims.filter(F.col("feature_id") == feature_id), F.col("feature_id") == feature_id
    status = st.current_status(own, sources, as_of)
    listed = feature_list(features, own, sources, facts, as_of).filter(me)

    def listed_as(rows: DataFrame, name: str, *fields: str) -> DataFrame:
        return rows.filter(me).groupBy("feature_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))

    parts = [
        listed_as(st.feature_history(own, sources), "history", "place", "id"),
        listed_as(st.other_notices(own, status, as_of), "notices", "place", "id"),
        listed_as(features.filter("parent_id is not null").select(F.col("parent_id").alias("feature_id"), F.col("feature_id").alias("child"), "name"), "children", "child", "name"),
        listed_as(fa.merge_fact_values(facts.filter(me), sources), "fact_values", "key", "value"),
        st.last_reported(own, status).select("feature_id", F.col("id").alias("last_report")),
    ]
    for part in parts:
        listed = listed.join(part, "feature_id", "left")
    return listed


def front_ledger(features: DataFrame, claims: DataFrame, sources: DataFrame, facts: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(rows of the front page by ledger and place, mix of notices): tracked features of the list in four ledgers."""
    status = st.current_status(claims, sources, as_of).select("feature_id", "severity", "claim_id")
    listed = feature_list(features, claims, sources, facts, as_of).join(features.select("feature_id", "kind", "parent_id", "altitude_m"), "feature_id").join(status, "feature_id", "left")
    view = written(sv.tracked(listed), "tracked")
    height = F.desc(F.coalesce("altitude_m", F.lit(-1)))
    ledgers = {
        "notices": sv.ledger(view.filter("status in ('closed', 'restricted')"), F.desc("severity"), F.col("name")),
        "lifts": sv.ledger(view.filter("kind like '%small%'"), sv.season_rank(F.col("season")), F.col("name")),
        "huts": sv.ledger(view.filter("kind like '%economy%'"), height, F.col("name")),
        "routes": sv.ledger(view.filter("kind not like '%small%' and kind not like '%economy%'"), height, F.col("name")),
    }
    rows = None
    for name, ledger in ledgers.items():
        own = ledger.select(F.lit(name).alias("ledger"), "place", "feature_id", "name", "status", "season")
        rows = own if rows is None else rows.unionByName(own)
    return rows, sv.notice_mix(view)


def rebuild_status(claims: DataFrame, stored_status: DataFrame, sources: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(status of every feature that has a claim, stored rows whose claim is gone), from all claims."""
    every = st.distinct_features(claims)
    return every.join(st.current_status(claims, sources, as_of), "feature_id", "left"), st.orphan_status(stored_status, claims)


def review_cycle(claims: DataFrame, decisions: DataFrame, sources: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(claims after the decisions, status of the features that these are about): accepted ones are reviewed, after their
    override, rejected ones are superseded, and both are computed again."""
    overrides = [c for c in ("valid_from", "valid_to", "status") if c in decisions.columns]
    if overrides:
        given = decisions.filter("accept").select("claim_id", *(F.col(c) if c in overrides else F.lit(None).cast(claims.schema[c].dataType).alias(c) for c in ("valid_from", "valid_to", "status")))
        claims = rv.apply_override(claims, given).select(*claims.columns)
    decided = written(rv.apply_decisions(claims, decisions, as_of).select(*claims.columns), "decided")
    about = claims.join(decisions.select(F.col("claim_id").alias("id")), "id", "left_semi").select("feature_id").distinct()
    return decided, st.current_status(decided.join(about, "feature_id", "left_semi"), sources, as_of)


def run_counters(runs: DataFrame, documents: DataFrame, claims: DataFrame, mentions: DataFrame) -> DataFrame:
    """(run_id, source_id, documents, claims, unresolved, confirmed, retired): what each run brought, zeros included.

    documents (source_id, fetched_at), claims, mentions (source_id, seen_at) belong to the last run of their source up to
    their day, of several on one day to the one with the largest id; what came before any run has a null run_id. All is
    counted by source and day first, so that only days are ordered, however many rows a source has.
    """
    names = ("documents", "claims", "unresolved", "confirmed", "retired")
    parts = (
        (documents, "fetched_at"), (claims, "observed_at"), (mentions, "seen_at"), (claims.filter("last_seen_at > observed_at"), "last_seen_at"), (claims.filter("superseded_at is not null"), "superseded_at"),
    )
    days = None
    for name, (rows, at) in zip(names, parts, strict=True):
        one = rows.groupBy("source_id", F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n")).select("source_id", "day", F.lit(name).alias("what"), "n")
        days = one if days is None else days.unionByName(one)
    by_day = days.groupBy("source_id", "day").pivot("what", list(names)).agg(F.sum("n"))
    started = runs.groupBy("source_id", F.to_date("started_at").alias("day")).agg(F.max("run_id").alias("run_id"))
    so_far = Window.partitionBy("source_id").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = by_day.join(started, ["source_id", "day"], "full").withColumn("run_id", F.last("run_id", True).over(so_far))
    counted = placed.groupBy("source_id", "run_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names))
    rest = runs.select("source_id", "run_id").join(counted.filter("run_id is not null"), ["source_id", "run_id"], "left")
    return rest.unionByName(counted.filter("run_id is null")).fillna(0, list(names))


def facts_from_directory(candidates: DataFrame, matches: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(feature_id, facts): whitelisted, non-null fields of matched candidates; a capacity of 0 is unknown."""
    values = F.map_from_arrays(F.array(*(F.lit(k) for k in keys)), F.array(*(F.col(k).cast("string") for k in keys)))
    kept = F.map_filter(values, lambda k, v: v.isNotNull() & ~((k == "capacity") & (v == "0")))
    return candidates.join(matches.select("feature_id", "cand_id").hint("merge"), "cand_id").select("feature_id", kept.alias("facts"))


def manual_write(stored: DataFrame, staged: DataFrame, sources: DataFrame, as_of) -> DataFrame:
    """Status after hand-written claims: those that pass the check are appended, replace and lift, and their features are computed again."""
    ok = written(rv.manual_claim_check(staged).filter("reject_reason is null").select(*stored.columns), "checked")
    live = li.settle(written(li.append_statements(stored, ok), "every"))
    return st.current_status(live.join(ok.select("feature_id").distinct(), "feature_id", "left_semi"), sources, as_of)
