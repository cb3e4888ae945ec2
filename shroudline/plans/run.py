"""Whole runs: detect, redact, verify, record; and undo from the record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import ensure_checkpoint_dir
from ..operators import findings as fnd
from ..operators import providers, redaction, replay, rules
from ..operators.selection import select_pages
from ..sources import audit
from ..sources.corpus import page_text
from ..sources.rulepacks import RulePack

#: Time of the lines unless another is given.
EPOCH = "1970-01-01T00:00:00Z"
#: Order of the lines of a session that are no findings: start, decomposition, calls before, failure and end behind them.
START, DECOMPOSED, CALLS, FAILED, END = -(1 << 62), -(1 << 61), -(1 << 60), 1 << 60, 1 << 61


@dataclass
class Result:
    """findings, report, leaks and events come from one checkpointed pass over the pages; pages are redacted when they are read.

    pages and metadata are those of the documents that pass; staged are all redacted pages, with what
    the verification found on each (leaks), as sources.gate writes them. cleared is what the verification would
    have found in the metadata had they not been cleared.
    """

    findings: DataFrame
    pages: DataFrame
    report: DataFrame
    events: DataFrame
    leaks: DataFrame
    staged: DataFrame
    metadata: DataFrame | None
    cleared: DataFrame | None = None


def detect(pages: DataFrame, pack: RulePack, selection: str | None = None, provider: providers.Provider | None = None, submissions: DataFrame | None = None, **options) -> DataFrame:
    """Findings of the regex categories, then those of the provider if there is one; the two are not deduplicated against each other."""
    chosen = select_pages(pages, selection) if selection else pages
    found = rules.regex_findings(chosen, pack)
    if provider is None or submissions is None:
        return found
    more, _, _ = providers.detect(chosen, submissions, provider, **options)
    return found.unionByName(more.withColumn("seq", F.col("seq") + (1 << 56)).select(*found.columns))


def searched(pages: DataFrame, found: DataFrame | RulePack) -> DataFrame:
    """Pages with a column found: the findings of a rule pack, or those of a table."""
    if not isinstance(found, RulePack):
        return redaction.with_found(pages, found)
    source = F.lit(f"rules:{found.name}")
    row = lambda f: F.struct(*[f[c].alias(c) for c in ("word_start", "word_end", "kind", "confidence")], source.alias("source"), rules.sequence(f["ord"], F.col("page"), f["nth"]).alias("seq"))
    return rules.annotate(pages, found).withColumn("found", F.transform("found", row))


def _recorded(f: Column, include_text: bool) -> Column:
    """A finding with its box, and with lengths and hashes of its text and context (the texts too if asked for)."""
    words = fnd.covered(f["word_start"], f["word_end"])
    text, around = fnd.text_of(words), fnd.context(f["word_start"], f["word_end"])
    box = fnd.box_union(words)
    keep = [f[c].alias(c) for c in ("word_start", "word_end", "kind", "confidence", "source", "seq")]
    more = [
        F.when(box.isNotNull(), F.array(box["x0"], box["y0"], box["x1"], box["y1"])).alias("bbox"),
        F.length(text).alias("text_length"), F.sha2(text, 256).alias("text_sha256"), F.sha2(around, 256).alias("context_sha256"),
    ]
    return F.struct(*keep, *more, *([text.alias("text"), around.alias("context")] if include_text else []))


def _seen() -> Column:
    """What the verification finds on the redacted page: text under the rectangles of its column rects."""
    return F.transform(redaction.covered_texts(redaction.left_over()), lambda t: F.struct(t["rect_id"].alias("rect_id"), t["recovered_text"].alias("recovered_text")))


def facts(pages: DataFrame, found: DataFrame | RulePack, include_text: bool = False) -> DataFrame:
    """What a record needs of each page, a few dozen bytes, its findings and leaks: (doc_id, page, n_bytes, n_left, before_sha256, after_sha256, seen, found).

    One pass over the pages gives it, and a checkpoint keeps it, so that findings, verdicts, audit
    lines and whatever an undo derives from them never search the pages again. n_left is the number of
    words that stay; seen is what is left under the rectangles of the page, if pages have a column rects.
    """
    ensure_checkpoint_dir(pages.sparkSession)
    before, after = page_text(F.col("words")), page_text(redaction.left_over())
    seen = _seen() if "rects" in pages.columns else F.array().cast("array<struct<rect_id:bigint,recovered_text:string>>")
    rows = searched(pages, found)
    if "rects" in pages.columns and "rects" not in rows.columns:
        rows = rows.join(pages.select("doc_id", "page", "rects"), ["doc_id", "page"])
    return (
        rows
        .select(
            "doc_id", "page", seen.alias("seen"), F.size(redaction.left_over()).alias("n_left"), F.octet_length(before).cast("long").alias("n_bytes"), F.sha2(before, 256).alias("before_sha256"), F.sha2(after, 256).alias("after_sha256"),
            F.transform("found", lambda f: _recorded(f, include_text)).alias("found"),
        )
        .checkpoint()
    )


def _page_hashes(column: str) -> Column:
    """A hash of the hashes of a document's pages, in their order."""
    pages = F.array_sort(F.collect_list(F.struct("page", column)))
    return F.sha2(F.array_join(F.transform(pages, lambda p: p[column]), ""), 256)


def run(
    pages: DataFrame, found: DataFrame | RulePack, metadata: DataFrame | None = None, rects: DataFrame | None = None, ts: str = EPOCH, include_text: bool = False, *,
    provider: str = "none", model: str = "none", rule_names: tuple[str, ...] | None = None, instructions: tuple[str, ...] = (), selection: str | None = None, calls: DataFrame | None = None, decomposed: DataFrame | None = None, inputs: DataFrame | None = None,
) -> Result:
    """Redact the pages, verify what comes out, and make the audit lines (session_id, ord, value).

    found is a table of findings, or the rule pack that pages are searched with. The rectangles
    (rects) are tested on the redacted pages: pages may have a column of that name, or rects is a table.
    The metadata of a document are cleared as its pages are redacted; the verification looks at the cleared ones.
    calls are the records of model calls (providers.call_records, with cost_usd if known); decomposed is
    (source, detail, rules) of the instructions. A document is a session of its own. inputs (doc_id, sha256, size)
    are the hashes and sizes of the files that documents come from (sources.blocks.content_hashes); where there are
    none, a document's hash is that of the hashes of its pages' texts.
    A document that fails the verification keeps its report and its audit lines, which list the leaks, but its pages are
    not among the result's. Documents without findings have no audit lines.
    """
    chosen = select_pages(pages, selection) if selection else pages
    if rects is not None:
        chosen = redaction.with_rects(chosen.drop("rects"), rects)
    record = facts(chosen, found, include_text)
    findings = record.select("doc_id", "page", F.inline("found")).select(*rules.FINDING_COLUMNS)
    cleared = None if metadata is None else redaction.clear_metadata(metadata)
    leaks = redaction.seen_leaks(record)
    counts = record.groupBy("doc_id").agg(F.sum(F.size("seen")).alias("n_overlays"))
    if cleared is None:
        counts = counts.withColumn("n_metadata", F.lit(0).cast("long"))
    else:
        left = redaction.metadata_leaks(cleared)
        leaks = leaks.unionByName(left)
        counts = counts.join(left.groupBy("doc_id").agg(F.count("*").alias("n_metadata")), "doc_id", "left").withColumn("n_metadata", F.coalesce("n_metadata", F.lit(0)))
    report = redaction.report_of(counts)
    after = searched(chosen, found)
    if "rects" in chosen.columns and "rects" not in after.columns:
        after = after.join(chosen.select("doc_id", "page", "rects"), ["doc_id", "page"])
    bad = report.where("NOT passed").select("doc_id")
    good = redaction.redact_found(after).join(bad, "doc_id", "left_anti")
    described = F.transform(_seen(), lambda t: F.struct(F.col("page").alias("page"), F.lit(redaction.OVERLAY).alias("kind"), F.lit(redaction.OVERLAY_DETAIL).alias("detail"))) if "rects" in after.columns else F.array().cast(redaction.LEAKS)
    staged = after.select("doc_id", "page", redaction.left_over().alias("words"), described.cast(redaction.LEAKS).alias("leaks"))
    passed_metadata = None if cleared is None else cleared.join(bad, "doc_id", "left_anti")
    per_doc = record.groupBy("doc_id").agg(
        F.sum(F.size("found")).alias("n"), F.count("*").alias("n_pages"), F.sum("n_bytes").alias("n_bytes"), _page_hashes("before_sha256").alias("before"), _page_hashes("after_sha256").alias("after")
    )
    if inputs is not None:
        per_doc = per_doc.join(inputs.select("doc_id", "sha256", "size"), "doc_id", "left").withColumns({"before": F.coalesce("sha256", "before"), "n_bytes": F.coalesce("size", "n_bytes")}).drop("sha256", "size")
    listed = F.array_sort(F.collect_list(F.struct("page", "kind", "detail")))
    sessions = per_doc.where("n > 0").join(report, "doc_id").join(leaks.groupBy("doc_id").agg(listed.alias("leaks")), "doc_id", "left")
    names = ("tokens_in", "tokens_out", "duration_ms")
    if calls is None:
        sessions = sessions.select("*", *[F.lit(0).cast("long").alias(c) for c in names], F.lit(0.0).alias("cost_usd"))
    else:
        cost = F.sum("cost_usd") if "cost_usd" in calls.columns else F.lit(0.0)
        spent = calls.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in names], cost.alias("cost_usd"))
        sessions = sessions.join(spent, "doc_id", "left").na.fill(0, [*names, "cost_usd"])
    key = F.col("doc_id").alias("session_id")
    strings = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    names_of = rule_names if rule_names is not None else (found.name,) if isinstance(found, RulePack) else ()
    asked = [] if selection is None else [F.lit(selection).alias("pages_spec"), _selected(selection).alias("pages_resolved")]
    start = audit.line(
        F.lit("session_start").alias("event"), F.lit(audit.SCHEMA_VERSION).alias("audit_schema_version"), F.col("doc_id").cast("string").alias("session_id"), F.lit(ts).alias("ts_start"), F.lit(audit.ENGINE_VERSION).alias("engine_version"),
        F.concat(F.lit("doc:"), F.col("doc_id")).alias("input_path"), F.col("before").alias("input_sha256"), F.col("n_pages").alias("input_pages"), F.col("n_bytes").alias("input_bytes"), F.concat(F.lit("redacted:"), F.col("doc_id")).alias("output_path"),
        F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.lit(model).alias("model_version"), strings(names_of).alias("rules"), strings(instructions).alias("instructions"), strings(()).alias("config_resolved_from"), *asked,
    )
    status = audit.session_status(F.col("passed"), F.col("n_leaks"))
    end = audit.line(
        F.lit("session_end").alias("event"), F.lit(ts).alias("ts_end"), F.col("s.status").alias("status"), F.col("n").alias("redactions_applied"), F.lit(0).alias("redactions_rejected"), F.lit(0).alias("redactions_excluded"), "duration_ms", "tokens_in", "tokens_out", "cost_usd",
        F.col("s.verify_result").alias("verify_result"), F.col("n_leaks").alias("verify_leak_count"), F.when(F.col("passed"), F.col("after")).otherwise("").alias("output_sha256"),
    )
    failed = audit.event_line("verification_failed", ts, F.coalesce("leaks", F.array().cast(redaction.LEAKS)).alias("leaks"))
    at = lambda k: F.lit(k).cast("long").alias("ord")
    # Start, failure and end of a session are three lines of one row.
    ends = F.array(F.struct(at(START), start.alias("value")), F.struct(at(FAILED), F.when(~F.col("passed"), failed).alias("value")), F.struct(at(END), end.alias("value")))
    events = sessions.withColumn("s", status).select(key, F.inline(ends)).where("value IS NOT NULL")
    lines = record.select(F.col("doc_id").alias("session_id"), F.explode(F.transform("found", lambda f: F.struct(f["seq"].alias("ord"), audit.finding_line(f, F.col("page"), ts, include_text).alias("value")))).alias("l"))
    events = events.unionByName(lines.select("session_id", "l.*"))
    begun = sessions.select("doc_id")
    if decomposed is not None:
        value = audit.event_line("instruction_decomposed", ts, F.col("source"), F.col("detail"), F.size("rules").alias("rule_count"), F.col("rules"))
        told = decomposed.limit(1).select(value.alias("value"))  # one row: the instructions of a run
        events = events.unionByName(begun.select(key, at(DECOMPOSED)).join(F.broadcast(told)))
    if calls is not None:
        rows = calls.join(begun, "doc_id", "left_semi").select(key, (F.lit(CALLS) + F.col("chunk_idx")).cast("long").alias("ord"), audit.call_line(ts).alias("value"))
        events = events.unionByName(rows)
    return Result(findings, good, report, events, leaks, staged, passed_metadata, None if metadata is None else redaction.metadata_leaks(metadata))


def _selected(selection: str) -> Column:
    from ..operators.selection import parse

    return F.array(*map(F.lit, parse(selection)))


def undo(pages: DataFrame, events: DataFrame, **selector) -> DataFrame:
    """Pages redacted anew with the applied findings of parsed audit events, but for those that the selector takes back.

    Without a selector all findings are taken back; selectors is a table of them for many sessions (replay.exclusions_of).
    session_key is the document's id as text.
    """
    found, excluded = _taken_back(events, selector)
    stay = replay.kept(found, excluded).withColumn("doc_id", F.col("session_key").cast("long"))
    sessions = found.select(F.col("session_key").cast("long").alias("doc_id")).distinct()
    return redaction.redact(pages.join(sessions, "doc_id", "left_semi"), stay)


def _taken_back(events: DataFrame, selector: dict) -> tuple[DataFrame, DataFrame]:
    """The applied findings, read from the log once, and those that the selector takes back."""
    ensure_checkpoint_dir(events.sparkSession)
    found = replay.applied(events).checkpoint()
    if "selectors" in selector:
        return found, replay.exclusions_of(found, selector["selectors"])
    return found, replay.exclusions(found, **selector) if selector else found.select("session_key", "ordinal")


def undo_lines(events: DataFrame, backups: DataFrame | None = None, ts: str = EPOCH, counts: DataFrame | None = None, **selector) -> DataFrame:
    """The log of an undo, (session_key, ord, value): undo_start, a line for each finding that is taken back, undo_end.

    backups (session_dir, copy_path) names the copy that an undo begins from: session_dir is the
    session_key of the log. counts (session_key, n_overlays, n_metadata) is the verification of the
    pages that come out; without it the result counts as skipped. Sessions that nothing is taken
    back of have no lines.
    """
    found, excluded = _taken_back(events, selector)
    marked = found.join(excluded.withColumn("gone", F.lit(True)), ["session_key", "ordinal"], "left")
    totals = marked.groupBy("session_key").agg(F.count("*").alias("total"), F.count("gone").alias("n_gone")).where("n_gone > 0")
    rows = totals.join(audit.sessions(events), "session_key")
    rows = rows.withColumn("backup_path", F.lit(None).cast("string")) if backups is None else rows.join(backups.select(F.col("session_dir").alias("session_key"), F.col("copy_path").alias("backup_path")), "session_key", "left")
    if counts is None:
        rows = rows.select("*", F.lit(None).cast("long").alias("leaks"))
    else:
        rows = rows.join(counts.select("session_key", (F.col("n_overlays") + F.col("n_metadata")).alias("leaks")), "session_key", "left")
    chosen = {k: selector.get(k) for k in ("pages", "page", "kind", "words")}
    shown = F.struct(
        F.lit(selector.get("picked") is not None).alias("interactive"), *[(F.lit(None).cast("string") if v is None else F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v)).alias(k) for k, v in chosen.items()]
    )
    start = audit.line(
        F.lit("undo_start").alias("event"), F.lit(audit.SCHEMA_VERSION).alias("audit_schema_version"), F.lit("undo").alias("schema_kind"), F.sha2(F.concat_ws(":", "session_key", F.lit(ts)), 256).alias("undo_id"), F.lit(ts).alias("ts_start"), F.lit(audit.ENGINE_VERSION).alias("engine_version"),
        F.col("session_id").alias("source_session_id"), F.col("ts_start").alias("source_session_ts"), F.col("session_key").alias("source_audit_path"), "input_path", "output_path", "backup_path", shown.alias("selector"), F.col("total").alias("findings_total"), F.col("n_gone").alias("findings_excluded"),
    )
    result = F.when(F.col("leaks").isNull(), "skipped").when(F.col("leaks") > 0, "fail").otherwise("pass")
    end = audit.line(
        F.lit("undo_end").alias("event"), F.lit(ts).alias("ts_end"), F.when(F.col("leaks") > 0, "verify_failed").otherwise("ok").alias("status"), (F.col("total") - F.col("n_gone")).alias("redactions_kept"), F.col("n_gone").alias("redactions_un_redacted"),
        result.alias("verify_result"), F.coalesce("leaks", F.lit(0)).alias("verify_leak_count"),
    )
    at = lambda k: F.lit(k).cast("long").alias("ord")
    both = rows.select("session_key", F.inline(F.array(F.struct(at(START), start.alias("value")), F.struct(at(END), end.alias("value")))))
    return both.unionByName(replay.undo_events(found, excluded, ts).select("session_key", F.col("ordinal").cast("long").alias("ord"), "value"))
