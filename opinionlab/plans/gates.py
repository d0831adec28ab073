"""Checks that decide whether to train, to stop, and to report.

Counting is Spark's; what the driver sees are reports of a few rows.  Checks
return their report always and raise only with strict.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar, text
from ..operators import reports

REPORT = "metric string, value double, status string, note string"
IN_DENOMINATOR = "是否纳入情感分母 是否纳入立场分母 纳入情感分母 in_sentiment_denominator in_stance_denominator in_denominator effective_for_sentiment".split()
EXCLUSION = "排除原因 不纳入原因 分母排除原因 exclusion_reason denominator_exclusion_reason exclude_reason".split()
LABEL = "情绪标签 情感标签 立场标签 label predicted_label sentiment_label stance_label".split()
#: Blockers that ask for an audit, and those that ask for another round.
AUDIT = ("missing_audit_labels", "high_low_confidence_needs_audit", "label_transition_drift", "new_batch_imbalanced")
CONTINUE = ("missing_reviewed_labels", "not_enough_review_rounds", "insufficient_label_coverage", "distribution_not_stable")


class GateFailed(ValueError):
    """A strict check that didn't pass."""


def _row(metric: str | Column, value: Column, status: str | Column = "info", note: str | Column = "") -> Column:
    own = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(own(metric).alias("metric"), value.cast("double").alias("value"), own(status).alias("status"), own(note).alias("note"))


def _rows(one: DataFrame, *entries: Column) -> DataFrame:
    return one.select(F.explode(F.array(*entries)).alias("r")).select("r.*")


def batch_audit(df: DataFrame, label: str, key: str, most_label: float = 0.8, most_duplicates: float = 0.3) -> DataFrame:
    """G1: rows, top label (its name in note) and its share, count by label, duplicates among the keys."""
    labels = df.select(F.trim(text.plain(F.col(label).cast("string"))).alias("label"))
    counts = reports.distribution(labels, "label")
    top = counts.withColumn("exact", F.col("count") / F.sum("count").over(reports.whole())).orderBy(F.desc("count"), "label").limit(1)
    status = F.when(F.col("exact") > most_label, "pause_before_training").otherwise("ok")
    dup = reports.duplicate_metrics(df, F.col(key))
    twice = F.when(F.try_divide(F.col("duplicate_extra_rows"), F.col("row_count")) > most_duplicates, "dedupe_review_batch").otherwise("ok")
    return (
        _rows(dup, _row("rows", F.col("row_count")), _row("duplicate_extra_rows", F.col("duplicate_extra_rows"), twice), _row("duplicate_expression_share", F.col("duplicate_share"), twice))
        .unionByName(_rows(top, _row("top_label", F.lit(None), "info", F.col("label")), _row("top_label_share", F.col("share"), status, F.col("label"))))
        .unionByName(_rows(counts, _row(F.concat(F.lit("label_count:"), "label"), F.col("count"))))
    )


def diagnosis(df: DataFrame, label: str, confidence: str, margin: str, body: str, low_confidence: float = 0.6, low_margin: float = 0.15) -> DataFrame:
    """G3; a null confidence or margin is a low one."""
    low = reports.low(confidence, low_confidence)
    key = F.trim(text.plain(F.col(body).cast("string")))
    texts = df.select(key.alias("k"), low.alias("low"), reports.low(margin, low_margin).alias("near")).groupBy("k").agg(F.count("*").alias("n"), F.count_if("low").alias("low"), F.count_if("near").alias("near"))
    one = texts.agg(F.sum("n").alias("n"), F.count("*").alias("u"), F.sum("low").alias("low"), F.sum("near").alias("near"), F.count_if(F.col("low") > 0).alias("lu"))
    part = scalar.share(F.col("low"), F.col("n"))
    fixed = _rows(
        one, _row("rows", F.col("n")), _row("low_confidence_share", part, F.when(F.try_divide(F.col("low"), F.col("n")) > 0.9, "diagnose_before_iterating").otherwise("ok")), _row("low_margin_share", scalar.share(F.col("near"), F.col("n"))),
        _row("duplicate_extra_share", scalar.share(F.col("n") - F.col("u"), F.col("n"))), _row("low_conf_unique_texts", F.col("lu")), _row("low_conf_duplicate_extra_rows", F.col("low") - F.col("lu")),
    )
    return fixed.unionByName(_rows(reports.distribution(df, label), _row(F.concat(F.lit("label_share:"), "label"), F.col("share"))))


def round_audit(df: DataFrame, label: str, confidence: str, margin: str, body: str, targets: list[str]) -> DataFrame:
    """G4's status table."""
    top = reports.top_label(df, label)
    counts = reports.effective_distribution(df, label, targets)
    gone = counts.filter("count = 0").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("label")), ",").alias("l"))
    shares = df.agg(F.round(F.avg(reports.low(confidence, 0.6).cast("double")), 4).alias("low"), F.round(F.avg(reports.low(margin, 0.15).cast("double")), 4).alias("near"))
    dup = reports.duplicate_metrics(df, F.col(body))
    return (
        _rows(dup, _row("rows", F.col("row_count")), _row("duplicate_extra_share", F.col("duplicate_share"), F.when(F.col("duplicate_share") > 0.3, "dedupe_review_batch").otherwise("info")))
        .unionByName(_rows(top, _row("top_label_share", F.col("share"), F.when(F.col("share") > 0.8, "pause_and_audit").otherwise("ok"), F.concat(F.lit("top_label="), "label"))))
        .unionByName(_rows(gone, _row("missing_target_labels", F.col("n"), F.when(F.col("n") > 0, "supplement_before_training").otherwise("ok"), F.col("l"))))
        .unionByName(_rows(shares, _row("low_confidence_share", F.col("low"), F.when(F.col("low") > 0.9, "diagnose_not_iterate_mechanically").otherwise("info")), _row("low_margin_share", F.col("near"))))
    )


def distribution_delta(now: DataFrame, before: DataFrame, label: str, targets: list[str], most: float = 0.05, before_label: str | None = None) -> DataFrame:
    """(label, previous_share, current_share, delta, abs_delta, status) of the targets or, without any, of both rounds' labels; exact shares are tested."""
    part = lambda d, c: reports.distribution(d, c, targets).withColumn("exact", F.col("count") / F.sum("count").over(reports.whole()))
    a, b = (part(d, c).select("label", F.col("exact").alias(n)) for d, c, n in ((before, before_label or label, "p"), (now, label, "c")))
    own = a.join(b, "label", "full_outer").na.fill(0.0, ["p", "c"])
    own = own.filter(F.col("label").isin(targets)) if targets else own
    delta = F.col("c") - F.col("p")
    status = F.when(F.abs(delta) > most, "changed_too_much").otherwise("ok")
    return own.select("label", F.round("p", 6).alias("previous_share"), F.round("c", 6).alias("current_share"), F.round(delta, 6).alias("delta"), F.round(F.abs(delta), 6).alias("abs_delta"), status.alias("status"))


def transition_drift(now: DataFrame, before: DataFrame, row_id: str, label: str, most: float = 0.2, before_label: str | None = None) -> DataFrame:
    """The transitions with status drift where a change's exact rate is over most."""
    own = reports.transitions(now, before, row_id, label, before_label)
    exact = F.col("n") / F.sum("n").over(Window.partitionBy("previous_label"))
    return own.withColumn("status", F.when((F.col("previous_label") != F.col("current_label")) & (exact > most), "drift").otherwise("ok"))


def audit_agreement(df: DataFrame, predicted: str, confirmed: str, most: float = 0.15) -> DataFrame:
    """One row (audit_rows, error_rows, error_share, max_error_share, status) over pairs without a null; the exact share is tested."""
    both = F.col(predicted).isNotNull() & F.col(confirmed).isNotNull()
    wrong = both & (F.col(predicted).cast("string") != F.col(confirmed).cast("string"))
    own = df.agg(F.count_if(both).alias("audit_rows"), F.count_if(wrong).alias("error_rows"))
    status = F.when(F.try_divide(F.col("error_rows"), F.col("audit_rows")) > most, "too_many_errors").otherwise("ok")
    return own.select("audit_rows", "error_rows", scalar.share(F.col("error_rows"), F.col("audit_rows")).alias("error_share"), F.lit(most).alias("max_error_share"), status.alias("status"))


def decide(codes: Column) -> Column:
    """The status for an array of blocker codes."""
    any_of = lambda own: F.arrays_overlap(codes, F.array(*(F.lit(c) for c in own)))
    return F.when(F.size(codes) == 0, "candidate_stop").when(any_of(AUDIT), "audit_needed").when(any_of(CONTINUE), "continue").otherwise("incomplete")


#: What a decision means.
MEANING = {
    "candidate_stop": "every check allows an end; whether it serves the purpose is for people to say",
    "audit_needed": "neither stop nor go on: look at audit samples first",
    "continue": "label and train again before anything is reported",
    "incomplete": "evidence is lacking, and the result has to be called incomplete",
}


def _checks(
    predictions: DataFrame, targets: list[str], row_id: str, *, label: str = "predicted_label", confidence: str = "predicted_confidence", previous: DataFrame | None = None, reviewed: DataFrame | None = None, new_batch: DataFrame | None = None, audit: DataFrame | None = None, review_label: str = "label", audit_predicted: str = "predicted_label", previous_label: str | None = None,
    rounds: int = 0, least_rounds: int = 2, least_per_label: int = 20, most_delta: float = 0.05, most_error: float = 0.15, most_top: float = 0.8, most_rate: float = 0.2, low_confidence: float = 0.6, most_low: float = 0.9,
) -> tuple[dict[str, bool], list[tuple[str, str, str, float | None, str]]]:
    """(whether each check holds, reasons(level, code, metric, value, message)); shares are tested as they are and rounded for the report."""
    reasons: list[tuple[str, str, str, float | None, str]] = []
    say = lambda level, code, message="", metric="", value=None: reasons.append((level, code, metric, None if value is None else round(float(value), 4), message))
    before = previous_label or label
    holds = dict.fromkeys(("coverage_ok", "new_batch_ok", "distribution_ok", "transition_ok", "audit_ok", "low_confidence_ok"), True)

    def fail(check: str, code: str, *what: object) -> None:
        holds[check] = False
        say("blocker", code, *what)

    if not targets:
        say("blocker", "missing_target_labels", "no target labels were given")
    if rounds < least_rounds:
        say("blocker", "not_enough_review_rounds", f"at least {least_rounds} rounds of review are needed", "review_rounds", rounds)
    if reviewed is None:
        fail("coverage_ok", "missing_reviewed_labels", "no reviewed labels were given")
    elif review_label not in reviewed.columns:
        fail("coverage_ok", "missing_review_label_col", f"the reviewed labels have no column {review_label}")
    elif targets:
        for r in reports.reviewed_coverage(reviewed, review_label, targets, least_per_label).filter("status = 'insufficient'").orderBy("label").collect():
            fail("coverage_ok", "insufficient_label_coverage", f"{r['label']} has under {least_per_label} reviewed rows", f"reviewed_count:{r['label']}", r["reviewed_count"])
    if new_batch is not None:
        top = None
        if review_label in new_batch.columns:
            shares = reports.distribution(new_batch, review_label).withColumn("exact", F.col("count") / F.sum("count").over(reports.whole()))
            top = shares.orderBy(F.desc("count"), "label").limit(1).first()
        if top is None:
            say("warning", "new_batch_unavailable", "the new batch has no rows or no labels")
        elif top["exact"] > most_top:
            fail("new_batch_ok", "new_batch_imbalanced", "one label fills most of the new batch", "new_batch_top_label_share", top["exact"])
            say("info", "new_batch_top_label", top["label"])
    if previous is None:
        fail("distribution_ok", "missing_previous_predictions", "no earlier round's predictions were given")
        holds["transition_ok"] = False
    else:
        there = label in predictions.columns and before in previous.columns
        if not there or predictions.isEmpty() or previous.isEmpty():
            fail("distribution_ok", "missing_distribution_columns", "a round has no rows or no labels")
        else:
            for r in distribution_delta(predictions, previous, label, targets, most_delta, before).filter("status <> 'ok'").orderBy("label").collect():
                fail("distribution_ok", "distribution_not_stable", f"the share of {r['label']} moved by more than {most_delta}", f"abs_delta:{r['label']}", r["abs_delta"])
        if not there or row_id not in predictions.columns or row_id not in previous.columns:
            say("warning", "transition_unavailable", "a round lacks its ids or labels")
        elif predictions.select(row_id).join(previous.select(row_id), row_id, "left_semi").isEmpty():
            say("warning", "transition_empty", "the rounds have no row in common")
        else:
            for r in transition_drift(predictions, previous, row_id, label, most_rate, before).filter("status = 'drift'").orderBy("previous_label", "current_label").collect():
                fail("transition_ok", "label_transition_drift", f"too many rows went from {r['previous_label']} to {r['current_label']}", f"transition_rate:{r['previous_label']}->{r['current_label']}", r["rate"])
    if audit is None:
        fail("audit_ok", "missing_audit_labels", "no audited rows were given")
    elif audit_predicted not in audit.columns or review_label not in audit.columns:
        fail("audit_ok", "missing_audit_columns", "audited rows need a predicted and a confirmed label")
    else:
        r = audit_agreement(audit, audit_predicted, review_label, most_error).first()
        if not r["audit_rows"]:
            fail("audit_ok", "empty_audit_labels", "no audited row has both labels")
        elif r["status"] != "ok":
            fail("audit_ok", "audit_error_too_high", "audited rows differ too often from their predictions", "audit_error_share", r["error_share"])
    part = predictions.agg(F.avg(reports.low(confidence, low_confidence).cast("double"))).first()[0] if confidence in predictions.columns else None
    what = ("low confidence is common, which an audit has to explain", "low_confidence_share", part)
    if part is None:
        say("warning", "confidence_unavailable", "there are no confidences")
    elif part <= most_low:
        say("info", "low_confidence_checked", "", *what[1:])
    elif holds["audit_ok"]:
        say("warning", "high_low_confidence_audited", *what)
    else:
        fail("low_confidence_ok", "high_low_confidence_needs_audit", *what)
    return holds, reasons


_REASONS = "level string, code string, metric string, value double, message string"


def _status(codes: list[str]) -> str:
    own = {*codes}
    return "candidate_stop" if not own else "audit_needed" if own & {*AUDIT} else "continue" if own & {*CONTINUE} else "incomplete"


def convergence(predictions: DataFrame, targets: list[str], row_id: str, **how) -> tuple[str, DataFrame]:
    """(status, reasons(level, code, metric, value, message)).

    Columns that are absent and tables without rows are reasons of their own, not
    errors; thresholds and tables are those of ``_checks``.
    """
    _, reasons = _checks(predictions, targets, row_id, **how)
    return _status([r[1] for r in reasons if r[0] == "blocker"]), predictions.sparkSession.createDataFrame(reasons, _REASONS)


def convergence_reports(predictions: DataFrame, targets: list[str], row_id: str, **how) -> dict[str, DataFrame]:
    """The gate's tables: reasons; metrics(metric, value), checks as 1 or 0; decision(status, can_stop, meaning, blockers)."""
    spark = predictions.sparkSession
    holds, reasons = _checks(predictions, targets, row_id, **how)
    blockers = [r[1] for r in reasons if r[0] == "blocker"]
    metrics = [(k, float(v)) for k, v in holds.items()] + [("blocker_count", float(len(blockers))), ("warning_count", float(sum(r[0] == "warning" for r in reasons)))]
    status = _status(blockers)
    return {
        "reasons": spark.createDataFrame(reasons, _REASONS),
        "metrics": spark.createDataFrame(metrics, "metric string, value double"),
        "decision": spark.createDataFrame([(status, not blockers, MEANING[status], ",".join(blockers))], "status string, can_stop boolean, meaning string, blockers string"),
    }


PROBLEMS = ("missing_label_column", "missing_in_denominator_column", "missing_exclusion_reason_column", "excluded_rows_missing_reason", "effective_rows_missing_label", "zero_effective_denominator", "unknown_or_blank_denominator_flags")


def denominator_counts(df: DataFrame, label: str | None, flag: str | None, reason: str | None, by: list[str] | None = None) -> DataFrame:
    """total_rows, effective_rows, excluded_rows, unknown_flag_rows, excluded_missing_reason, effective_missing_label, problem_codes, status; by group if asked."""
    blank = lambda c: F.lower(F.trim(text.plain(F.col(c).cast("string")))).isin(*scalar.NOTHING) if c else F.lit(True)
    own = df.select(*(by or []), (scalar.flag(F.col(flag)) if flag else F.lit("")).alias("_f"), blank(label).alias("_l"), blank(reason).alias("_r"))
    yes, no = F.col("_f") == "yes", F.col("_f") == "no"
    counts = own.groupBy(*(by or [])).agg(
        F.count("*").alias("total_rows"), F.count_if(yes).alias("effective_rows"), F.count_if(no).alias("excluded_rows"), F.count_if(~yes & ~no).alias("unknown_flag_rows"),
        F.count_if(no & F.col("_r")).alias("excluded_missing_reason"), F.count_if(yes & F.col("_l")).alias("effective_missing_label"),
    )
    tests = [F.lit(label is None), F.lit(flag is None), F.lit(reason is None), (F.col("excluded_missing_reason") > 0) & F.lit(reason is not None), (F.col("effective_missing_label") > 0) & F.lit(label is not None), (F.col("effective_rows") == 0) & F.lit(flag is not None), (F.col("unknown_flag_rows") > 0) & F.lit(flag is not None)]
    codes = F.array_join(F.array_sort(F.array_compact(F.array(*(F.when(t, p) for t, p in zip(tests, PROBLEMS, strict=True))))), ";")
    return counts.withColumn("problem_codes", codes).withColumn("status", F.when(F.col("problem_codes") == "", "pass").otherwise("fail"))


def denominator_gate(df: DataFrame, label: str | None = None, flag: str | None = None, reason: str | None = None, strict: bool = False) -> DataFrame:
    """G13 with columns found by their usual names."""
    out = denominator_counts(df, scalar.find_column(df, LABEL, label), scalar.find_column(df, IN_DENOMINATOR, flag), scalar.find_column(df, EXCLUSION, reason))
    if strict and (r := out.first())["status"] != "pass":
        raise GateFailed(r["problem_codes"])
    return out


def verdict(statuses: Column) -> Column:
    """Fail over warn over pass, of an array."""
    return F.when(F.array_contains(statuses, "fail"), "fail").when(F.array_contains(statuses, "warn"), "warn").otherwise("pass")


def package_checks(spark: SparkSession, folder: str, final: str | None = None, required: list[str] = (), sentiment: bool = True, read: Callable[[SparkSession, str], DataFrame] | None = None, strict: bool = False) -> DataFrame:
    """(check, status, evidence, action) of a delivery folder."""
    from ..sources.readers import read_sheets

    read = read or (lambda s, p: read_sheets(s, p)[0][1])
    out: list[tuple[str, str, str, str]] = []
    there = os.path.isdir(folder)
    out.append(("output_dir_exists", "pass" if there else "fail", folder, "" if there else "make the folder"))
    table, path = None, os.path.join(folder, final) if final else None
    if path is None:
        out.append(("final_output_provided", "warn", "", "name the final table"))
    elif not os.path.exists(path):
        out.append(("final_output_exists", "fail", path, "write the final table"))
    else:
        try:
            table = read(spark, path)
            out.append(("final_output_readable", "pass", f"{path}: {table.count()} rows, {len(table.columns)} columns", ""))
        except Exception as e:  # noqa: BLE001 - whatever a reader says is the finding
            out.append(("final_output_readable", "fail", path, str(e)[:200]))
    for name in required:
        found = os.path.exists(os.path.join(folder, name))
        out.append((f"required_file:{name}", "pass" if found else "fail", os.path.join(folder, name), "" if found else "write it or don't require it"))
    if sentiment:
        gate: Mapping | None = denominator_gate(table).first().asDict() if table is not None else None
        out.append(("denominator_gate", gate["status"] if gate else "fail", gate["problem_codes"] if gate else "", "" if gate and gate["status"] == "pass" else "mend the denominator's columns"))
    statuses = {x[1] for x in out}
    out.append(("overall", "fail" if "fail" in statuses else "warn" if "warn" in statuses else "pass", "", ""))
    if strict and out[-1][1] == "fail":
        raise GateFailed("; ".join(x[0] for x in out if x[1] == "fail"))
    return spark.createDataFrame(out, "check string, status string, evidence string, action string")


def route(n: int, simple: bool = False) -> str:
    """D3: small or simple tables are labelled directly, those of thousands of rows by active learning."""
    return "direct" if simple or n < 1000 else "active_learning"
