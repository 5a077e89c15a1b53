"""Joins of findings, evidence, answers, verdicts and judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from revgrain import fixed
from revgrain.functions import text
from revgrain.functions.patterns import last_part
from revgrain.functions.paths import norm_path
from revgrain.operators.matching import FEW, contained
from revgrain.operators.ranking import top_per_key

#: Bytes of a query's snippets that may travel beside each of its claims.
FEW_BYTES = 1 << 16


def explode_indexed(df: DataFrame, keys: list[str], array: str, index: str) -> DataFrame:
    """Array of structs to one row per element with its position."""
    return df.select(*keys, F.posexplode(array).alias(index, "_e")).select(*keys, index, "_e.*")


def resolve_evidence(refs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence rows for (run_id, owner_id, evidence_ids); ids without a row are left out."""
    ids = refs.select("run_id", "owner_id", F.explode("evidence_ids").alias("ev_id"))
    return ids.join(evidence, ["run_id", "ev_id"])


def traceability_problems(owners: DataFrame, evidence: DataFrame) -> DataFrame:
    """Owners (issues and findings) without evidence, and references to evidence that does not exist."""
    bare = owners.where(F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0).select(
        "run_id", "owner_kind", "owner_id", F.lit("no evidence").alias("problem"), F.lit(None).cast("string").alias("ev_id")
    )
    named = owners.select("run_id", "owner_kind", "owner_id", F.explode("evidence_ids").alias("ev_id"))
    dangling = named.join(evidence.select("run_id", "ev_id"), ["run_id", "ev_id"], "left_anti").select(
        "run_id", "owner_kind", "owner_id", F.lit("missing evidence").alias("problem"), "ev_id"
    )
    return bare.unionByName(dangling)


def pair_results(outputs: DataFrame, judgments: DataFrame) -> DataFrame:
    """Every output with its judgment, or with nulls."""
    return outputs.join(judgments, "sample_id", "left")


def predictions_with_truth(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    return predictions.join(truth, "sample_id")


def issue_verdicts(verdicts: DataFrame, issues: DataFrame) -> DataFrame:
    """Each verdict with the issue at its position; a position without an issue keeps its verdict.

    verdicts: sample_id, issue_index, verdict. issues: sample_id, issue_index, severity, sources.
    """
    return verdicts.join(issues, ["sample_id", "issue_index"], "left")


def judgment_lookup(records: DataFrame, judgments: DataFrame) -> DataFrame:
    """Records with verdict and grounding of the last judgment of their sample, '' and false where none exists."""
    order = F.col("seq") if "seq" in judgments.columns else F.lit(0)
    last = judgments.groupBy("sample_id").agg(
        F.max_by(F.struct("verdict", "uses_supported_evidence"), order).alias("_j")
    )
    return records.join(last, "sample_id", "left").select(
        *[F.col(c) for c in records.columns],
        F.coalesce("_j.verdict", F.lit("")).alias("verdict"),
        F.coalesce("_j.uses_supported_evidence", F.lit(False)).alias("grounded"),
    )


def answer_citations(answers: DataFrame) -> DataFrame:
    """(sample_id, answer) to distinct (sample_id, file, line) with the number of times each is cited."""
    refs = answers.select("sample_id", F.inline(text.citations("answer")))
    return refs.groupBy("sample_id", "file", "line").agg(F.count("*").alias("times"))


def ground_citations(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Check each cited file:line against the same sample's evidence of that file.

    A line is verified inside [start_line, end_line] (end 0 means start), by a line number printed in the snippet, or
    by evidence on the whole file (0, 0). Nothing is paired: spans are first reduced to their furthest end per start
    line, then one ordered pass over spans and cited lines carries the furthest end seen so far. A group therefore
    never exceeds the number of distinct lines of one file, however many rows cite it.
    """
    ev = evidence.where(F.coalesce("file", F.lit("")) != "").withColumn("file", norm_path("file"))
    end = F.when(F.coalesce("end_line", F.lit(0)) == 0, F.col("start_line")).otherwise(F.col("end_line"))
    whole = (F.col("start_line") == 0) & (end == 0)
    low = F.when(whole, F.lit(-1)).otherwise(F.col("start_line")).cast("bigint")
    high = F.when(whole, F.lit((1 << 62))).otherwise(end).cast("bigint")
    spans = ev.select("sample_id", "file", low.alias("pos"), high.alias("until"))
    if "snippet" in evidence.columns:
        printed = F.regexp_extract_all(F.coalesce("snippet", F.lit("")), F.lit(r"(?m)^\s*(\d+)\|"), F.lit(1))
        lines = ev.select("sample_id", "file", F.explode(printed).alias("n")).select(
            "sample_id", "file", F.col("n").try_cast("bigint").alias("pos")
        )
        spans = spans.unionByName(lines.withColumn("until", F.col("pos")))
    spans = spans.groupBy("sample_id", "file", "pos").agg(F.max("until").alias("until"))
    marks = spans.withColumn("kind", F.lit(0)).withColumn("times", F.lit(0).cast("bigint")).unionByName(
        citations.select(
            "sample_id", "file", F.col("line").alias("pos"), F.lit(None).cast("bigint").alias("until"),
            F.lit(1).alias("kind"), "times",
        )
    )
    group = Window.partitionBy("sample_id", "file")
    seen = group.orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = marks.withColumn("reach", F.max("until").over(seen)).withColumn("known", F.min("kind").over(group) == 0)
    verified = F.coalesce(F.col("reach") >= F.col("pos"), F.lit(False))
    reason = F.when(~F.col("known"), "file not found in evidence").when(~verified, "line out of evidence range")
    return marks.where("kind = 1").select(
        "sample_id", "file", F.col("pos").alias("line"), "times", verified.alias("verified"), reason.alias("reason")
    )


def grounding_summary(samples: DataFrame, grounded: DataFrame) -> DataFrame:
    """Per sample: total references, verified ones, whether all hold, whether there are none."""
    per = grounded.groupBy("sample_id").agg(
        F.sum("times").alias("total_refs"),
        F.sum(F.when(F.col("verified"), F.col("times")).otherwise(0)).alias("verified_refs"),
    )
    total = F.coalesce("total_refs", F.lit(0))
    good = F.coalesce("verified_refs", F.lit(0))
    return samples.select("sample_id").distinct().join(per, "sample_id", "left").select(
        "sample_id", total.alias("total_refs"), good.alias("verified_refs"),
        ((total > 0) & (total == good)).alias("grounded"), (total == 0).alias("no_refs"),
    )


def citations_strict(samples: DataFrame, citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every citation is the first line of some evidence; an answer without citations does not count."""
    places = evidence.select("sample_id", norm_path("file").alias("file"), F.col("start_line").cast("bigint").alias("line"))
    # Citations and places of equal key meet in one aggregate, without sorting either side.
    key = ["sample_id", "file", "line"]
    marks = citations.select(*key, F.lit(1).alias("kind")).unionByName(places.dropna(subset=key).withColumn("kind", F.lit(2)))
    kinds = marks.groupBy(*key).agg(F.bit_or("kind").alias("kinds")).where("kinds <> 2 and sample_id is not null")
    # So do samples and their citations: 1 is a sample, 2 a hit, 4 a miss.
    asked = samples.select("sample_id", F.lit(1).alias("mark"))
    per = asked.unionByName(kinds.select("sample_id", F.when(F.col("kinds") == 3, 2).otherwise(4).alias("mark")))
    per = per.groupBy("sample_id").agg(F.bit_or("mark").alias("marks")).where(F.col("marks").bitwiseAND(1) == 1)
    return per.select("sample_id", (F.col("marks") == 3).alias("grounded"))


def expected_file_hit(expected: Column, found: Column) -> Column:
    """Array test: nothing expected, or one expected file found."""
    expected = F.transform(F.coalesce(expected, F.array().cast("array<string>")), norm_path)
    found = F.transform(F.coalesce(found, F.array().cast("array<string>")), norm_path)
    return (F.size(expected) == 0) | F.coalesce(F.arrays_overlap(expected, found), F.lit(False))


def expected_file_hits(expected: DataFrame, evidence: DataFrame) -> DataFrame:
    """Same test on rows: expected (sample_id, file), a null file for samples that expect nothing."""
    found = evidence.select("sample_id", norm_path("file").alias("file")).distinct().withColumn("hit", F.lit(True))
    rows = expected.select("sample_id", norm_path("file").alias("file"))
    return rows.join(found, ["sample_id", "file"], "left").groupBy("sample_id").agg(
        (F.bool_or(F.coalesce("hit", F.lit(False))) | (F.count("file") == 0)).alias("file_hit")
    )


def claims_covered(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, claim_index, claim) with ``covered``: a keyword of the claim occurs in some snippet of the query."""
    snippets = evidence.select("query_id", F.lower(F.coalesce("snippet", F.lit(""))).alias("snippet"))
    busy = snippets.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("snippet").cast("long")).alias("bytes"))
    busy = busy.where((F.col("n") > FEW) | (F.col("bytes") > FEW_BYTES)).select("query_id").where("query_id is not null")
    if busy.isEmpty():
        return _covered_by_few(claims, snippets)
    claims_of = lambda how: claims.join(busy, "query_id", how).select(*claims.columns)
    few = _covered_by_few(claims_of("left_anti"), snippets.join(busy, "query_id", "left_anti"))
    return few.unionByName(_covered_by_many(claims_of("left_semi"), snippets.join(busy, "query_id", "left_semi")))


def _covered_by_few(claims: DataFrame, snippets: DataFrame) -> DataFrame:
    """Claims whose queries have few snippets; these travel as one array a query, so each claim is sent and cut into words once."""
    packed = snippets.groupBy("query_id").agg(F.collect_set("snippet").alias("_snippets"))
    words = F.transform(text.claim_keywords("claim"), F.lower)
    said = F.exists(words, lambda w: F.exists("_snippets", lambda s: F.contains(s, w)))
    covered = F.coalesce(said, F.lit(False)) & F.col("claim_index").isNotNull()
    return claims.join(packed, "query_id", "left").select(*claims.columns, covered.alias("covered"))


def _covered_by_many(claims: DataFrame, snippets: DataFrame) -> DataFrame:
    words = claims.select("query_id", "claim_index", F.explode(text.claim_keywords("claim")).alias("word"))
    words = words.withColumn("word", F.lower("word"))
    snippets = snippets.distinct()
    found = contained(snippets, words, ["query_id"], "snippet", "word", once="value").select("query_id", "word").distinct()
    covered = words.join(found, ["query_id", "word"]).select("query_id", "claim_index").distinct()
    return claims.join(covered.withColumn("_hit", F.lit(True)), ["query_id", "claim_index"], "left").select(
        *claims.columns, F.coalesce("_hit", F.lit(False)).alias("covered")
    )


def evidence_reuse(tasks: DataFrame, prior: DataFrame, limit: int = 10) -> DataFrame:
    """First ``limit`` prior evidence rows of a query whose snippet holds the last name part of one of its targets."""
    names = tasks.select("query_id", F.lower(last_part("target")).alias("name"))
    rows = prior.select("query_id", "ev_id", "seq", F.lower(F.coalesce("snippet", F.lit(""))).alias("low"))
    hits = contained(rows, names, ["query_id"], "low", "name", once="row")
    hits = hits.groupBy("query_id", "ev_id").agg(F.min("seq").alias("seq"))
    return top_per_key(hits, ["query_id"], [F.asc("seq"), F.asc("ev_id")], limit, "rank")


def reusable_evidence(keywords: DataFrame, prior: DataFrame) -> DataFrame:
    """Every prior evidence row with a keyword (query_id, word) in its snippet, source or file; shown as a reference."""
    low = F.lower(F.concat_ws(" ", F.coalesce("snippet", F.lit("")), F.coalesce("source", F.lit("")), F.coalesce("file", F.lit(""))))
    rows = prior.withColumn("_low", low)
    words = keywords.select("query_id", F.lower("word").alias("word"))
    hits = contained(rows.select("query_id", "ev_id", "source", "file", "start_line", "_low"), words, ["query_id"], "_low", "word", once="row")
    ref = F.concat(F.lit("["), "source", F.lit("] "), "file", F.lit(":"), F.col("start_line").cast("string"))
    return hits.select("query_id", "ev_id", ref.alias("ref")).distinct()


def answer_missing_evidence(slot_evidence: DataFrame, citations: DataFrame, per_file: int = 8) -> DataFrame:
    """Slot evidence whose place the answer does not cite, at most ``per_file`` rows for each file."""
    cited = citations.select("query_id", "file", F.col("line").alias("start_line"))
    rows = slot_evidence.dropDuplicates(["query_id", "ev_id"])
    missing = rows.join(cited, ["query_id", "file", "start_line"], "left_anti")
    return top_per_key(missing, ["query_id", "file"], [F.asc("seq")], per_file, "rank")


def claim_packets(task_claims: DataFrame, task_evidence: DataFrame, limit: int = 4) -> DataFrame:
    """First ``limit`` evidence places of each claim, by (task_claims: query_id, task_id, claim)."""
    rows = task_claims.distinct().join(task_evidence, ["query_id", "task_id"])
    rows = rows.groupBy("query_id", "claim", "ev_id").agg(F.min(F.struct("seq", "file", "start_line")).alias("p"))
    ranked = top_per_key(rows, ["query_id", "claim"], [F.asc("p.seq"), F.asc("ev_id")], limit, "rank")
    ref = F.concat(F.lit("["), "ev_id", F.lit("] "), "p.file", F.lit(":"), F.col("p.start_line").cast("string"))
    packed = ranked.groupBy("query_id", "claim").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", ref.alias("ref")))), lambda x: x["ref"]), ", ").alias("evidence")
    )
    return packed


def session_join(requests: DataFrame, sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """The user of each request's token: hash equality with a session that has not expired."""
    hashed = requests.withColumn("token_hash", F.sha2("token", 256))
    alive = sessions.where(F.col("expires_at") > now)
    return hashed.join(alive, "token_hash").join(users, "user_id")


def review_context(
    files: DataFrame, findings: DataFrame, symbols: DataFrame, patches: DataFrame,
    max_files: int | None = None, max_findings: int | None = None, max_symbols: int | None = None,
    chars: int | None = None, message_chars: int | None = None,
) -> DataFrame:
    """What a reviewer sees of a run's files: findings, symbols and patch, all and whole unless the caller sets limits."""
    keys = ["run_id", "path"]

    def cut(name: str, limit: int | None) -> Column:
        return F.col(name) if limit is None else F.substring(name, 1, limit)

    def ranked(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
        if limit is None:
            return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        return top_per_key(df, keys, order, limit, "rank")

    chosen = files if max_files is None else top_per_key(files, ["run_id"], [F.asc("seq"), F.asc("path")], max_files)
    few = ranked(findings.join(chosen.select(*keys), keys, "left_semi"), [F.asc("seq")], max_findings)
    finding_line = F.concat(F.lit("- ["), "rule_id", F.lit("] L"), F.col("start_line").cast("string"), F.lit(": "), cut("message", message_chars))
    names = ranked(symbols.join(chosen.select(*keys), keys, "left_semi"), [F.asc("start_line"), F.asc("name")], max_symbols)
    symbol_line = F.concat(F.lit("- `"), "kind", F.lit("` `"), "name", F.lit("` @ L"), F.col("start_line").cast("string"))

    def listed(df: DataFrame, line: Column, name: str) -> DataFrame:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
        return df.groupBy(*keys).agg(F.array_join(ordered, "\n").alias(name))

    out = chosen.select(*keys).join(listed(few, finding_line, "findings"), keys, "left")
    out = out.join(listed(names, symbol_line, "symbols"), keys, "left")
    return out.join(patches.select(*keys, cut("patch", chars).alias("patch")), keys, "left")


def stage_metrics(analyzers: DataFrame, trace: DataFrame, results: DataFrame) -> DataFrame:
    """Stages of each run in plan order, then aggregator and report, then the model review steps.

    analyzers: run_id, pos, stage. trace: run_id, seq, step, status, duration_ms (the last entry of a step counts).
    results: run_id, stage, finding_count, evidence_count.
    """
    last = trace.groupBy("run_id", "step").agg(
        F.max_by(F.struct("status", "duration_ms"), "seq").alias("t"), F.min("seq").alias("first_seq")
    )
    last = last.select("run_id", F.col("step").alias("stage"), "t.status", F.coalesce("t.duration_ms", F.lit(0.0)).alias("duration_ms"), "first_seq")
    planned = analyzers.join(last, ["run_id", "stage"]).select(
        "run_id", "stage", "status", "duration_ms", F.lit(0).alias("part"), F.col("pos").cast("bigint").alias("ord")
    )
    closing = last.where(F.col("stage").isin("aggregator", "report")).select(
        "run_id", "stage", "status", "duration_ms", F.lit(1).alias("part"),
        F.when(F.col("stage") == "aggregator", 0).otherwise(1).cast("bigint").alias("ord"),
    )
    review = last.where(F.col("stage").startswith("llm_review")).select(
        "run_id", "stage", "status", "duration_ms", F.lit(2).alias("part"), F.col("first_seq").cast("bigint").alias("ord")
    )
    stages = planned.unionByName(closing).unionByName(review)
    counted = stages.join(results, ["run_id", "stage"], "left")

    def count(name: str) -> Column:
        return F.when(F.col("part") == 0, F.coalesce(name, F.lit(0))).otherwise(0).cast("bigint").alias(name)

    return counted.select(
        "run_id", "stage", "status", "duration_ms", "part", "ord", count("finding_count"), count("evidence_count")
    )


def judge_inputs(samples: DataFrame, outputs: DataFrame, max_chars: int | None = None) -> DataFrame:
    """One prompt payload per sample with an output; an output without a diff gives an error row.

    The diff is whole unless the caller sets ``max_chars``, which marks the cut.
    """
    joined = samples.join(outputs, "sample_id")
    shown = F.col("diff")
    if max_chars is not None:
        shown = F.when(F.length("diff") > max_chars, F.concat(F.substring("diff", 1, max_chars), F.lit("\n... (diff truncated)"))).otherwise(shown)
    bare = F.coalesce("diff", F.lit("")) == ""
    return joined.select(
        "sample_id",
        F.when(~bare, F.to_json(F.struct("question", "expected_answer_summary", "answer"))).alias("payload"),
        F.when(~bare, shown).alias("diff"),
        F.when(bare, "pipeline result has no unified diff").alias("error"),
    )


def format_issues(issues: DataFrame) -> DataFrame:
    """Issue text blocks for a judge, one row per issue: sample_id, issue_index, block."""
    def part(label: str, name: str) -> Column:
        return F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit(f"\n  {label}: "), F.col(name))).otherwise("")

    block = F.concat(
        F.lit("--- Issue #"), F.col("issue_index").cast("string"), F.lit(" ---\n  严重度: "), "severity",
        F.lit(" | 文件: "), "file", F.lit(":"), F.col("line").cast("string"), F.lit(" | 来源: "), F.array_join("sources", ", "),
        F.lit("\n  标题: "), "title", part("原因", "reason"), part("修复建议", "fix"),
    )
    return issues.select("sample_id", "issue_index", block.alias("block"))


def ground_verdicts(judgments: DataFrame, grounding: DataFrame) -> DataFrame:
    """A correct verdict whose citations do not all hold becomes partially correct, with a score of at most 1."""
    joined = judgments.join(grounding, "sample_id", "left")
    lower = (F.col("verdict") == "correct") & ~F.coalesce("grounded", F.lit(False)) & ~F.coalesce("no_refs", F.lit(True))
    return joined.select(
        "sample_id",
        F.when(lower, "partially_correct").otherwise(F.col("verdict")).alias("verdict"),
        F.when(lower, F.least("score", F.lit(1))).otherwise(F.col("score")).alias("score"),
        lower.alias("downgraded"),
    )
