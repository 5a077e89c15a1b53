"""Surface for the caller's own functions: per-file tools, model calls, knowledge retrievers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from revgrain.functions import judging
from revgrain.session import cut_lineage

TOOL_SCHEMA = (
    "path string, tool string, status string, "
    "findings array<struct<rule_id:string,message:string,severity:string,start_line:int>>, "
    "evidence array<struct<start_line:int,snippet:string,confidence:double>>, diagnostics array<struct<code:string,message:string>>"
)


def run_tool(files: DataFrame, name: str, tool: Callable[[str, str], dict]) -> DataFrame:
    """Run ``tool(path, text)`` on every file; it returns findings, evidence and diagnostics as lists of dicts.

    A tool that raises gives one failed row for that file and never stops the job.
    """
    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"]):
                try:
                    got = tool(path, text)
                    rows.append((path, name, got.get("status", "success"), got.get("findings", []), got.get("evidence", []), got.get("diagnostics", [])))
                except Exception as exc:  # noqa: BLE001 - isolation is the contract
                    rows.append((path, name, "failed", [], [], [{"code": f"{name.upper()}_ERROR", "message": str(exc)}]))
            yield pd.DataFrame(rows, columns=["path", "tool", "status", "findings", "evidence", "diagnostics"])

    return files.select("path", "text").mapInPandas(run, TOOL_SCHEMA)


def tool_findings(results: DataFrame) -> DataFrame:
    return results.select("path", "tool", F.inline("findings"))


def tool_diagnostics(results: DataFrame) -> DataFrame:
    return results.select("path", "tool", "status", F.inline("diagnostics"))


def call_model(
    prompts: DataFrame, key: str, model: Callable[[list[str]], list[str | None]], batch: int = 1, retries: int = 1
) -> DataFrame:
    """``model`` on slices of ``batch`` prompts inside the partitions: (key, raw, attempts, error).

    Prompts a call leaves unanswered, because it raises or gives no or too few answers, are asked again; after the last
    attempt their rows carry the error. Every prompt gives one row.
    """
    kind = prompts.schema[key].dataType.simpleString()

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            keys, asked = list(pdf[key]), list(pdf["prompt"])
            for start in range(0, len(pdf), batch):
                part = asked[start:start + batch]
                raw, tries, error = [None] * len(part), [0] * len(part), "empty response"
                for _ in range(retries + 1):
                    todo = [k for k, r in enumerate(raw) if not r]
                    if not todo:
                        break
                    for k in todo:
                        tries[k] += 1
                    try:
                        answers = list(model([part[k] for k in todo]))
                        for k, answer in zip(todo, answers):
                            raw[k] = answer
                    except Exception as exc:  # noqa: BLE001 - a failed call becomes a row
                        error = str(exc) or type(exc).__name__
                rows += [(k, r, n, error if not r else None) for k, r, n in zip(keys[start:start + batch], raw, tries)]
            yield pd.DataFrame(rows, columns=[key, "raw", "attempts", "error"])

    return prompts.select(key, "prompt").mapInPandas(run, f"{key} {kind}, raw string, attempts int, error string")


def judge_with_repair(
    prompts: DataFrame, key: str, model: Callable[[list[str]], list[str | None]], repair: Callable[[Column, Column], Column]
) -> DataFrame:
    """Judge every prompt; answers that do not parse or do not fit the schema are asked for once more.

    ``repair(raw, errors)`` builds the second prompt. Answers are written to the checkpoint folder before they are used
    twice, so no prompt is sent again when a stage is repeated.
    """
    def checked(calls: DataFrame) -> DataFrame:
        parsed = calls.withColumn("json", judging.recover_json("raw"))
        return parsed.withColumn("errors", F.when(F.col("json").isNotNull(), judging.schema_errors("json")))

    first = cut_lineage(checked(call_model(prompts, key, model, retries=0)))
    bad = F.col("json").isNull() | (F.size("errors") > 0)
    again = first.where(bad & F.col("error").isNull()).select(key, repair(F.coalesce("raw", F.lit("(empty)")), F.coalesce("errors", F.array().cast("array<string>"))).alias("prompt"))
    second = cut_lineage(checked(call_model(again, key, model, retries=0)))
    second = second.select(key, *[F.col(c).alias(f"{c}_2") for c in ("raw", "json", "errors", "error")], F.lit(True).alias("retried"))
    both = first.join(second, key, "left")
    retried = F.coalesce("retried", F.lit(False))
    json = F.when(retried, F.col("json_2")).otherwise(F.col("json"))
    errors = F.when(retried, F.col("errors_2")).otherwise(F.col("errors"))
    kind = F.when(json.isNull(), "judge_unavailable").when(F.size(errors) > 0, "judge_invalid_schema")
    fields = F.from_json(json, "verdict string, score int, answered_question boolean, uses_supported_evidence boolean, expected_file_coverage string, reason string, missing_points array<string>")
    return both.select(
        key, kind.alias("judge_error_type"), F.coalesce(errors, F.array().cast("array<string>")).alias("schema_errors"), retried.alias("retried"),
        F.coalesce(fields["verdict"], F.lit("unjudgeable")).alias("verdict"), F.coalesce(fields["score"], F.lit(0)).alias("score"),
        F.coalesce(fields["uses_supported_evidence"], F.lit(False)).alias("uses_supported_evidence"), F.coalesce(fields["reason"], F.lit("")).alias("reason"),
    )


# A knowledge retriever is any function from queries (query_id, text) to ranked rows (query_id, rank, source, content).
KnowledgeRetriever = Callable[[DataFrame], DataFrame]
