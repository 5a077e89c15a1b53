"""Evaluation data: parameter grids, change sets, truths, questions and samples.

Counts per stratum, the value pools and the rules are fixed; which combinations are drawn follows a hash order, so the
same input always gives the same samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from revgrain.functions import review, text
from revgrain.functions.patterns import strings
from revgrain.operators.ranking import top_per_key

# Pools and stratum sizes.
CHANGE_TYPES = ["bug_fix", "feature", "refactor", "security_patch", "config_change", "dependency_upgrade"]
FILE_COUNTS = [1, 3, 8, 25, 65]
LINE_COUNTS = [5, 30, 150, 500, 2000]
SIGNALS = ["auth_change", "sql_risk", "command_injection", "deserialization", "dependency_change"]
NON_CODE = [".md", ".json", ".yml", ".toml", ".txt", ".cfg", ".ini"]
STRATA = {
    "python_low": 50, "python_one": 100, "python_two": 80, "python_many": 40, "javascript": 70, "typescript": 50,
    "java": 30, "go": 30, "non_code": 40, "mixed": 30, "edge": 30,
}
LANGUAGE_OF = {"javascript": ("JavaScript", ".js"), "typescript": ("TypeScript", ".ts"), "java": ("Java", ".java"), "go": ("Go", ".go")}
LANGUAGE_SIGNALS = {
    "javascript": [[], ["command_injection"], ["auth_change"], ["sql_risk"], ["command_injection", "auth_change"]],
    "typescript": [[], ["auth_change"], ["deserialization"], ["command_injection"], ["auth_change", "deserialization"]],
    "java": [[], ["deserialization"], ["command_injection"], ["deserialization", "command_injection"]],
    "go": [[], ["command_injection"], ["sql_risk"], ["command_injection", "sql_risk"]],
}
QUESTION_TEMPLATES = {
    "locate": ['Where is "{symbol}" defined?', "Which file contains the definition of {symbol}?", '"{symbol}" 在哪个文件里定义的？', "帮我找一下 {symbol} 的位置"],
    "explain": ['What does "{symbol}" do?', "What is the purpose of {symbol}?", '"{symbol}" 是做什么用的？', "{symbol} 的主要功能是什么？"],
    "trace": ["What calls {symbol}?", "Who invokes {symbol}?", "哪些地方调用了 {symbol}？", "帮我追踪 {symbol} 的调用链"],
    "grep": ['Find all occurrences of "{symbol}"', "List all files that use {symbol}", "列出所有用到 {symbol} 的地方", "搜索所有包含 {symbol} 的代码"],
}
QUESTION_QUOTA = {"locate": 40, "explain": 40, "trace": 35, "grep": 35}


def subsets(pool: list[str], df: DataFrame, key: str) -> DataFrame:
    """Each row with the subset of ``pool`` whose bits its ``key`` gives: all 2^n subsets as the key runs on."""
    chosen = F.array_compact(F.array(*[
        F.when(F.expr(f"(pmod({key}, {1 << len(pool)}) div {1 << i}) % 2") == 1, F.lit(s)) for i, s in enumerate(pool)]))
    return df.withColumn("risk_signals", chosen)


def risk_combos(spark: SparkSession) -> DataFrame:
    """All subsets of the five signals, by number."""
    return subsets(SIGNALS, spark.range(1 << len(SIGNALS)).withColumnRenamed("id", "combo"), "combo")


def _pick(values: list, salt: str, seed: Column) -> Column:
    """Value chosen by a hash of the seed."""
    options = F.array(*[F.lit(v) if not isinstance(v, list) else strings(v) for v in values])
    return F.get(options, F.pmod(F.xxhash64(seed, F.lit(salt)), F.lit(len(values))).cast("int"))


def coverage_matrix(seeds: DataFrame, count: int = 550) -> DataFrame:
    """Sample parameters over eleven strata, the first of each stratum's quota in hash order, then topped up to count.

    seeds: one ``seed`` (bigint) per candidate. Candidates are assigned to strata by hash in proportion to the quotas.
    """
    names = list(STRATA)
    total = sum(STRATA.values())
    h = F.xxhash64(F.col("seed"), F.lit("stratum"))
    slot = F.pmod(h, F.lit(total))
    upto = 0
    stratum: Column | None = None
    for n in names:
        upto += STRATA[n]
        stratum = F.when(slot < upto, n) if stratum is None else stratum.when(slot < upto, n)
    s = F.col("seed")
    rows = seeds.select("seed", stratum.alias("stratum"), F.xxhash64(s, F.lit("order")).alias("h"))
    combo = F.pmod(F.xxhash64(s, F.lit("combo")), F.lit(32))
    bits = strings(SIGNALS)
    ordered = F.transform(bits, lambda x: F.struct(F.xxhash64(s, x).alias("o"), x.alias("v")))
    shuffled = F.transform(F.array_sort(ordered), lambda x: x["v"])
    many = F.array_sort(F.slice(shuffled, F.lit(1), 3 + F.pmod(combo, F.lit(3)).cast("int")))
    signals = (
        F.when(F.col("stratum") == "python_one", F.slice(shuffled, 1, 1))
        .when(F.col("stratum") == "python_two", F.array_sort(F.slice(shuffled, 1, 2)))
        .when(F.col("stratum") == "python_many", many)
        .when((F.col("stratum") == "mixed") & (F.pmod(combo, F.lit(2)) == 0), F.slice(shuffled, 1, 1))
    )
    for n, options in LANGUAGE_SIGNALS.items():
        signals = signals.when(F.col("stratum") == n, _pick(options, n, s))
    other = _pick(NON_CODE, "ext", s)
    python = F.col("stratum").startswith("python") | (F.col("stratum") == "edge")
    language, exts = F.when(python, "Python"), F.when(python, strings([".py"]))
    for n, (lang, ext) in LANGUAGE_OF.items():
        language, exts = language.when(F.col("stratum") == n, lang), exts.when(F.col("stratum") == n, strings([ext]))
    language = language.when(F.col("stratum") == "mixed", "Mixed").otherwise("Config")
    exts = exts.when(F.col("stratum") == "mixed", F.array(F.lit(".py"), other)).otherwise(F.array(other))
    has_py = python | (F.col("stratum") == "mixed")
    rows = rows.withColumn("risk_signals", signals.otherwise(strings([]))).withColumn("language", language).withColumn("file_exts", exts)
    rows = rows.withColumn("risk_signals", F.when(
        (F.col("stratum") == "non_code") & F.arrays_overlap("file_exts", strings([".toml", ".cfg", ".ini"])), strings(["dependency_change"])
    ).otherwise(F.col("risk_signals")))
    empty = (F.col("stratum") == "edge") & (F.pmod(combo, F.lit(3)) == 0)
    rows = rows.select(
        "seed", "h", "stratum", "language", F.when(empty, strings([])).otherwise(F.col("file_exts")).alias("file_exts"), "risk_signals",
        F.when(empty | ~has_py, 0).otherwise(_pick(FILE_COUNTS, "files", s)).alias("python_file_count"),
        F.when(empty, 0).when(F.col("stratum") == "edge", 10000).otherwise(_pick(LINE_COUNTS, "lines", s)).alias("total_lines"),
        _pick(CHANGE_TYPES, "change", s).alias("change_type"),
        (F.array_contains("risk_signals", "dependency_change") | F.arrays_overlap("file_exts", strings([".toml", ".cfg", ".ini"]))).alias("has_dep_files"),
        _pick([0, 2, 8, 20], "findings", s).alias("static_findings_count"),
    )
    ranked = top_per_key(rows, ["stratum"], [F.asc("h"), F.asc("seed")], count, "rank")
    quota = F.lit(0)
    for n in names:
        quota = F.when(F.col("stratum") == n, STRATA[n]).otherwise(quota)
    return ranked.withColumn("_late", F.col("rank") > quota).orderBy("_late", "h", "seed").limit(count).drop("_late", "rank", "h")


def review_ids(params: DataFrame) -> DataFrame:
    """Adds the stable ``sample_id`` of a parameter row; a seed keeps equal parameters apart."""
    canonical = F.to_json(F.struct("change_type", "file_exts", "has_dep_files", "language", "python_file_count", "risk_signals", "seed", "static_findings_count", "total_lines"))
    return params.withColumn("sample_id", text.sample_id(F.col("python_file_count"), F.col("total_lines"), F.col("language"), canonical))


def fake_changesets(params: DataFrame) -> DataFrame:
    """Changed files of a parameter row, with names that show its risk.

    params: sample_id, file_exts, python_file_count, total_lines, has_dep_files, risk_signals.
    """
    n = F.col("python_file_count")
    added = F.greatest(F.lit(1), F.floor(F.col("total_lines") / F.greatest(F.lit(1), "python_file_count"))).cast("int")
    py = params.where("python_file_count > 0").select("sample_id", "risk_signals", added.alias("added"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    first = F.when(F.array_contains("risk_signals", "auth_change"), "auth.py").when(
        F.array_contains("risk_signals", "dependency_change"), "pyproject.toml"
    ).otherwise("main.py")
    name = F.when(F.col("i") == 0, first).otherwise(F.concat(F.lit("changed_"), F.col("i").cast("string"), F.lit(".py")))
    py = py.select("sample_id", name.alias("path"), "added", F.floor(F.col("added") / 3).cast("int").alias("deleted"))
    share = F.greatest(F.lit(1), F.floor(F.col("total_lines") / F.greatest(F.lit(1), F.size("file_exts")))).cast("int")
    other = params.select("sample_id", share.alias("added"), F.explode(F.filter("file_exts", lambda e: e != ".py")).alias("ext"))
    other = other.select("sample_id", F.when(F.col("ext") == ".md", "README.md").otherwise(F.concat(F.lit("config"), "ext")).alias("path"), "added", F.lit(0).alias("deleted"))
    named = (F.col("python_file_count") > 0) & F.array_contains("risk_signals", "dependency_change") & ~F.array_contains("risk_signals", "auth_change")
    deps = params.where(F.col("has_dep_files") & ~named).select("sample_id", F.lit("requirements.txt").alias("path"), F.lit(5).alias("added"), F.lit(2).alias("deleted"))
    return py.unionByName(other).unionByName(deps).withColumn("change_type", F.lit("modified"))


def ground_truth(params: DataFrame) -> DataFrame:
    """Analyzers, reason codes and risk level that follow from the declared signals (lint comes before the parser here)."""
    n, risky = F.col("python_file_count"), F.size("risk_signals") > 0
    py = F.array_contains("file_exts", ".py") | (n > 0)
    declared = F.array_contains("risk_signals", "dependency_change")
    deps = F.when(py, F.col("has_dep_files") | declared).otherwise(F.col("has_dep_files"))
    analyzers = F.array_compact(F.array(
        F.lit("git"), F.when(py, F.lit("ruff")), F.when(py & n.between(1, 50), F.lit("python_ast")),
        F.when(py & (risky | (F.col("total_lines") > 100)), F.lit("bandit")), F.when(deps, F.lit("dependency")),
    ))
    none = strings([])
    reasons = F.concat(
        F.when(py & (n > 50), strings(["python_ast_skipped_large_diff"])).otherwise(none),
        F.when(py & risky, F.array_sort("risk_signals")).otherwise(none),
        F.when(py & ~risky & (F.col("total_lines") <= 100), strings(["bandit_skipped_low_risk"])).otherwise(none),
        F.when(~py & (F.size("file_exts") > 0), strings(["no_python_changes"])).otherwise(none),
        F.when(deps & ~(py & declared), strings(["dependency_change"])).otherwise(none),
    )
    return params.select("sample_id", analyzers.alias("analyzers"), reasons.alias("reason_codes"), review.risk_level(F.size("risk_signals")).alias("risk_level"))


def question_samples(symbols: DataFrame, quotas: dict[str, int] = QUESTION_QUOTA) -> DataFrame:
    """Questions about symbols by type, the first of each quota in hash order. symbols: symbol."""
    options = [
        F.struct(F.lit(q).alias("question_type"), F.replace(_pick(t, q, F.col("symbol")), F.lit("{symbol}"), F.col("symbol")).alias("question"))
        for q, t in QUESTION_TEMPLATES.items()
    ]
    rows = symbols.select("symbol").distinct().select("symbol", F.inline(F.array(*options)))
    rows = rows.withColumn("h", F.xxhash64("symbol", "question_type"))
    few = top_per_key(rows, ["question_type"], [F.asc("h"), F.asc("symbol")], max(quotas.values()), "rank")
    quota = F.lit(0)
    for q, n in quotas.items():
        quota = F.when(F.col("question_type") == q, n).otherwise(quota)
    few = few.where(F.col("rank") <= quota)
    return few.select(
        F.format_string("a%s_%04d", "question_type", "rank").alias("id"), "question", "question_type", F.array("symbol").alias("expected_keywords")
    )


def assemble_samples(params: DataFrame, texts: DataFrame, truth: DataFrame) -> DataFrame:
    """Parameters, texts and truths as nested samples; a sample without a text has blank ones."""
    joined = params.join(texts, "sample_id", "left").join(truth, "sample_id")
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("change_summary", "ast_summary")]
    size = F.struct(
        (F.col("python_file_count") + F.size("file_exts")).alias("files"), F.col("total_lines").alias("added_lines"),
        F.floor(F.col("total_lines") / 3).cast("int").alias("deleted_lines"),
    )
    return joined.select(
        F.col("sample_id").alias("id"), F.lit("review").alias("mode"), F.coalesce("change_summary", F.lit("")).alias("scenario"),
        F.struct("language", "change_type").alias("_meta"),
        F.struct(blank[0], F.col("file_exts").alias("file_types"), size.alias("diff_size"), "risk_signals", blank[1], "static_findings_count").alias("input"),
        F.struct("analyzers", "risk_level", "reason_codes").alias("ground_truth"),
    )


def baseline_changes(samples: DataFrame) -> DataFrame:
    """One synthetic changed file per file type of a sample, for the rule planner. samples: run_id, file_types, added, deleted."""
    ext = F.regexp_replace("file_type", r"^\.+", "")
    rows = samples.select("run_id", "added", "deleted", F.explode("file_types").alias("file_type"))
    return rows.select(
        "run_id", F.when(ext != "", F.concat(F.lit("changed."), ext)).otherwise("changed.py").alias("path"), F.lit("modified").alias("change_type"), "added", "deleted"
    )


def mock_answers(samples: DataFrame) -> DataFrame:
    """Stub answers: the expected summary and a reference to line 10 of each expected file."""
    files = F.coalesce("expected_evidence_files", strings([]))
    refs = F.array_join(F.transform(files, lambda f: F.concat(f, F.lit(":10"))), ", ")
    summary = F.coalesce("expected_answer_summary", F.lit("mock answer"))
    return samples.select("sample_id", F.when(F.size(files) > 0, F.concat(summary, F.lit("\n\n参考位置: "), refs)).otherwise(summary).alias("answer"))
