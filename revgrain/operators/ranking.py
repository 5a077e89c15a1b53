"""Top-k, ordered selection and window operators.

``row_number() <= k`` lets Spark prune to k rows per key inside each map task before it shuffles, so a key that
holds most of the rows still sends only k rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from revgrain import fixed
from revgrain.functions import paths, search
from revgrain.functions.patterns import any_of, literal, lookup, python_strip, strings


#: Lines of a bin that windows and lines meet by.
WINDOW_BIN = 64


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def search_hits(lines: DataFrame, queries: dict[str, list[str]], line_kinds: DataFrame | None = None) -> DataFrame:
    """Scored hits of all queries in one pass over (path, line_no, line).

    The words are constants of one generated expression, so no join with a query table takes place. ``line_kinds``
    (path, line_no, kind), where given, overrides the textual hit type.
    """
    queries = {q: search.distinct_keywords(words) for q, words in queries.items()}
    if line_kinds is not None:
        lines = lines.join(line_kinds.select("path", "line_no", "kind"), ["path", "line_no"], "left")
    parsed = F.col("kind") if line_kinds is not None else None
    every_word = list(dict.fromkeys(w for words in queries.values() for w in words))
    hits = lines.where(search.mentions("line", every_word)).withColumn("snippet", search.snippet("line"))
    hits = hits.where(F.col("snippet") != "").withColumn("file_type", paths.classify_file("path"))

    def scored(name: str, words: list[str]) -> Column:
        kind = search.classify_hit(F.col("snippet"), words, parsed)
        part = F.struct(
            F.lit(name).alias("query_id"),
            kind.alias("hit_type"),
            (search.match_precision("snippet", words) + search.query_coverage("snippet", words)).alias("word_score"),
            F.array_join(search.matched_terms("snippet", words), ",").alias("matched_terms"),
        )
        return F.when(search.mentions("line", words), part)

    hits = hits.select(
        "path", "line_no", "snippet", "file_type",
        F.explode(F.array_compact(F.array(*[scored(q, w) for q, w in queries.items()]))).alias("hit"),
    ).select("path", "line_no", "snippet", "file_type", "hit.*")
    score = paths.file_type_score("file_type") + search.hit_type_score("hit_type") + F.col("word_score")
    return hits.withColumn("score", score).drop("word_score")


def best_hits(hits: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Best line per (query, file): a combining minimum, so a noisy file shrinks to one row before the shuffle."""
    best = F.min(F.struct((-F.col("score")).alias("neg"), "line_no", "snippet", "file_type", "hit_type", "matched_terms"))
    rows = hits.groupBy("query_id", *keys).agg(best.alias("best"))
    return rows.select("query_id", *keys, (-F.col("best.neg")).alias("score"), "best.*").drop("neg")


def rank_hits(best: DataFrame, k: int, keys: Sequence[str] = ("path",)) -> DataFrame:
    """The k best of each query; ``keys`` before the path, such as a repository, have ranks of their own."""
    order = [F.desc("score"), F.asc("path"), F.asc("line_no"), F.asc("snippet")]
    within = ["query_id", *[c for c in keys if c != "path"]]
    return top_per_key(best, within, order, k, "rank").withColumn("confidence", search.hit_confidence("hit_type"))


def search_topk(
    lines: DataFrame, queries: dict[str, list[str]], k: int = 50, line_kinds: DataFrame | None = None
) -> DataFrame:
    """The k best files of each query, each with its best line."""
    return rank_hits(best_hits(search_hits(lines, queries, line_kinds)), k)


def filename_search(files: DataFrame, queries: dict[str, str], k: int = 50) -> DataFrame:
    """Files whose path holds a query's word, best file type first, a hit in the base name weighing more."""
    low_name = F.lower(paths.base_name("path"))
    kind = paths.classify_file("path")
    base = paths.file_type_score(kind)
    options = [
        F.when(F.col("path").contains(word), F.struct(
            F.lit(q).alias("query_id"), (base + F.when(low_name.contains(word.lower()), 200).otherwise(0)).alias("score")))
        for q, word in queries.items()
    ]
    hits = files.select("path", kind.alias("file_type"), F.inline(F.array_compact(F.array(*options))))
    return top_per_key(hits, ["query_id"], [F.desc("score"), F.asc("path")], k, "rank")


def reference_search(
    lines: DataFrame, terms: dict[str, tuple[str, str]], max_files: int = 20, per_file: int = 3, total: int = 50
) -> DataFrame:
    """References of each term: production paths first, then path and line, within three limits.

    ``terms`` maps a query id to (term, kind). The last file that the file limit admits gives one hit only. Literal and
    plain reference searches also look at documentation, examples and tests; calls and decorators do not.
    """
    from revgrain.operators.filters import reference_match

    excluded = paths.in_dirs(F.lower("path"), fixed.NON_PRODUCTION_DIRS)
    options = []
    for q, (term, kind) in terms.items():
        test = reference_match(F.col("line"), term, kind)
        if kind not in ("literal", "references"):
            test = test & ~excluded
        options.append(F.when(test, F.lit(q)))
    hits = lines.where(F.col("path").endswith(".py") & ~paths.hidden("path")).select(
        "path", "line_no", "line", excluded.cast("int").alias("priority"), F.explode(F.array_compact(F.array(*options))).alias("query_id")
    )
    hits = hits.withColumn("snippet", python_strip("line")).drop("line")
    kept = top_per_key(hits, ["query_id", "path"], [F.asc("line_no")], per_file, "in_file")
    files = top_per_key(
        kept.where("in_file = 1").select("query_id", "priority", "path"), ["query_id"], [F.asc("priority"), F.asc("path")], max_files, "file_rank"
    )
    kept = kept.join(files.select("query_id", "path", "file_rank"), ["query_id", "path"])
    kept = kept.where((F.col("file_rank") < max_files) | (F.col("in_file") == 1))
    return top_per_key(kept, ["query_id"], [F.asc("file_rank"), F.asc("line_no")], total, "rank").select(
        "query_id", "rank", "path", "line_no", "snippet"
    )


def select_evidence(evidence: DataFrame, max_items: int = 20, per_file: int = 3) -> DataFrame:
    """Most confident evidence of each query; at most ``per_file`` of a file unless room is left at the end."""
    order = [F.desc("confidence"), F.asc("seq")]
    few = top_per_key(evidence, ["query_id", "file"], order, max_items, "_in_file")
    few = few.withColumn("_overflow", F.col("_in_file") > per_file)
    return top_per_key(few, ["query_id"], [F.asc("_overflow"), *order], max_items, "rank").drop("_in_file", "_overflow")


def truncate_evidence(evidence: DataFrame, max_items: int = 18, diversity: int = 5) -> DataFrame:
    """The evidence a judge sees of each sample.

    evidence: sample_id, ev_id, seq, confidence, is_cited, is_expected. Small samples stay whole. Otherwise cited
    evidence comes first, then expected files within a limit, then confident and other evidence; where fewer than
    ``diversity`` rows come from other files, expected rows give way to rows of the last class. Class sizes are counted
    by aggregation, and only the first ``max_items`` of each class are ever ranked.
    """
    klass = F.when(F.col("is_cited"), 0).when(F.col("is_expected"), 1).when(F.col("confidence") >= 0.9, 2).otherwise(3)
    rows = evidence.withColumn("klass", klass)

    def size(k: int) -> Column:
        return F.count_if(F.col("klass") == k)

    sizes = rows.groupBy("sample_id").agg(
        F.count("*").alias("n"), size(0).alias("c"), size(1).alias("e"), size(2).alias("h"), size(3).alias("o"),
        F.count_if((F.col("klass") == 0) & F.col("is_expected")).alias("ce"),
    )
    m, zero = F.lit(max_items), F.lit(0)
    limit = F.greatest(zero, m - F.col("c") - diversity)
    sizes = sizes.withColumn("e1", F.least("e", limit)).withColumn("room", m - F.col("c") - F.col("e1"))
    sizes = sizes.withColumn(
        "h1", F.when(F.col("room") >= 0, F.least("h", "room")).otherwise(F.greatest(zero, F.col("h") + F.col("room")))
    ).withColumn("o1", F.least("o", F.greatest(zero, F.col("room") - F.col("h1"))))
    sizes = sizes.withColumn("other_files", F.col("c") - F.col("ce") + F.col("h1") + F.col("o1"))
    swap = (F.col("other_files") < diversity) & (F.col("o") > 0)
    left = F.greatest(zero, F.col("ce") + F.col("e1") - (diversity - F.col("other_files")))
    sizes = sizes.withColumn("swap", swap).withColumn("left", left)
    sizes = sizes.withColumn("keep", F.col("left") - F.least(F.lit(diversity), F.col("left")))

    cut = top_per_key(rows, ["sample_id", "klass", "is_expected"], [F.asc("seq")], max_items, "sub_rank")
    cut = cut.withColumn("rank", F.row_number().over(Window.partitionBy("sample_id", "klass").orderBy("seq")))
    out = cut.join(sizes, "sample_id")
    k = F.col("klass")
    place = (
        F.when(k == 0, F.col("rank"))
        .when((k == 1) & (F.col("rank") <= F.col("e1")), F.col("c") + F.col("rank"))
        .when((k == 2) & (F.col("rank") <= F.col("h1")), F.col("c") + F.col("e1") + F.col("rank"))
        .when((k == 3) & (F.col("rank") <= F.col("o1")), F.col("c") + F.col("e1") + F.col("h1") + F.col("rank"))
    )
    expected_place = F.when((k == 0) & F.col("is_expected"), F.col("sub_rank")).when(
        (k == 1) & (F.col("rank") <= F.col("e1")), F.col("ce") + F.col("rank")
    )
    swapped = F.when(expected_place <= F.col("keep"), expected_place).when(
        (k == 3) & (F.col("left") > 0) & (F.col("rank") <= m - F.col("keep")), F.col("keep") + F.col("rank")
    )
    big = out.where(F.col("n") > max_items).withColumn("place", F.when(F.col("swap"), swapped).otherwise(place))
    small = out.where(F.col("n") <= max_items).withColumn("place", F.row_number().over(Window.partitionBy("sample_id").orderBy("seq")))
    columns = [*evidence.columns, "place"]
    return big.where(F.col("place") <= max_items).select(*columns).unionByName(small.select(*columns))


def knowledge_topk(queries: DataFrame, rules: list[dict], k: int = 5) -> DataFrame:
    """Rules with the most tags in the query text. The rule list is a parameter, so it is scored inside each row."""
    low = F.lower(F.coalesce("text", F.lit("")))
    scored = F.array(*[
        F.struct(
            (-sum((F.when(low.contains(t), 1).otherwise(0) for t in r["tags"]), F.lit(0))).alias("neg"), F.lit(i).alias("rule"),
            F.lit(r["source"]).alias("source"), F.lit(r["content"]).alias("content"))
        for i, r in enumerate(rules)
    ])
    best = F.slice(F.array_sort(F.filter(scored, lambda s: s["neg"] < 0)), 1, k)
    return queries.select("query_id", F.posexplode(best).alias("rank", "r")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), "r.rule", "r.source", "r.content", (-F.col("r.neg")).alias("score")
    )


def no_knowledge(queries: DataFrame) -> DataFrame:
    """Retriever that never finds anything, for runs without a knowledge base."""
    return knowledge_topk(queries, [{"content": "", "source": "", "tags": []}]).limit(0)


VECTOR_BLOCK = 1024


def vector_topk(items: DataFrame, queries: list[tuple[str, list[float]]], n: int = 5) -> DataFrame:
    """Exact nearest items by cosine per (query, collection). items: collection, item_id, embedding.

    Queries come from the caller. They are taken in blocks of bounded size; a block travels with the task, each Arrow
    batch is scored in one matrix product and reduced to its own n best, so only survivors reach the shuffle.
    """
    import numpy as np
    import pandas as pd

    def scorer(block: list[tuple[str, list[float]]]):
        ids = [q for q, _ in block]
        matrix = np.asarray([v for _, v in block], dtype="float64")
        matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

        def run(batches):
            for pdf in batches:
                if pdf.empty:
                    continue
                vectors = np.asarray(pdf["embedding"].tolist(), dtype="float64")
                norms = np.maximum(np.linalg.norm(vectors, axis=1), 1e-300)
                scores = (matrix @ vectors.T) / norms
                out = []
                for _, where in pdf.groupby("collection", sort=False).indices.items():
                    part = scores[:, where]
                    take = min(n, len(where))
                    # ties at the cut go to the smaller id, as in the final ranking
                    order = np.lexsort((np.broadcast_to(pdf["item_id"].to_numpy()[where], part.shape), -part), axis=1)[:, :take]
                    for row, q in enumerate(ids):
                        chosen = where[order[row]]
                        out.append(pd.DataFrame({
                            "query_id": q, "collection": pdf["collection"].to_numpy()[chosen],
                            "item_id": pdf["item_id"].to_numpy()[chosen], "similarity": scores[row, chosen]}))
                yield pd.concat(out, ignore_index=True)

        return run

    fields = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    schema = f"query_id string, collection {fields['collection']}, item_id {fields['item_id']}, similarity double"
    source = items.select("collection", "item_id", "embedding")
    found = None
    for start in range(0, len(queries), VECTOR_BLOCK):
        part = source.mapInPandas(scorer(queries[start:start + VECTOR_BLOCK]), schema)
        found = part if found is None else found.unionByName(part)
    return top_per_key(found, ["query_id", "collection"], [F.desc("similarity"), F.asc("item_id")], n, "rank")


def map_select(records: DataFrame, questions: dict[str, str], k: int = 6, fallback: int = 3) -> DataFrame:
    """Files of the code map that fit each structural question best; the first few where none fits.

    records: path, symbols (array of names).
    """
    import re

    low = F.lower(F.concat_ws(" ", F.col("path"), F.array_join("symbols", " ")))
    path = F.lower("path")
    options = []
    for q, question in questions.items():
        ql = question.lower()
        terms = sorted(set(re.findall(r"[A-Za-z_][A-Za-z0-9_]{2,}|[一-鿿]{2,}", ql)))
        score = sum((F.when(low.contains(t), 1).otherwise(0) for t in terms), F.lit(0))
        if "pipeline" in ql:
            score = score + F.when(path.contains("pipeline"), 4).otherwise(0)
        if "前端" in question:
            score = score + F.when(F.col("path").contains("api/") | F.col("path").contains("web"), 3).otherwise(0)
        options.append(F.struct(F.lit(q).alias("query_id"), score.alias("score")))
    scored = records.select("path", F.inline(F.array(*options)))
    hits = top_per_key(scored.where("score > 0"), ["query_id"], [F.desc("score"), F.asc("path")], k, "rank")
    missing = scored.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    return hits.unionByName(top_per_key(missing, ["query_id"], [F.asc("path")], fallback, "rank"))


def gap_rank(open_slots: DataFrame, k: int = 3) -> DataFrame:
    """First open slots of each query: call edges, then implementation, definition, reference."""
    priority = lookup("slot", fixed.GAP_PRIORITY, 9)
    known = open_slots.where(F.col("slot").isin(list(fixed.GAP_PRIORITY)))
    return top_per_key(known.withColumn("priority", priority), ["query_id"], [F.asc("priority"), F.asc("seq")], k, "rank")


def rank_context_files(evidence: DataFrame, keywords: list[str]) -> DataFrame:
    """Files of each query ordered for reading: low-priority folders last, defining files and many hits first."""
    defines = any_of([F.coalesce("snippet", F.lit("")).rlike(r"(?iuU)\b(?:class|def)\s+" + literal(k) + r"\b") for k in keywords])
    per = evidence.groupBy("query_id", "file").agg(F.count("*").alias("hits"), F.bool_or(defines).alias("defines"))
    folder = F.regexp_replace(paths.norm_path("file"), r"[^/]*$", "")
    return per.withColumn("low_priority", paths.in_dirs(folder, fixed.LOW_PRIORITY_DIRS)).orderBy(
        "query_id", "low_priority", ~F.col("defines"), F.desc("hits"), "file"
    )


def best_candidate(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One candidate file per key: production before tests, documentation and examples, then the order given by seq."""
    low = paths.in_dirs(F.lower("path"), fixed.NON_PRODUCTION_DIRS).cast("int")
    return top_per_key(candidates.withColumn("_low", low), keys, [F.asc("_low"), F.asc("seq")], 1).drop("_low")


def context_windows(hits: DataFrame, radius: int = 30, max_windows: int = 3) -> DataFrame:
    """Merged line ranges around hits, the heaviest few of each file in line order.

    hits: query_id, path, line_no, is_definition, n_lines. Equal lines collapse first, so the ordered pass over a file
    is bounded by the file's length.
    """
    keys = ["query_id", "path"]
    good = hits.where((F.col("line_no") >= 1) & (F.col("line_no") <= F.col("n_lines")))
    lines = good.groupBy(*keys, "line_no", "n_lines").agg(F.max(F.when(F.col("is_definition"), 4).otherwise(1)).alias("weight"))
    lines = lines.withColumn("s", F.greatest(F.lit(1), F.col("line_no") - radius)).withColumn("e", F.least("n_lines", F.col("line_no") + radius))
    w = Window.partitionBy(*keys).orderBy("line_no")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.withColumn("opens", F.when(before.isNull() | (F.col("s") > before + 1), 1).otherwise(0))
    lines = lines.withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    islands = lines.groupBy(*keys, "island").agg(
        F.min("s").alias("start_line"), F.max("e").alias("end_line"), F.sum("weight").alias("weight")
    )
    kept = top_per_key(islands, keys, [F.desc("weight"), F.asc("start_line")], max_windows)
    return kept.withColumn("window_no", F.row_number().over(Window.partitionBy(*keys).orderBy("start_line"))).drop("island")


def snippet_windows(
    hits: DataFrame, lines: DataFrame, before: int | Column, after: int | Column, chars: int | None = None,
    keys: Sequence[str] = ("path",), by: Sequence[str] = (),
) -> DataFrame:
    """Numbered source lines around each hit (file keys, line_no), as ``snippet`` with its last line number.

    ``before`` and ``after`` may be columns of ``hits``, and ``by`` names those of its columns that tell the windows of one line apart.
    A window names the few bins of lines that it touches and meets these by (file, bin), so a hit is sent some three times,
    however many lines it shows. With ``chars`` a line that no longer fits is passed over, and a blank line or a new statement ends
    the window.
    """
    own = [*keys, *by, "line_no"]
    first, last = F.greatest(F.lit(1), F.col("line_no") - before), F.col("line_no") + after
    wanted = hits.select(*own, first.alias("first_line"), last.alias("last_line")).distinct()
    bin_of = lambda c: F.floor(F.col(c) / WINDOW_BIN)
    wanted = wanted.withColumn("bin", F.explode(F.sequence(bin_of("first_line"), bin_of("last_line"))))
    source = lines.select(*keys, F.col("line_no").alias("n"), "line", bin_of("line_no").alias("bin"))
    numbered = F.concat(F.col("n").cast("string"), F.lit("| "), "line")
    stripped = python_strip("line")
    closes = (stripped == "") | stripped.rlike(r"^(def |class |return|raise|if |for )")
    shown = wanted.join(source, [*keys, "bin"]).where("n between first_line and last_line")
    got = shown.groupBy(*own, "first_line", "last_line").agg(
        F.array_sort(F.collect_list(F.struct("n", numbered.alias("text"), closes.alias("closes")))).alias("part")
    )
    if chars is None:
        texts = F.transform("part", lambda x: x["text"])
        return got.select(*own, F.array_join(texts, "\n").alias("snippet"), F.element_at("part", -1)["n"].alias("end_line"))
    start = F.struct(strings([]).alias("kept"), F.lit(0).alias("chars"), F.lit(False).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        over = (acc["chars"] + F.length(x["text"]) > chars) & (F.size(acc["kept"]) > 0)
        add = ~acc["done"] & ~over
        return F.struct(
            F.when(add, F.concat(acc["kept"], F.array(x["text"]))).otherwise(acc["kept"]).alias("kept"),
            F.when(add, acc["chars"] + F.length(x["text"]) + 1).otherwise(acc["chars"]).alias("chars"),
            (acc["done"] | (over & x["closes"])).alias("done"),
        )

    folded = got.withColumn("acc", F.aggregate("part", start, step))
    start_line = F.get("part", F.lit(0))["n"]
    return folded.select(*own, F.array_join("acc.kept", "\n").alias("snippet"), (start_line + F.size("acc.kept") - 1).alias("end_line"))


def read_windows(hits: DataFrame, lines: DataFrame, keys: Sequence[str] = ("path",), chars: int = fixed.WINDOW_CHARS) -> DataFrame:
    """What an investigation reads around each hit (file keys, line_no, question_type): the type sets the size of the window."""
    size = lambda at: lookup("question_type", {t: w[at] for t, w in fixed.WINDOW_LINES.items()}, fixed.DEFAULT_WINDOW[at])
    return snippet_windows(hits, lines, size(0), size(1), chars, keys, ["question_type"])


def stratified_sample(samples: DataFrame, count: int = 40) -> DataFrame:
    """A fixed mix of risk levels, languages and extreme sizes: the first samples of each bucket, each sample once.

    samples: sample_id, seq, risk_level, has_python, has_other, files.
    """
    quotas = {
        "high": max(count // 5, 5), "medium": max(count // 4, 8), "low": max(count // 5, 5),
        "non_python": max(count // 10, 3), "mixed": max(count // 10, 3), "edge": max(count // 20, 2),
    }
    names = list(quotas)
    main = (
        F.when(F.col("risk_level") == "high", "high").when(F.col("risk_level") == "medium", "medium")
        .when(~F.col("has_python"), "non_python").when(F.col("has_other"), "mixed").otherwise("low")
    )
    extreme = F.when((F.col("files") == 0) | (F.col("files") > 50), F.lit("edge"))
    rows = samples.select("sample_id", "seq", F.explode(F.array_compact(F.array(main, extreme))).alias("bucket"))
    few = top_per_key(rows, ["bucket"], [F.asc("seq")], max(quotas.values()), "in_bucket")
    few = few.where(F.col("in_bucket") <= lookup("bucket", quotas, 0))
    few = few.withColumn("part", lookup("bucket", {n: i for i, n in enumerate(names)}))
    first = dedupe_first(few, ["sample_id"], [F.asc("part"), F.asc("in_bucket")])
    return first.orderBy("part", "in_bucket").limit(count)


def dedupe_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1)


def definition_lines(lines: DataFrame, keywords: list[str], limit: int = 5) -> DataFrame:
    """First lines of each file that define one of the keywords."""
    tests = [F.lower("line").contains(k.lower()) & F.col("line").rlike(r"(?iuU)^\s*(?:class|def|async\s+def|function)\s+" + literal(k) + r"\b") for k in keywords]
    return top_per_key(lines.where(any_of(tests)), ["path"], [F.asc("line_no")], limit, "rank")


def most_recent(df: DataFrame, time: str, ties: list[str], n: int | None = None) -> DataFrame:
    """Newest first; with ``n`` only the first n, by a partial top-n in every task."""
    ordered = df.orderBy(F.desc(time), *[F.asc(c) for c in ties])
    return ordered.limit(n) if n else ordered
