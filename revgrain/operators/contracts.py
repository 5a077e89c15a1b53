"""Evidence contracts: relations to slots, slot filling, slot state, sufficiency, next steps, plain reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from revgrain import fixed
from revgrain.functions import paths, questions
from revgrain.functions.patterns import lookup, strings
from revgrain.operators.matching import contained
from revgrain.operators.ranking import top_per_key

EDGE_SLOTS = ["verified_caller_edge", "verified_callee_edge"]
PLAIN_SLOTS = ["definition", "implementation", "helper_implementation", "negative_search"]


def relation_edges(relations: DataFrame) -> DataFrame:
    """Directed pairs of neighbouring subjects of each trace relation. relations: query_id, relation_id, type, subjects."""
    traced = relations.where("type = 'trace_call_chain'")
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("subjects") - 1),
        lambda i: F.struct(F.element_at("subjects", i).alias("source"), F.element_at("subjects", i + 1).alias("destination")),
    )
    rows = traced.where(F.size("subjects") >= 2).select("query_id", "relation_id", F.inline(pairs))
    return rows


def target_slots(relations: DataFrame, standalone: DataFrame | None = None) -> DataFrame:
    """Slots each symbol of a query needs, once each, over all its relations.

    The nodes of a trace need definition and implementation; its edges are separate (``relation_edges``).
    """
    slots = F.when(F.col("type") == "trace_call_chain", strings(fixed.NODE_SLOTS)).otherwise(questions.expand_relation("type"))
    bits = lambda c: sum((F.when(F.array_contains(c, s), 1 << i).otherwise(0) for i, s in enumerate(fixed.SLOT_ORDER)), F.lit(0))
    rows = relations.select("query_id", bits(slots).alias("bits"), F.explode("subjects").alias("symbol"))
    if standalone is not None:
        rows = rows.unionByName(standalone.select("query_id", "symbol", bits(strings(fixed.NODE_SLOTS)).alias("bits")))
    # One number a symbol goes through the shuffle, not a row for each of its slots.
    needed = rows.groupBy("query_id", "symbol").agg(F.bit_or("bits").alias("bits"))
    named = F.array_compact(F.array(*[F.when(F.col("bits").bitwiseAND(1 << i) > 0, s) for i, s in enumerate(fixed.SLOT_ORDER)]))
    return needed.select("query_id", "symbol", F.explode(named).alias("slot"))


def fill_slots(tasks: DataFrame, evidence: DataFrame, targets: DataFrame) -> DataFrame:
    """Evidence of each task, attached to every target whose symbol holds, or is held in, the task's target.

    tasks: query_id, task_id, target. evidence: query_id, task_id, ev_id, source. targets: query_id, symbol.
    Call edges count as verified only; other sources count as plain evidence as well.
    """
    rows = evidence.withColumn("slot", questions.source_slot("source")).where(F.col("slot").isNotNull())
    # Symbols meet the tasks first, which are narrow; evidence is sent to its task once.
    met = contained(tasks.select("query_id", "task_id", "target"), targets, ["query_id"], "target", "symbol", both=True)
    filled = rows.select("query_id", "task_id", "ev_id", "slot").join(met.select("query_id", "task_id", "symbol"), ["query_id", "task_id"])
    return filled.select("query_id", "symbol", "slot", "ev_id").distinct().withColumn(
        "plain", ~F.col("slot").isin(EDGE_SLOTS)
    )


def slot_counts(required: DataFrame, filled: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """Required slots with their numbers of plain and verified evidence rows."""
    counts = filled.groupBy("query_id", "symbol", "slot").agg(
        F.count_if("plain").alias("evidence"), F.count("*").alias("verified")
    )
    keys = ["query_id", "symbol", "slot"]
    out = required.join(counts, keys, "left")
    if blocked is not None:
        out = out.join(blocked.select(*keys).distinct().withColumn("blocked", F.lit(True)), keys, "left")
    else:
        out = out.withColumn("blocked", F.lit(False))
    return out.select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("evidence", "verified")], F.coalesce("blocked", F.lit(False)).alias("blocked"))


def slot_status(slots: DataFrame) -> DataFrame:
    """Adds ``closed`` and ``open`` to (query_id, symbol, slot, evidence, verified, blocked).

    Definition-like slots close on any evidence, call edges on verified evidence, a candidate reference on any evidence
    unless its target also needs a call edge. A blocked slot is not open.
    """
    edges = slots.groupBy("query_id", "symbol").agg(F.bool_or(F.col("slot").isin(EDGE_SLOTS)).alias("has_edge"))
    plain_ok = F.col("slot").isin(PLAIN_SLOTS) | ((F.col("slot") == "candidate_reference") & ~F.col("has_edge"))
    closed = (F.col("verified") > 0) | (plain_ok & (F.col("evidence") > 0))
    return slots.join(edges, ["query_id", "symbol"]).select(
        *slots.columns, closed.alias("closed"), (~closed & ~F.col("blocked")).alias("open")
    )


def target_status(status: DataFrame) -> DataFrame:
    """Per target: complete, any slot closed, and the open slots."""
    return status.groupBy("query_id", "symbol").agg(
        (~F.bool_or("open")).alias("complete"), F.bool_or("closed").alias("any_closed"), F.count_if("open").alias("open_slots")
    )


def minimum_contract(slots: DataFrame, questions_: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """Whether each query has the least evidence its type asks for, and why not.

    slots as for ``slot_status``. questions_: query_id, question_type. claims: query_id, claim_index, covered. Targets
    are reduced to flags first, then queries; both steps combine before the shuffle.
    """
    slot, found, verified = F.col("slot"), F.col("evidence") > 0, F.col("verified") > 0
    some = (F.col("evidence") + F.col("verified")) > 0
    closed = verified | (slot.isin(PLAIN_SLOTS) & found)
    tests = {
        "d": (slot == "definition") & some, "i": (slot == "implementation") & some, "r": (slot == "candidate_reference") & some,
        "ref": (slot == "candidate_reference") & found, "caller": (slot == "verified_caller_edge") & verified,
        "edge": slot.isin(EDGE_SLOTS), "closed": closed, "closed_alone": closed | ((slot == "candidate_reference") & found),
    }
    # The tests of a target are pairs of bits of one number (known, true), so a target takes little memory and meets itself in no join.
    bits = sum((F.when(c, 3 << 2 * n).when(~c, 1 << 2 * n).otherwise(0) for n, c in enumerate(tests.values())), F.lit(0))
    any_of = lambda n: F.when(F.col("bits").bitwiseAND(2 << 2 * n) > 0, True).when(F.col("bits").bitwiseAND(1 << 2 * n) > 0, False)
    per_target = slots.where("query_id is not null and symbol is not null").groupBy("query_id", "symbol").agg(
        F.bit_or(bits).alias("bits"), F.sum(F.when(slot.isin(EDGE_SLOTS), F.col("verified")).otherwise(0)).alias("edges")
    )
    per_target = per_target.select("query_id", "edges", *[any_of(n).alias(name) for n, name in enumerate(tests)])
    per_target = per_target.withColumn("any", F.when(F.col("edge"), F.col("closed")).otherwise(F.col("closed_alone")))
    ready = F.col("d") & F.col("i")
    per_query = per_target.groupBy("query_id").agg(
        F.bool_or("d").alias("d"), F.bool_or(ready).alias("ready"), F.count_if(ready).alias("n_ready"), F.bool_or("r").alias("r"),
        F.sum("edges").alias("edges"), F.bool_or(F.col("d") & (F.col("caller") | F.col("ref"))).alias("dep"), F.bool_or("any").alias("any"),
    )
    t = F.col("question_type")
    met = (
        F.when(t == "locate", F.col("d")).when(t == "grep", F.col("r")).when(t == "explain", F.col("ready"))
        .when(t == "trace", F.col("edges") >= 2).when(t == "impact", F.col("dep")).when(t == "compare", F.col("n_ready") >= 2)
        .otherwise(F.col("any"))
    )
    ready_text = F.col("n_ready").cast("string")
    reason = (
        F.when((t == "locate") & F.col("d"), "found definition")
        .when((t == "grep") & F.col("r"), "found references")
        .when((t == "explain") & F.col("ready"), "found definition and implementation")
        .when((t == "explain") & F.col("d"), "has definition but no implementation body")
        .when(t == "explain", "no definition or implementation for explain")
        .when((t == "trace") & (F.col("edges") >= 2), F.concat(F.lit("found "), F.col("edges").cast("string"), F.lit(" verified call edges")))
        .when((t == "trace") & (F.col("edges") == 1) & F.col("d"), "only 1 verified edge, need 2 for trace chain")
        .when((t == "trace") & (F.col("edges") == 0), "no verified call edges for trace")
        .when((t == "impact") & F.col("dep"), "found definition and dependency/caller evidence")
        .when(t == "impact", "need definition + dependency evidence for impact")
        .when((t == "compare") & (F.col("n_ready") >= 2), F.concat(ready_text, F.lit(" targets have definition+implementation for comparison")))
        .when((t == "compare") & (F.col("n_ready") == 1), F.concat(F.lit("only "), ready_text, F.lit(" target(s) ready, need 2 for comparison")))
        .when(t == "compare", "no targets ready for comparison")
        .when(~t.isin("locate", "grep", "trace") & F.col("any"), "some evidence found")
        .otherwise("no evidence found")
    )
    out = questions_.join(per_query, "query_id", "left")
    no_targets = F.col("any").isNull()
    out = out.select(
        "query_id", "question_type", F.when(no_targets, F.lit(False)).otherwise(met).alias("structural"),
        F.when(no_targets, "no targets").otherwise(reason).alias("reason"), (~no_targets).alias("_has_targets"),
    )
    if claims is None:
        return out.select("query_id", "question_type", F.col("structural").alias("met"), "reason")
    per_claim = claims.groupBy("query_id").agg(F.count("*").alias("claims"), F.count_if("covered").alias("covered"))
    out = out.join(per_claim, "query_id", "left")
    part = F.concat(F.col("covered").cast("string"), F.lit("/"), F.col("claims").cast("string"), F.lit(" claims covered"))
    with_claims = F.col("_has_targets") & F.col("claims").isNotNull()
    full = F.col("covered") == F.col("claims")
    text = (
        F.when(~with_claims, F.col("reason"))
        .when(~F.col("structural"), F.concat(F.lit("structural unmet ("), "reason", F.lit("); claims: "), part))
        .when(~full, F.concat(F.lit("structural met but claims unmet: "), part))
        .otherwise(F.concat(F.lit("structural met ("), "reason", F.lit("); claims: "), part))
    )
    return out.select(
        "query_id", "question_type", F.when(with_claims, F.col("structural") & full).otherwise(F.col("structural")).alias("met"), text.alias("reason")
    )


def next_open_slot(required: DataFrame, verified: DataFrame) -> DataFrame:
    """First slot of each task without verified evidence, with the tool and search kind to use.

    required: query_id, task_id, slot. verified: query_id, task_id, source.
    """
    filled = verified.select("query_id", "task_id", questions.source_slot("source").alias("slot")).distinct()
    missing = required.join(filled, ["query_id", "task_id", "slot"], "left_anti")
    order = lookup("slot", {s: i for i, s in enumerate(fixed.SLOT_ORDER)})
    missing = missing.withColumn("_order", order).where(F.col("_order").isNotNull())
    first = top_per_key(missing, ["query_id", "task_id"], [F.asc("_order")], 1).drop("_order")
    return first.withColumn("tool", questions.slot_tool("slot")).withColumn("search_kind", questions.slot_search_kind("slot"))


def slot_report(required: DataFrame, filled: DataFrame, evidence: DataFrame, per_slot: int = 3) -> DataFrame:
    """Answer without a model, as ordered lines: (query_id, symbol, slot_no, line_no, line).

    Lines stay rows, so a query with very many targets is never put together in one place.
    """
    few = top_per_key(filled, ["query_id", "symbol", "slot"], [F.asc("ev_id")], per_slot, "n")
    shown = few.join(evidence.select("query_id", "ev_id", "file", "start_line", "snippet"), ["query_id", "ev_id"])
    rows = required.join(shown, ["query_id", "symbol", "slot"], "left")
    label = F.concat(F.lit("  ["), lookup("slot", fixed.SLOT_LABEL), F.lit("] "))
    place = F.concat("file", F.lit(":"), F.col("start_line").cast("string"), F.lit(" — "), F.substring("snippet", 1, 200))
    body = rows.select(
        "query_id", "symbol", lookup("slot", {s: i + 1 for i, s in enumerate(fixed.SLOT_ORDER)}, 9).alias("slot_no"),
        F.coalesce("n", F.lit(1)).alias("line_no"), F.concat(label, F.coalesce(place, F.lit("尚待确认"))).alias("line"),
    )
    head = required.select("query_id", "symbol").distinct().select(
        "query_id", "symbol", F.lit(0).alias("slot_no"), F.lit(0).alias("line_no"), F.concat(F.lit("## "), "symbol").alias("line")
    )
    return head.unionByName(body)


def plain_report(evidence: DataFrame, limit: int = 10) -> DataFrame:
    """First evidence lines of each query."""
    line = F.concat(F.lit("- "), "file", F.lit(":"), F.col("start_line").cast("string"), F.lit(" — "), F.substring("snippet", 1, 240))
    return top_per_key(evidence, ["query_id"], [F.asc("seq")], limit, "line_no").select("query_id", "line_no", line.alias("line"))


def grounded_sentences(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Sentences of each answer that cite existing evidence, with ids rewritten to file:line.

    answers: query_id, answer. evidence: query_id, ev_id, file, start_line. Output rows keep the sentence number.
    """
    from revgrain.functions import text

    rows = answers.select("query_id", F.posexplode(text.sentences("answer")).alias("sentence_no", "sentence"))
    ids = rows.select("query_id", "sentence_no", F.explode(F.array_distinct(text.cited_ids("sentence"))).alias("ev_id"))
    place = F.concat("file", F.lit(":"), F.col("start_line").cast("string")).alias("place")
    known = ids.join(evidence.select("query_id", "ev_id", place), ["query_id", "ev_id"])
    per = known.groupBy("query_id", "sentence_no").agg(F.array_sort(F.collect_list(F.struct("ev_id", "place"))).alias("refs"))
    rewritten = F.aggregate(
        "refs", F.col("sentence"), lambda acc, r: F.replace(acc, F.concat(F.lit("["), r["ev_id"], F.lit("]")), r["place"])
    )
    return rows.join(per, ["query_id", "sentence_no"]).select("query_id", "sentence_no", rewritten.alias("sentence"))


def production_references(evidence: DataFrame) -> DataFrame:
    """Evidence outside documentation, examples, tests and scripts."""
    return evidence.where(~paths.in_dirs(F.lower(paths.norm_path("file")), fixed.NON_PRODUCTION_DIRS))


def uncovered(all_values: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    return all_values.join(covered.select(*keys).distinct(), keys, "left_anti")


