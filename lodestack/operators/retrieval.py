"""Retrieval over a graph: what a question asks, which objects it names, what lies around them and how sure that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.operators.graph import distances
from lodestack.runtime import cut

# Words by which questions tell their kind, predicate and object type; first hit counts.
REASONING = [
    ("comparison", ["compare", "comparison", "difference", "differ"]),
    ("impact", ["impact", "impacted", "ripple"]),
    ("path", ["connect", "path", "between", "link ", "trace", "how is", "how are", "how does"]),
    ("evidence", ["evidence", "support this", "supports this", "this conclusion", "back this up", "how do you know", "what proves", "cite"]),
    ("domain", ["overview", "explore", "tell me about the", "domain"]),
]
PREDICATES = [
    ("depends_on", ["depend", "rely on", "requires", "needs"]),
    ("supports", ["support", "enable", "back "]),
    ("implements", ["implement", "deliver", "realize", "realise"]),
    ("affects", ["affect", "impact"]),
    ("owned_by", ["owned by", "ownership", "owns", "responsible for"]),
    ("related_to", ["related", "relate", "associated", "connected with"]),
    ("references", ["reference", "cites", "mentions"]),
]
REFERENTS = ["that", "those", "them", "it", "this", "these"]
#: More questions or terms at once than this are no longer a small side.
MOST_TERMS = 10_000


def first_hit(low: Column, table: list[tuple[str, list[str]]], otherwise: str | None) -> Column:
    out = None
    for name, words in table:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.lit(otherwise))


def intent(questions: DataFrame) -> DataFrame:
    """question, reasoning, predicate, has_referent."""
    low = F.lower("question")
    words = F.split(F.regexp_replace(low, "[?,]", " "), r"\s+")
    return questions.select("question", first_hit(low, REASONING, "lookup").alias("reasoning"), first_hit(low, PREDICATES, None).alias("predicate"), F.arrays_overlap(words, F.array(*[F.lit(r) for r in REFERENTS])).alias("has_referent"))


# Word stems that name a type of object, and phrases that ask for evidence.
TYPES = {"Capability": ["capabilit"], "Decision": ["decision"], "Risk": ["risk"], "Team": ["team"], "Platform": ["platform"], "Technology": ["technolog"], "Initiative": ["initiative"], "Product": ["product"], "Process": ["process"], "Concept": ["concept"]}
EVIDENCE = ["evidence", "support this", "supports this", "this conclusion", "back this up", "how do you know", "what proves", "cite"]


def asked_for(questions: DataFrame) -> DataFrame:
    """question, object_type (NULL when none is named) and wants_evidence."""
    low = F.lower("question")
    named = F.coalesce(*[F.when(F.array_contains(F.array(*[low.contains(s) for s in stems]), True), kind) for kind, stems in TYPES.items()])
    return questions.select("question", named.alias("object_type"), F.array_contains(F.array(*[low.contains(x) for x in EVIDENCE]), True).alias("wants_evidence"))


def descriptions(vertices: DataFrame, kept: DataFrame) -> DataFrame:
    """id, label, kind of the kept objects, an id standing for a missing label."""
    return vertices.join(kept.select("id").distinct(), "id", "left_semi").select("id", F.coalesce("label", "id").alias("label"), "kind")


def compared(edges: DataFrame, left: str, right: str) -> DataFrame:
    """id and side (left, right or both) of the objects that one edge, either way, ties to one of two objects or to both."""
    ends = edges.select(F.col("source").alias("at"), F.col("target").alias("id")).union(edges.select("target", "source"))
    near = ends.where(F.col("at").isin(left, right) & ~F.col("id").isin(left, right)).groupBy("id").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    return near.select("id", F.when(F.col("lo") != F.col("hi"), "both").when(F.col("lo") == left, "left").otherwise("right").alias("side"))


def path_facts(path: DataFrame, edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """step, source_label, predicate, target_label, forward of the edges along a path (step, id): the least predicate between two neighbours, forward ones first."""
    a, b = path.select("step", F.col("id").alias("a")), path.select((F.col("step") - 1).alias("step"), F.col("id").alias("b"))
    e = edges.select("source", "predicate", "target")
    there = a.join(b, "step").join(e, ((F.col("a") == F.col("source")) & (F.col("b") == F.col("target"))) | ((F.col("a") == F.col("target")) & (F.col("b") == F.col("source"))))
    best = there.groupBy("step", "a", "b").agg(F.min(F.struct((F.col("source") != F.col("a")).alias("back"), "predicate")).alias("x"))
    label = vertices.select("id", F.coalesce("label", "id").alias("label"))
    out = best.join(label.select(F.col("id").alias("a"), F.col("label").alias("source_label")), "a", "left").join(label.select(F.col("id").alias("b"), F.col("label").alias("target_label")), "b", "left")
    return out.select("step", F.coalesce("source_label", "a").alias("source_label"), "x.predicate", F.coalesce("target_label", "b").alias("target_label"), (~F.col("x.back")).alias("forward"))


def _small(df: DataFrame, what: str) -> DataFrame:
    if df.limit(MOST_TERMS + 1).count() > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} {what} at once")
    return F.broadcast(df)


def focus_terms(questions: DataFrame, labels: DataFrame) -> DataFrame:
    """question, label, position of the labels a question holds, but those inside a longer one it holds too, and of what it has in quotes. Labels stream past the few questions."""
    q = _small(questions.select("question").distinct(), "questions")
    hit = labels.select("label").where("label <> ''").distinct().join(q, F.lower("question").contains(F.lower("label"))).withColumn("position", F.expr("instr(lower(question), lower(label))") - 1)
    hit = cut(hit)
    longer = hit.select(F.col("question").alias("q2"), F.col("label").alias("l2"))
    inside = (F.col("question") == F.col("q2")) & (F.lower("l2") != F.lower("label")) & F.lower("l2").contains(F.lower("label"))
    kept = hit.join(longer, inside, "left_anti")
    # Between the marks lie the parts with odd numbers, of '"' and of "'"; a phrase that is a label already is not named twice.
    spans = F.concat(*[F.transform(F.filter(F.transform(F.split("question", mark), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: p["i"] % 2 == 1), lambda p: F.trim(p["x"])) for mark in ('"', "'")])
    said = q.select("question", F.explode(F.array_distinct(F.filter(spans, lambda x: x != ""))).alias("label")).withColumn("position", F.expr("instr(lower(question), lower(label))") - 1)
    named = kept.select(F.col("question").alias("q2"), F.lower("label").alias("l2"))
    return kept.unionByName(said.join(named, (F.col("question") == F.col("q2")) & (F.lower("label") == F.col("l2")), "left_anti"))


def resolve_terms(terms: DataFrame, vertices: DataFrame) -> DataFrame:
    """term, id: the vertex with that id, else with that label (in any case), else the one with the shortest label that holds the term; the least id on ties. NULL when there is none."""
    t = _small(terms.select("term").distinct(), "terms")
    low, label = F.lower("term"), F.lower("label")
    rank = F.when(F.col("id") == F.col("term"), 0).when(label == low, 1).when(label.contains(low), 2)
    hit = vertices.select("id", "label").join(t, (F.col("id") == F.col("term")) | label.contains(low)).withColumn("rank", rank)
    best = hit.groupBy("term").agg(F.min_by("id", F.struct("rank", F.length("label").alias("n"), "id")).alias("id"))
    return terms.select("term").distinct().join(best, "term", "left")


def kept_objects(edges: DataFrame, vertices: DataFrame, seeds: DataFrame, depth: int = 2, most: int = 40) -> DataFrame:
    """id, dist, confidence of the nearest objects: by distance, confidence (NULLs last) and id, at most `most`."""
    near = distances(edges, seeds, depth).join(vertices.select("id", "confidence"), "id")
    return near.orderBy("dist", F.desc_nulls_last("confidence"), "id").limit(most)


def kept_edges(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges inside the kept objects; an edge is as sure as its less sure end."""
    a, b = kept.select(F.col("id").alias("source"), F.col("confidence").alias("ca")), kept.select(F.col("id").alias("target"), F.col("confidence").alias("cb"))
    return edges.select("source", "predicate", "target").distinct().join(a, "source").join(b, "target").select("source", "predicate", "target", F.least("ca", "cb").alias("confidence"))


def answer_confidence(kept: DataFrame, links: DataFrame, evidence: DataFrame, resolved: int, asked: int) -> DataFrame:
    """One row: means of seeds, links and evidence, coverage, score and band. Without links their weight goes to the evidence; without evidence coverage halves."""
    mean = lambda df, c: df.agg(F.coalesce(F.avg(c), F.lit(0.0)), F.count("*"))
    one = kept.sparkSession.range(1)
    cols = {
        "object": mean(kept.where("dist = 0"), "confidence"),
        "relationship": mean(links, "confidence"),
        "evidence": mean(evidence, "confidence"),
    }
    for name, df in cols.items():
        one = one.join(F.broadcast(df.toDF(name, f"n_{name}")), how="cross")  # one row each
    coverage = F.lit(1.0 if asked == 0 else resolved / asked) * F.when(F.col("n_evidence") > 0, 1.0).otherwise(0.5)
    blend = F.when(F.col("n_relationship") > 0, 0.30 * F.col("object") + 0.20 * F.col("relationship") + 0.30 * F.col("evidence") + 0.20 * coverage).otherwise(0.30 * F.col("object") + 0.50 * F.col("evidence") + 0.20 * coverage)
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), blend)), 3)
    out = one.select(*[F.round(c, 3).alias(c) for c in cols], F.round(coverage, 3).alias("coverage"), score.alias("score"))
    return out.withColumn("band", F.when(F.col("score") >= 0.75, "High").when(F.col("score") >= 0.5, "Medium").otherwise("Low"))


def follow_ups(turns: DataFrame, keep: int = 20) -> DataFrame:
    """conv, turn, carried: the objects a turn (conv, turn, text, objects) without its own takes over from the turn before, if its text refers back; of each conversation the last turns."""
    words = F.split(F.regexp_replace(F.lower("text"), "[?,]", " "), r"\s+")
    w = Window.partitionBy("conv").orderBy("turn")
    refers = F.arrays_overlap(words, F.array(*[F.lit(r) for r in REFERENTS])) & (F.size("objects") == 0)
    out = turns.withColumns({"carried": F.when(refers, F.lag("objects").over(w)), "back": F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("turn")))})
    return out.where(F.col("back") <= keep).select("conv", "turn", F.coalesce("carried", "objects").alias("carried"))


def context(kept: DataFrame, vertices: DataFrame, links: DataFrame, most_links: int = 60) -> DataFrame:
    """One text: objects in order of distance, then at most so many links."""
    o = kept.join(vertices.select("id", "label", "kind"), "id").agg(F.array_sort(F.collect_list(F.struct("dist", "id", F.format_string("- %s (%s), confidence %.2f", "label", "kind", kept["confidence"]).alias("t")))).alias("o"))
    r = links.orderBy("source", "predicate", "target").limit(most_links).agg(F.array_sort(F.collect_list(F.concat_ws(" ", F.lit("-"), "source", "predicate", "target"))).alias("r"))
    lines = F.concat(F.array(F.lit("Objects:")), F.transform("o", lambda x: x["t"]), F.array(F.lit("Links:")), F.col("r"))
    return o.join(F.broadcast(r), how="cross").select(F.array_join(lines, "\n").alias("context"))  # one row each
