"""From an entity to scored connections (G4, J13, U1, D6): recall, judgement, guardrails, counter-check, scores and review state in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.config import RECALL, Recall
from braidwork.functions import scoring as S
from braidwork.functions.similarity import edit_similarity
from braidwork.operators import graph as G
from braidwork.operators.decisions import counter_checked, guarded
from braidwork.operators.matching import alias_hits, best_per_company, concept_hits

CANDIDATE = ["entity_id", "company_id", "recall_rule", "recall_score", "hop_count", "nodes", "types", "weights", "confidences", "keyword_match", "ambiguous", "ordinal"]


def company_paths(starts: DataFrame, edges: DataFrame, companies: DataFrame, hops: int, cfg: Recall = RECALL) -> DataFrame:
    """Walks from starts (start) that end on a company, the heaviest cfg.cap of each start, with company_id, rule, score and each edge's
    weight and confidence. companies: company_id, node_id; edges with confidence."""
    found = G.company_walks(G.walks(starts, edges, hops, cfg.weight_floor), companies, cfg.cap)
    facts = edges.select("edge_id", F.col("weight").alias("w"), "confidence")
    each = found.select("start", "nodes", F.posexplode("edge_ids").alias("i", "edge_id")).join(facts, "edge_id")
    lists = F.array_sort(F.collect_list(F.struct("i", "w", "confidence")))
    sides = each.groupBy("start", "nodes").agg(lists.alias("l")).select("start", "nodes", F.transform("l", lambda x: x["w"]).alias("weights"), F.transform("l", lambda x: x["confidence"]).alias("confidences"))
    rule = G.walk_rule(F.col("types"))
    return found.join(sides, ["start", "nodes"]).join(companies, "node_id").select("start", "company_id", rule.alias("recall_rule"), S.graph_recall_score(rule, F.col("weight"), cfg).alias("recall_score"), "hop", "nodes", "types", "weights", "confidences")


def recalled(entities: DataFrame, aliases: DataFrame, companies: DataFrame, concepts: DataFrame, edges: DataFrame, cfg: Recall = RECALL) -> DataFrame:
    """The candidates of all entities at once: by alias, by one step from the companies so found, by dictionary, and for persons by
    walks from themselves; of a company the best, cfg.cap of an entity.

    entities: entity_id, name, norm, spelled, kind, node_id. aliases: alias_id, company_id, alias, alias_norm,
    alias_spelled, alias_type, is_ambiguous. concepts: concept_norm, node_id. Companies that aren't in the table drop out.
    """
    none = F.array().cast("array<double>")
    hits = best_per_company(alias_hits(entities, aliases, cfg)).withColumnRenamed("rule", "recall_rule")
    a = hits.join(aliases.select("alias_id", "alias_norm", "alias_type", "is_ambiguous"), "alias_id").join(entities.select("entity_id", "norm", F.col("node_id").alias("entity_node")), "entity_id").join(companies, "company_id")
    edge = S.alias_edge(F.col("recall_rule"), F.col("recall_score"), F.col("is_ambiguous"))
    km = S.keyword_match(F.lit(True), F.col("norm") == F.col("alias_norm"), F.col("norm"), F.col("alias_norm"), F.col("alias_type"), F.col("is_ambiguous"), similarity=edit_similarity(F.col("norm"), F.col("alias_norm")))
    a = a.withColumn("e", edge).select(
        "entity_id", "company_id", "recall_rule", "recall_score", F.lit(1).alias("hop_count"), F.array("entity_node", "node_id").alias("nodes"), F.array("e.edge_type").alias("types"), F.array("e.weight").alias("weights"), F.array("e.confidence").alias("confidences"),
        km.alias("keyword_match"), F.col("is_ambiguous").alias("ambiguous"), _ordinal(0, F.col("alias_id").cast("string")), "node_id",
    )
    steps = company_paths(a.select(F.col("node_id").alias("start")).distinct(), edges, companies, 1, cfg)
    anchor = a.select("entity_id", F.col("company_id").alias("from"), F.col("node_id").alias("start"), *(F.col(c).alias(f"a_{c}") for c in ("hop_count", "nodes", "types", "weights", "confidences", "keyword_match", "ambiguous")))
    x = steps.join(anchor, "start").where("company_id <> from")
    b = x.select(
        "entity_id", "company_id", "recall_rule", "recall_score", (F.col("a_hop_count") + F.col("hop")).alias("hop_count"), G.concatenated(F.col("a_nodes"), F.col("nodes")).alias("nodes"), F.concat("a_types", "types").alias("types"), F.concat("a_weights", "weights").alias("weights"),
        F.concat("a_confidences", "confidences").alias("confidences"), F.col("a_keyword_match").alias("keyword_match"), F.col("a_ambiguous").alias("ambiguous"), _ordinal(1, F.array_join(G.concatenated(F.col("a_nodes"), F.col("nodes")), ">")),
    )
    d = dictionary(entities, concepts, edges, companies, cfg)
    p = company_paths(entities.where("kind = 'PERSON'").select(F.col("node_id").alias("start")), edges, companies, cfg.max_hops, cfg).join(entities.where("kind = 'PERSON'").select("entity_id", F.col("node_id").alias("start")), "start")
    p = p.select("entity_id", "company_id", "recall_rule", "recall_score", F.col("hop").alias("hop_count"), "nodes", "types", "weights", "confidences", F.lit(0).cast("long").alias("keyword_match"), F.lit(False).alias("ambiguous"), _ordinal(3, F.array_join("nodes", ">")))
    every = a.select(*CANDIDATE)
    for part in (b, d, p):
        every = every.union(part.select(*CANDIDATE))
    return G.merged(every.withColumn("weights", F.coalesce("weights", none)), ["entity_id"], cfg)


def dictionary(entities: DataFrame, concepts: DataFrame, edges: DataFrame, companies: DataFrame, cfg: Recall = RECALL) -> DataFrame:
    """Entities whose name meets a concept's, and the companies that walks from the concept reach; entity and concept come first in
    the path, with weight and confidence 1."""
    met = concept_hits(entities.select(F.col("entity_id").alias("name_id"), "norm"), concepts.select(F.col("node_id").alias("concept_id"), "concept_norm"))
    met = met.select(F.col("name_id").alias("entity_id"), F.col("concept_id").alias("start")).join(entities.select("entity_id", F.col("node_id").alias("entity_node")), "entity_id")
    w = company_paths(met.select("start").distinct(), edges, companies, cfg.max_hops, cfg).join(met, "start")
    one = F.array(F.lit(1.0))
    return w.select(
        "entity_id", "company_id", "recall_rule", "recall_score", (F.col("hop") + 1).alias("hop_count"), F.concat(F.array("entity_node"), "nodes").alias("nodes"), F.concat(F.array(F.lit("RELATED_CONCEPT")), "types").alias("types"), F.concat(one, "weights").alias("weights"),
        F.concat(one, "confidences").alias("confidences"), F.lit(0).cast("long").alias("keyword_match"), F.lit(False).alias("ambiguous"), _ordinal(2, F.array_join(F.concat(F.array("entity_node"), "nodes"), ">")),
    )


def _ordinal(part: int, rest: Column) -> Column:
    """Candidates of an earlier list win ties."""
    return F.concat(F.lit(f"{part}:"), rest).alias("ordinal")


def built(judged: DataFrame, checks: DataFrame) -> DataFrame:
    """Connections from judged candidates: guardrails, accepted ones only, counter-check, scores, band and review state.

    judged: candidates with connection_type, business_relevance, meme_llm, confidence_llm, explanation, verdict,
    used_path_steps, and what the guardrails need (candidate_ids, outside_terms, business_summary, path_labels,
    dangerous, negative_person). checks: connection_id (entity and company as "entity:company"), refuted, adjusted, reason.
    """
    g = guarded(judged.withColumn("confidence", F.col("confidence_llm")).withColumn("path_nodes", F.col("nodes")).withColumn("hops", F.col("hop_count")))
    g = g.where(~F.col("discarded") & (F.col("verdict") == "ACCEPT")).withColumn("connection_id", F.concat_ws(":", "entity_id", "company_id"))
    c = counter_checked(g, checks)
    mr = F.lit(None).cast("long")
    c = c.withColumn("supply_chain", S.supply_chain(F.col("types"), F.col("weights"))).withColumn("sure", S.confidence(F.col("confidences"), F.col("confidence"))).withColumn("meme", S.meme(F.col("meme_llm"), F.col("business_relevance"), mr, F.col("connection_type")))
    c = c.withColumn("gap", S.evidence_gap(F.col("confidences")))
    parts = {"business_relevance": F.col("business_relevance"), "keyword_match": F.col("keyword_match"), "supply_chain": F.col("supply_chain"), "market_reaction": mr, "meme": F.col("meme"), "confidence": F.col("sure")}
    c = c.withColumn("score", S.connection_score(parts, F.col("connection_type"), F.col("hop_count"), F.col("gap"), F.col("ambiguous"), F.lit(False)))
    state = S.review_state(F.col("business_relevance"), F.col("score"), F.col("meme"), F.col("hop_count"), F.col("ambiguous"), F.col("forced_pending"))
    return c.withColumn("band", S.relevance_band(F.col("business_relevance"))).withColumn("status", state)
