"""Scores of connections as column expressions (M1-M17). Numbers are rounded as floor(x + 0.5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from braidwork.config import NOMINAL_KINDS, RECALL, SCORING, Recall, Scoring
from braidwork.functions.similarity import jamo_similarity
from braidwork.functions.text import first_syllable_equal


def half_up(x: Column, digits: int = 0) -> Column:
    """x to the given digits; halves go up, negative ones too."""
    return F.floor(x + 0.5).cast("long") if not digits else F.floor(x * 10**digits + 0.5) / 10**digits


def clamp(x: Column, low: float = 0, high: float = 100) -> Column:
    return F.least(F.lit(high).cast("double"), F.greatest(F.lit(low).cast("double"), x))


def market_reaction(ratio: Column, pct: Column) -> Column:
    """M2; null unless both inputs are known."""
    volume = clamp(25 * F.log2(F.greatest(ratio, F.lit(0.25))) + 50)
    price = clamp(2.5 * F.abs(pct) + 50)
    return F.when(ratio.isNotNull() & pct.isNotNull(), half_up(0.6 * volume + 0.4 * price))


def keyword_match(has_name_edge: Column, is_exact: Column, entity: Column, alias: Column, alias_type: Column, ambiguous: Column, cfg: Scoring = SCORING, similarity: Column | None = None) -> Column:
    """M1. Similarity is that of the raw names, spelled out, unless it is given."""
    sim = jamo_similarity(entity, alias) if similarity is None else similarity
    times = F.lit(None).cast("double")
    for kind, x in cfg.alias_multiplier.items():
        times = F.when(alias_type == kind, x).otherwise(times)
    near = half_up(100 * sim) * times + F.when(first_syllable_equal(entity, alias), cfg.first_syllable_bonus).otherwise(0)
    raw = F.when(is_exact, 100 * times).otherwise(near) - F.when(ambiguous, cfg.ambiguous_penalty).otherwise(0) - F.when(F.length(entity) < cfg.short_length, cfg.short_penalty).otherwise(0)
    return F.when(~has_name_edge, F.lit(0).cast("long")).otherwise(half_up(clamp(raw.cast("double"))))


def meme(llm: Column, business: Column, market: Column, kind: Column, cfg: Scoring = SCORING) -> Column:
    """M3. Without a market reaction the other two weights share the whole."""
    two = 0.5 * llm + 0.3 * (100 - business)
    raw = clamp(F.when(market.isNull(), two / 0.8).otherwise(two + 0.2 * market))
    return half_up(F.when(kind == "MEME", F.greatest(raw, F.lit(float(cfg.meme_floor)))).otherwise(raw))


def confidence(edge_confidences: Column, llm: Column) -> Column:
    """M4: the weakest edge times the judge's confidence."""
    return half_up(F.array_min(edge_confidences) * llm / 100 * 100)


def supply_chain(edge_types: Column, weights: Column) -> Column:
    """M5: 100 times the least weight of a SUPPLY_CHAIN edge; edge_types[i] belongs to weights[i]."""
    ok = F.filter(F.arrays_zip(edge_types.alias("t"), weights.alias("w")), lambda x: x["t"] == "SUPPLY_CHAIN")
    return F.coalesce(half_up(100 * F.array_min(F.transform(ok, lambda x: x["w"]))), F.lit(0).cast("long"))


def connection_score(scores: dict[str, Column], kind: Column, hops: Column, evidence_gap: Column, ambiguous: Column, reviewed: Column, cfg: Scoring = SCORING) -> Column:
    """M6. Unknown scores drop out of the weighted mean; caps are applied in order."""

    def mean(weights: dict[str, float]) -> Column:
        top, low = F.lit(0.0), F.lit(0.0)
        for k, w in weights.items():
            top = top + F.coalesce(w * scores[k], F.lit(0.0))
            low = low + F.when(scores[k].isNotNull(), w).otherwise(0.0)
        return top / low

    base = F.when(kind.isin(*NOMINAL_KINDS), mean(cfg.nominal)).otherwise(mean(cfg.business))
    sure = cfg.confidence_base + cfg.confidence_span * (scores["confidence"] / 100)
    far = F.greatest(F.lit(cfg.hop_floor), 1 - cfg.hop_decay * (hops - 1))
    out = half_up(clamp(base * sure * far))
    for cond, cap in ((evidence_gap, cfg.cap_no_evidence), (ambiguous, cfg.cap_ambiguous), (~reviewed, cfg.cap_unreviewed)):
        out = F.when(cond, F.least(out, F.lit(cap).cast("long"))).otherwise(out)
    return out


def relevance_band(business: Column, cfg: Scoring = SCORING) -> Column:
    """M7."""
    return F.when(business >= cfg.band_high, "HIGH").when(business >= cfg.band_medium, "MEDIUM").when(business >= cfg.band_low, "LOW").otherwise("NONE")


def heat(articles: Column, tier: Column, recent: Column) -> Column:
    """M8, to 2 digits."""
    bonus = F.when(tier == 1, 15).when(tier == 2, 8).otherwise(0)
    return half_up(F.log2(F.greatest(articles, F.lit(1))) * 20 + bonus + recent * 5, 2)


def model_cost(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """USD to 6 digits; an unknown rate is an error, never 0."""
    return half_up(F.when(rate_in.isNull() | rate_out.isNull(), F.raise_error(F.lit("no rate for this model"))).otherwise(tokens_in / 1e6 * rate_in + tokens_out / 1e6 * rate_out), 6)


def importance(mentions: Column) -> Column:
    """M12."""
    return F.least(mentions / 50, F.lit(1.0))


def alias_recall_score(rule: Column, similarity: Column, cfg: Recall = RECALL) -> Column:
    """M15."""
    return F.when(rule == "ALIAS_EXACT", cfg.exact).when(rule == "ALIAS_PREFIX", cfg.prefix).otherwise(cfg.similar_base + similarity * cfg.similar_span)


def graph_recall_score(rule: Column, weight: Column, cfg: Recall = RECALL) -> Column:
    """M16."""
    base = F.lit(cfg.rules["THEME_DICT"])
    for k, x in cfg.rules.items():
        base = F.when(rule == k, x).otherwise(base)
    return F.least(F.lit(1.0), base * weight)


def alias_edge(rule: Column, score: Column, ambiguous: Column) -> Column:
    """(edge_type, weight, confidence)."""
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score - F.when(ambiguous, 0.3).otherwise(0.0)))
    return F.struct(F.when(rule == "ALIAS_EXACT", "NAME_MATCH").otherwise("NAME_SIMILAR").alias("edge_type"), score.alias("weight"), sure.alias("confidence"))


def evidence_gap(edge_confidences: Column) -> Column:
    """M17."""
    return F.exists(edge_confidences, lambda c: c <= 0.3)


def is_meme(kind: Column, meme_score: Column) -> Column:
    """F3."""
    return (kind == "MEME") | (meme_score >= 70)


def review_state(business: Column, score: Column, meme_score: Column, hops: Column, ambiguous: Column, forced: Column, cfg: Scoring = SCORING) -> Column:
    """F9."""
    needs = (business >= cfg.review_business) | (score >= cfg.review_score) | (meme_score >= cfg.review_meme) | (hops >= cfg.review_hops) | ambiguous | forced
    return F.when(needs, "PENDING").otherwise("ACTIVE")
