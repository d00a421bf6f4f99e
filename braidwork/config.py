"""Weights, thresholds and word lists. All are fixed values that results depend on; pass other objects to change them."""

from __future__ import annotations

from dataclasses import dataclass, field

BUSINESS_KINDS = ("DIRECT", "SUPPLY_CHAIN", "THEME", "PERSON", "PRODUCT", "LOCATION", "EVENT", "AFFILIATION")
NOMINAL_KINDS = ("NAME_MATCH", "KEYWORD", "MEME")
CONNECTION_KINDS = ("DIRECT", "SUPPLY_CHAIN", "THEME", "PERSON", "PRODUCT", "LOCATION", "EVENT", "KEYWORD", "NAME_MATCH", "AFFILIATION", "MEME")
VISIBLE_STATES = ("ACTIVE", "DISPUTED", "CORRECTED")
FEEDBACK_KINDS = ("UNDERSTOOD", "FARFETCHED", "WRONG")


@dataclass(frozen=True)
class Scoring:
    business: dict[str, float] = field(default_factory=lambda: {"business_relevance": 0.40, "keyword_match": 0.20, "supply_chain": 0.15, "market_reaction": 0.15, "meme": 0.10})
    nominal: dict[str, float] = field(default_factory=lambda: {"keyword_match": 0.45, "market_reaction": 0.30, "meme": 0.15, "business_relevance": 0.05, "supply_chain": 0.05})
    confidence_base: float = 0.6
    confidence_span: float = 0.4
    hop_decay: float = 0.08
    hop_floor: float = 0.70
    cap_no_evidence: int = 60
    cap_ambiguous: int = 80
    cap_unreviewed: int = 95
    alias_multiplier: dict[str, float] = field(default_factory=lambda: {"OFFICIAL": 1.0, "SHORT": 0.95, "BRAND": 0.9, "TICKER": 1.0, "ENGLISH": 0.85, "FORMER": 0.7, "NICKNAME": 0.6})
    first_syllable_bonus: int = 12
    ambiguous_penalty: int = 25
    short_length: int = 2
    short_penalty: int = 40
    meme_floor: int = 50
    band_high: int = 70
    band_medium: int = 40
    band_low: int = 15
    review_business: int = 80
    review_score: int = 90
    review_meme: int = 90
    review_hops: int = 4


@dataclass(frozen=True)
class Recall:
    exact: float = 1.0
    prefix: float = 0.55
    similar_base: float = 0.35
    similar_span: float = 0.4
    similar_floor: float = 0.6
    rules: dict[str, float] = field(default_factory=lambda: {"SUPPLY_DICT": 0.75, "PERSON_DICT": 0.85, "GRAPH_EXPAND": 0.8, "THEME_DICT": 0.7})
    cap: int = 40
    max_hops: int = 3
    weight_floor: float = 0.15


@dataclass(frozen=True)
class Feedback:
    farfetched_above: float = 0.4
    least_votes: int = 20
    wrong_from: int = 3


SCORING, RECALL, FEEDBACK = Scoring(), Recall(), Feedback()

#: Days on which the market is closed besides weekends (fixed values).
HOLIDAYS = ("2026-01-01", "2026-03-01", "2026-03-02", "2026-05-05", "2026-06-06", "2026-08-15", "2026-08-17", "2026-10-03", "2026-10-05", "2026-10-09", "2026-12-25")
#: Query parameters that only track readers (fixed values).
TRACKING_PARAMETERS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "igshid", "ref", "ref_src", "spm", "cmpid", "NB_SRC")
#: Words that may not appear in explanations, and phrases in which they may (fixed values).
FORBIDDEN_WORDS = ("추천", "유망주", "수혜주", "급등 예상", "목표가", "매수", "매도", "담아라", "사라")
SAFE_PHRASES = ("투자 추천·자문이 아닙니다", "투자 추천·자문이 아니다", "투자 추천이나 자문이 아닙니다")
#: Words that mark disasters, and crimes of persons (fixed values).
DANGER_WORDS = ("사망", "사상자", "참사", "침몰", "붕괴", "화재", "폭발", "추돌", "충돌", "실종", "순직", "중태")
NEGATIVE_PERSON_WORDS = ("구속", "기소", "체포", "수사", "횡령", "배임", "사기", "구속영장", "압수수색", "입건")
#: Company names that are everyday words (fixed values).
AMBIGUOUS_ALIASES = ("한샘", "대한", "신라", "삼양", "대성", "태광", "노루", "한국", "동양", "우리", "하나", "제일")
HOLDING_SUFFIXES = ("홀딩스", "지주")
MARKET_NAMES = {"KOSPI": "KOSPI", "유가증권": "KOSPI", "KOSDAQ": "KOSDAQ", "코스닥": "KOSDAQ", "KONEX": "KONEX", "코넥스": "KONEX"}
#: What a path shows for each kind of edge (fixed values).
EDGE_LABELS = {
    "MENTIONS": "언급", "NAME_MATCH": "이름 일치", "NAME_SIMILAR": "이름 유사", "AFFILIATION": "계열 관계", "SUPPLY_CHAIN": "공급망", "PRODUCES": "생산",
    "BELONGS_TO": "소속", "RELATED_CONCEPT": "연관 개념", "PERSON_OF": "인물 소속", "LOCATED_IN": "소재지", "EVENT_IMPACT": "사건 영향",
}
#: Requests allowed in a fixed window of seconds, by tier.
RATE_LIMITS = {"ANONYMOUS_READ": (60, 120), "SEARCH": (60, 30), "DISCOVERY_REQUEST": (3600, 5)}
#: recall rule: (connection kind, business relevance, meme, path steps used) of the offline judge; None: any other rule.
REFERENCE_JUDGE = {
    "ALIAS_EXACT": ("NAME_MATCH", 10, 85, (0, 1)),
    "ALIAS_PREFIX": ("MEME", 15, 75, (0, 1)),
    "ALIAS_JAMO_SIMILAR": ("MEME", 15, 75, (0, 1)),
    "GRAPH_EXPAND": ("AFFILIATION", 8, 70, (0, 1, 2)),
    "SUPPLY_DICT": ("SUPPLY_CHAIN", 75, 0, (0, 1, 2)),
    "PERSON_DICT": ("PERSON", 60, 0, (0, 1)),
    None: ("THEME", 40, 10, (0, 1)),
}
