"""Row mappers (P1-P9, P12-P15): a source's records to the engine's, dropping rows that can't be mapped."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidwork.config import AMBIGUOUS_ALIASES, EDGE_LABELS, HOLDING_SUFFIXES, MARKET_NAMES
from braidwork.functions.hashing import simhash32
from braidwork.functions.text import canonical_url, display_title, jamo, lead_text, nfc, normalize_name, path_text, title_tokens


def article_rows(items: DataFrame, now: Column | None = None) -> DataFrame:
    """Feed items (source_id, outlet, title, link, pub_date, description) to articles; without title or link they go.
    A missing or unreadable date is `now`."""
    title = display_title(nfc("title"), F.col("outlet"))
    out = items.select("source_id", title.alias("title"), canonical_url(F.col("link")).alias("url"), lead_text(F.col("description")).alias("lead"), F.coalesce(F.try_to_timestamp("pub_date"), now if now is not None else F.current_timestamp()).alias("published_at"))
    return out.where("title <> '' and url <> ''").withColumn("simhash", simhash32(title_tokens(F.col("title"))))


def company_rows(listing: DataFrame) -> DataFrame:
    """Listing rows to companies; ticker of six digits, known market and a name are required."""
    names = F.create_map(*chain.from_iterable((F.lit(a), F.lit(b)) for a, b in MARKET_NAMES.items()))
    name = F.trim(F.coalesce(F.when(F.col("ISU_NM") != "", F.col("ISU_NM")), F.col("ISU_ABBRV"), F.lit("")))
    day = F.col("LIST_DD")
    out = listing.select(
        F.trim("ISU_SRT_CD").alias("ticker"), F.when(F.trim("ISU_CD") != "", F.trim("ISU_CD")).alias("isin"), name.alias("name"), F.try_element_at(names, F.trim("MKT_NM")).alias("market"), F.when(F.trim("IDX_IND_NM") != "", F.trim("IDX_IND_NM")).alias("sector"),
        F.when(F.length(day) == 8, F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2))).alias("listed_at"),
    )
    norm = normalize_name(nfc("name"))
    return out.where(F.col("ticker").rlike(r"^\d{6}$") & F.col("market").isNotNull() & (F.col("name") != "")).withColumn("name_norm", norm).withColumn("name_jamo", jamo(F.col("name_norm")))


def quote_rows(quotes: DataFrame) -> DataFrame:
    """Price strings to numbers; signs 4 and 5 mean a fall, whatever the number's own sign."""
    pct = F.abs(F.col("prdy_ctrt").cast("double"))
    return quotes.select("company_id", F.col("stck_prpr").cast("long").alias("price"), F.when(F.col("prdy_vrss_sign").isin("4", "5"), -pct).otherwise(pct).alias("change_pct"), F.col("acml_vol").cast("long").alias("volume"))


def is_ambiguous(alias_norm: Column) -> Column:
    """P5."""
    return alias_norm.isin(*AMBIGUOUS_ALIASES) | (F.length(alias_norm) <= 1)


def expanded_aliases(companies: DataFrame) -> DataFrame:
    """(company_id, alias, alias_norm, alias_jamo, alias_type, is_ambiguous) from companies (company_id, name, ticker, english, former,
    brands, holding): each kind and normalised form once; blanks and Latin names of one or two letters go."""
    one = lambda c, kind: F.array(F.struct(c.alias("alias"), F.lit(kind).alias("alias_type")))
    many = lambda c, kind: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(x.alias("alias"), F.lit(kind).alias("alias_type")))
    short = F.lit(None).cast("string")
    for s in reversed(HOLDING_SUFFIXES):
        short = F.when(F.col("holding") & F.col("name").endswith(s) & (F.length("name") > len(s)), F.expr(f"substring(name, 1, length(name) - {len(s)})")).otherwise(short)
    every = F.concat(one(F.col("name"), "OFFICIAL"), one(F.col("ticker"), "TICKER"), one(F.col("english"), "ENGLISH"), many(F.col("former"), "FORMER"), many(F.col("brands"), "BRAND"), one(short, "SHORT"))
    rows = companies.select("company_id", F.posexplode(every).alias("i", "x")).select("company_id", "i", F.trim("x.alias").alias("alias"), "x.alias_type")
    rows = rows.where(F.col("alias").isNotNull() & (F.col("alias") != "") & ~F.col("alias").rlike("^[A-Za-z]{1,2}$")).withColumn("alias_norm", normalize_name(nfc("alias"))).where("alias_norm <> ''")
    first = Window.partitionBy("company_id", "alias_type", "alias_norm").orderBy("i")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return rows.select("company_id", "alias", "alias_norm", jamo(F.col("alias_norm")).alias("alias_jamo"), "alias_type", is_ambiguous(F.col("alias_norm")).alias("is_ambiguous"))


def business_summary(name: Column, market: Column, sector: Column, established: Column, chief: Column) -> Column:
    """A template; what is unknown is left out."""
    clause = F.when(sector.isNotNull() & (sector != ""), F.concat(sector, F.lit(" 업종의 "))).otherwise(F.lit(""))
    first = F.concat(name, F.lit("은(는) "), clause, market, F.when(established.rlike(r"^\d{8}$"), F.concat(F.lit(" 상장기업으로, "), F.left(established, F.lit(4)), F.lit("년에 설립되었다."))).otherwise(F.lit(" 상장기업이다.")))
    return F.concat_ws(" ", first, F.when(chief.isNotNull() & (chief != ""), F.concat(F.lit("대표이사는 "), chief, F.lit("이다."))))


def affiliation_edges(holders: DataFrame, companies: DataFrame) -> DataFrame:
    """(company_id, related_id, weight, confidence): shareholders (company_id, ordinal, name_norm, stake_end, stake_begin) that are known
    companies, not the company itself; the first row of each related one. Weight grows with the stake from 0.3 to 0.95."""
    j = holders.join(companies.select(F.col("company_id").alias("related_id"), F.col("name_norm")), "name_norm").where("related_id <> company_id")
    j = j.withColumn("_n", F.row_number().over(Window.partitionBy("company_id", "related_id").orderBy("ordinal"))).where("_n = 1")
    pct = lambda c: F.regexp_replace(c, ",", "").try_cast("double")
    stake = F.coalesce(pct(F.col("stake_end")), pct(F.col("stake_begin")))
    stake = F.when(stake.between(0, 100), stake)
    weight = F.floor((0.3 + F.coalesce(stake, F.lit(0.0)) / 100 * 0.65) * 1000 + 0.5) / 1000
    return j.select("company_id", "related_id", F.least(F.lit(0.95), F.greatest(F.lit(0.3), weight)).alias("weight"), F.lit(0.9).alias("confidence"))


def disclosure_titles(titles: Column) -> Column:
    """P7."""
    return F.slice(titles, 1, 10)


def path_previews(paths: Column, company: Column) -> Column:
    """Up to two texts of a path's labels; edge labels come from edge_label."""
    return F.slice(F.transform(paths, lambda p: path_text(F.concat(F.transform(p, lambda s: s["label"]), F.array(company)))), 1, 2)


def edge_label(edge_type: Column) -> Column:
    """P15."""
    return F.try_element_at(F.create_map(*chain.from_iterable((F.lit(a), F.lit(b)) for a, b in EDGE_LABELS.items())), edge_type)


def rendered(template: str, values: dict[str, Column], loops: dict[str, tuple[Column, list[str]]] | None = None) -> Column:
    """{{key}} becomes its value, unknown keys nothing; {{#each name}}...{{/each}} is repeated for each struct of an array column
    (given with its fields), joined by line breaks. The template is parsed once, on the driver, into one expression."""
    import re

    def fill(part: str, get) -> Column:  # noqa: ANN001
        pieces = re.split(r"\{\{(\w+)\}\}", part)
        return F.concat(*[F.lit(p) if i % 2 == 0 else get(p) for i, p in enumerate(pieces)])

    top = lambda k: F.coalesce(values[k].cast("string"), F.lit("")) if k in values else F.lit("")
    out, rest, more = [], template, True
    while more:
        before, more, rest = rest.partition("{{#each ")
        out.append(fill(before, top))
        if more:
            name, _, rest = rest.partition("}}")
            inner, _, rest = rest.partition("{{/each}}")
            if loops and name.strip() in loops:
                rows, fields = loops[name.strip()]
                out.append(F.array_join(_each(rows, inner.strip(), fields, fill), "\n"))
    return F.concat(*out)


def _each(rows: Column, inner: str, fields: list[str], fill) -> Column:  # noqa: ANN001
    return F.transform(rows, lambda x: fill(inner, lambda k: F.coalesce(x[k].cast("string"), F.lit("")) if k in fields else F.lit("")))


def judgement_rows(raw: DataFrame) -> DataFrame:
    """JSON outputs (run_id, json) to judgements with `valid`: kinds, ranges and lengths must hold."""
    kind = "struct<company_id:bigint,verdict:string,connection_type:string,business_relevance:bigint,meme:bigint,confidence:bigint,explanation:string,caution:string,used_path_steps:array<int>>"
    j = raw.select("run_id", F.from_json("json", kind).alias("j")).select("run_id", "j.*").withColumn("used_path_steps", F.coalesce("used_path_steps", F.array().cast("array<int>")))
    ok = F.col("verdict").isin("ACCEPT", "REJECT") & F.col("business_relevance").between(0, 100) & F.col("meme").between(0, 100) & F.col("confidence").between(0, 100) & (F.length("explanation") <= 60) & (F.coalesce(F.length("caution"), F.lit(0)) <= 80)
    return j.withColumn("valid", F.coalesce(ok & F.col("company_id").isNotNull(), F.lit(False)))


def analytics_events(events: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Known events only, with their payload as JSON and their time in UTC, whatever the session's zone."""
    return events.where(F.col("name").isin(*kinds)).select("name", F.to_json("payload").alias("payload"), F.date_format(F.to_utc_timestamp("at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("at"))
