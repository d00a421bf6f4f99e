"""Sources (S1-S11): landed files to frames. Fetching over a network is the caller's; parsing is a DataFrame plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GOLDEN = "id string, headline string, anchor_entity string, must_include array<string>, must_exclude array<string>, expect_type string, br_range array<int>, score_range array<int>, note string, status string, needs_llm boolean"


def feed_items(files: DataFrame) -> DataFrame:
    """Items of RSS or Atom documents (source_id, outlet, xml): title, link, pub_date, description, each as text.

    Atom entries give their link's href and `updated`, else `published`.
    """
    parts = F.concat(F.regexp_extract_all("xml", F.lit(r"(?s)<item[ >].*?</item>"), F.lit(0)), F.regexp_extract_all("xml", F.lit(r"(?s)<entry[ >].*?</entry>"), F.lit(0)))
    rows = files.select("source_id", "outlet", F.explode(parts).alias("x"))

    def tag(*names: str):  # noqa: ANN202
        out = F.lit(None).cast("string")
        for n in reversed(names):
            v = F.regexp_extract("x", rf"(?s)<{n}(?: [^>]*)?>(?:\s*<!\[CDATA\[)?(.*?)(?:\]\]>\s*)?</{n}>", 1)
            out = F.when(v != "", F.trim(v)).otherwise(out)
        return out

    plain = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&#39;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))
    href = F.regexp_extract("x", r'<link[^>]*href="([^"]*)"', 1)
    return rows.select("source_id", "outlet", plain(tag("title")).alias("title"), plain(F.coalesce(tag("link"), F.when(href != "", href))).alias("link"), tag("pubDate", "updated", "published").alias("pub_date"), plain(tag("description", "summary")).alias("description"))


def trend_topics(files: DataFrame) -> DataFrame:
    """S3: topics of trend feeds (geo, xml): title, traffic, pub_date and news_items, an array of (title, url, source). A feed
    without items is an error; a topic without news has an empty array."""
    items = F.regexp_extract_all("xml", F.lit(r"(?s)<item[ >].*?</item>"), F.lit(0))
    rows = files.select("geo", F.explode(F.when(F.size(items) > 0, items).otherwise(F.raise_error(F.lit("trend feed without items")))).alias("x"))
    tag = lambda of, name: F.trim(F.regexp_extract(of, rf"(?s)<{name}(?: [^>]*)?>(?:\s*<!\[CDATA\[)?(.*?)(?:\]\]>\s*)?</{name}>", 1))
    known = lambda c: F.when(c != "", c)
    head = F.regexp_replace("x", r"(?s)<ht:news_item>.*</ht:news_item>", "")
    news = F.regexp_extract_all("x", F.lit(r"(?s)<ht:news_item>.*?</ht:news_item>"), F.lit(0))
    each = F.transform(news, lambda n: F.struct(*(tag(n, f"ht:news_item_{k}").alias(k) for k in ("title", "url", "source"))))
    return rows.select("geo", tag(head, "title").alias("title"), known(tag(head, "ht:approx_traffic")).alias("traffic"), known(tag(head, "pubDate")).alias("pub_date"), each.alias("news_items"))


def robots_rules(files: DataFrame) -> DataFrame:
    """(site, agent, prefix) rows of robots files (site, text): Disallow prefixes by user agent. Agents in a row share what follows."""
    lines = files.select("site", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("site", "i", F.trim(F.regexp_replace("line", "#.*$", "")).alias("line")).where("line <> ''")
    kv = lines.select("site", "i", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("k"), F.trim(F.expr("substring(line, locate(':', line) + 1)")).alias("v"))
    w = Window.partitionBy("site").orderBy("i")
    starts = F.when((F.col("k") == "user-agent") & (F.coalesce(F.lag("k").over(w), F.lit("")) != "user-agent"), 1).otherwise(0)
    kv = kv.withColumn("start", starts).withColumn("block", F.sum("start").over(w)).where("block > 0")
    agents = kv.where("k = 'user-agent'").select("site", "block", F.lower("v").alias("agent"))
    return agents.join(kv.where("k = 'disallow' and v <> ''").select("site", "block", F.col("v").alias("prefix")), ["site", "block"], "left").select("site", "agent", "prefix")


def allowed(paths: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """Paths (site, path) with `allowed`: rules of the agent itself if the site has any, else those of `*`; none allow all."""
    own = rules.where(F.col("agent") == agent.lower()).select("site").distinct()
    use = rules.where(F.col("agent") == agent.lower()).union(rules.where("agent = '*'").join(own, "site", "left_anti").select(*rules.columns)).where("prefix is not null")
    stops = use.groupBy("site").agg(F.collect_set("prefix").alias("stops"))
    return paths.join(stops, "site", "left").withColumn("allowed", ~F.coalesce(F.exists("stops", lambda p: F.startswith("path", p)), F.lit(False))).drop("stops")


def listing_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of listing responses; a response without them is an error."""
    row = "array<struct<ISU_SRT_CD:string,ISU_NM:string,ISU_ABBRV:string,MKT_NM:string,LIST_DD:string,ISU_CD:string,IDX_IND_NM:string>>"
    d = spark.read.schema(f"OutBlock_1 {row}").json(path, multiLine=True)
    return d.select(F.explode(F.when(F.col("OutBlock_1").isNull(), F.raise_error(F.lit("listing response without rows"))).otherwise(F.col("OutBlock_1"))).alias("r")).select("r.*")


def disclosure_rows(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """The list of responses with status 000; status 013 means no data; any other is an error. fields: DDL of a row."""
    d = spark.read.schema(f"status string, message string, list array<struct<{fields}>>").json(path, multiLine=True)
    good = F.when(F.col("status").isin("000", "013"), F.coalesce("list", F.expr(f"cast(array() as array<struct<{fields}>>)"))).otherwise(F.raise_error(F.concat_ws(" ", F.lit("disclosure source:"), "status", "message")))
    return d.select(F.explode(good).alias("r")).select("r.*")


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    """Golden cases from JSON lines; blank lines are skipped, malformed ones are errors."""
    return spark.read.schema(GOLDEN).option("mode", "FAILFAST").json(path)


def prompt(markdown: str) -> dict[str, str]:
    """Version, stage, system and user template of a prompt file: a comment with `name: value` fields between bars, a section
    SYSTEM, which ends where TOOL SCHEMA begins, and the first fenced block after the heading USER."""
    fields, section, fence, parts = {}, "", None, {"SYSTEM": [], "USER": []}
    for line in markdown.splitlines():
        bare = line.strip()
        if not fields and bare.startswith("<!--") and "version:" in bare:
            inside = bare.removeprefix("<!--").split("-->")[0]
            fields = {k.strip(): v.strip().split(" ")[0] for k, _, v in (f.partition(":") for f in inside.split("|"))}
        elif bare.startswith("## ") and fence is None:
            name = bare[3:]
            if name.startswith(("SYSTEM", "TOOL SCHEMA", "USER")):
                section = name.split(" ")[0]
            elif section == "SYSTEM":
                parts["SYSTEM"].append(line)
        elif section == "USER" and bare.startswith("```"):
            if fence is None:
                fence = "open"
            elif fence == "open":
                fence = "closed"
        elif section == "SYSTEM" or (section == "USER" and fence == "open"):
            parts[section].append(line)
    if not fields.get("version") or not fields.get("stage") or not parts["SYSTEM"] or fence != "closed":
        raise ValueError("a prompt needs a header, a SYSTEM section and a fenced USER block")
    return {"version": fields["version"], "stage": fields["stage"], "system": "\n".join(parts["SYSTEM"]).strip(), "user": "\n".join(parts["USER"]).strip()}


def landed(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """A landed table in any of Spark's formats."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def prices(spark: SparkSession, path: str) -> DataFrame:
    """Landed price responses (company_id, output), as mappers.quote_rows takes them; a response without output is dropped."""
    row = "struct<stck_prpr:string,prdy_ctrt:string,prdy_vrss_sign:string,acml_vol:string>"
    d = spark.read.schema(f"company_id long, output {row}").json(path)
    return d.where("output is not null").select("company_id", "output.*")


def seeds(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Seed dictionaries from one JSON file: companies, concepts, concept, supply and theme edges, and stop entities. Missing
    parts are empty."""
    edge = "array<struct<src:string,dst:string,weight:double,confidence:double>>"
    kinds = {
        "companies": "array<struct<ticker:string,name:string,market:string,sector:string,aliases:array<string>>>", "concepts": "array<struct<name:string,kind:string>>",
        "concept_edges": edge, "supply_edges": edge, "theme_edges": edge, "stop_entities": "array<string>",
    }
    d = spark.read.schema(", ".join(f"{k} {t}" for k, t in kinds.items())).json(path, multiLine=True)
    parts = {k: d.select(F.explode(k).alias("x")) for k in kinds}
    return {k: p.select("x.*") if "struct" in kinds[k] else p.select(F.col("x").alias("name")) for k, p in parts.items()}
