"""What is handed out: reports, tables of deals, memos, and the graph of evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltwork.functions import text as T

#: How many of each family enter the graph, the node's type, the edge's, and its confidence.
FAMILIES = {
    "roles": (8, "company", "WORKED_AT", 0.52), "schools": (4, "school", "EDUCATED_AT", 0.6), "repos": (1000, "github_repo", "BUILT_REPO", 0.5), "stories": (1000, "hn_story", "LAUNCHED_ON_HN", 0.45),
    "topics": (1000, "yc_rfs_topic", "MATCHES_YC_RFS", 0.5), "competitors": (8, "competitor", "COMPETES_WITH", 0.45), "investors": (12, "investor", "INVESTED_IN", 0.85), "signals": (14, "evidence", "SUPPORTED_BY_EVIDENCE", 0.7),
    "risks": (10, "risk", "HAS_RISK", 0.6), "evidence": (20, "evidence", "SUPPORTED_BY_EVIDENCE", 0.7),
}
#: Families whose edge leads to the founder or company, and not from it; families of the company.
INWARD, OF_COMPANY = ("investors", "evidence"), ("stories", "topics", "competitors", "investors", "risks")


def report_lines(report: Column, fields: Sequence[tuple[str, str, bool]], title: str) -> Column:
    """A report (map) as Markdown; conditional fields (key, label, conditional) are hidden when unknown."""
    head = F.concat(F.lit("# "), F.coalesce(F.nullif(report["startup_name"], F.lit("")), F.lit("Unnamed")), F.lit(f" — {title}\n"))
    lines = []
    for key, label, conditional in fields:
        value = F.coalesce(F.nullif(report[key], F.lit("")), F.lit("unknown"))
        line = F.concat(F.lit(f"**{label}:** "), value)
        lines.append(F.when(~value.isin("n/a", "unknown"), line) if conditional else line)
    return F.concat_ws("\n", head, *lines)


def report_table(rows: DataFrame, report: Column, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """score (three digits), source, link and a column per report field, empty where missing."""
    cells = [F.coalesce(report[key], F.lit("")).alias(label) for key, label in fields]
    score = F.coalesce(F.format_string("%.3f", F.when(F.col("score").isNotNull(), F.col("score"))), F.lit(""))
    return rows.select(F.when(F.col("score").isNull(), "").otherwise(score).alias("Score"), F.coalesce("source", F.lit("")).alias("Source"), F.coalesce("source_url", F.lit("")).alias("Link"), *cells)


HEADER = "00000-header.csv"


def append_report(table: DataFrame, path: str) -> None:
    """Adds rows to a fund's folder of CSV files; what is there is never rewritten.

    The header is a file of its own that sorts first and is written once, so the files one after
    the other, by name, are one table however often rows were added.
    """
    spark = table.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{HEADER}")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        out = files.create(where)
        try:
            out.write(bytearray((",".join('"' + c.replace('"', '""') + '"' for c in table.columns) + "\n").encode()))
        finally:
            out.close()
    table.write.mode("append").option("header", "false").option("quoteAll", "true").option("escape", '"').csv(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A fund's table as text columns, named by its header."""
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    names = spark.read.options(**options).option("header", "true").csv(f"{path}/{HEADER}").columns
    return spark.read.options(**options).schema(", ".join(f"`{n}` string" for n in names)).csv(f"{path}/part-*")


def tables_of(deals: DataFrame) -> dict[str, DataFrame]:
    """People, companies, evidence, signals and scorecards of nested deals, one row each.

    ``deals`` has deal_id, name, headline, company, website, stage, total, recommendation,
    dimensions (map), evidence (array of id, field, quote) and signals (array of label, words,
    confidence).
    """
    d = deals
    return {
        "people": d.select("deal_id", "name", "headline", "company", "recommendation", "total"),
        "companies": d.where("coalesce(company, '') != '' OR coalesce(website, '') != ''").select("deal_id", "company", "website", "stage"),
        "evidence": d.select("deal_id", F.explode("evidence").alias("e")).select("deal_id", "e.*"),
        "signals": d.select("deal_id", F.posexplode("signals").alias("at", "s")).select("deal_id", "at", "s.*"),
        "scorecard": d.select("deal_id", "name", "total", F.explode("dimensions").alias("dimension", "score")),
    }


def with_average(rows: DataFrame, name: str, values: Sequence[str]) -> DataFrame:
    """Rows and below them one of the means, to two digits."""
    mean = rows.agg(*[F.round(F.avg(v), 2).alias(v) for v in values]).withColumn(name, F.lit("average"))
    return rows.select(name, *[F.col(v).cast("double").alias(v) for v in values]).unionByName(mean.select(name, *values))


def memo(deal: dict[str, Column], notes: Column, most: int = 12) -> Column:
    """A memo in Markdown with footnotes of the first pieces of evidence (array of field, quote)."""
    foot = F.transform(F.slice(notes, 1, most), lambda e, i: F.concat(F.lit("[^"), i + 1, F.lit("]: "), e["field"], F.lit(": "), T.truncate_middle(e["quote"], 80)))
    name = F.coalesce(F.nullif(deal["name"], F.lit("")), F.lit("Unknown founder"))
    marks = F.concat_ws("", F.transform(F.slice(notes, 1, 3), lambda e, i: F.concat(F.lit("[^"), i + 1, F.lit("]"))))
    return F.concat_ws("\n\n", F.concat(F.lit("# "), name, F.lit(" memo")), F.lit("## Summary"), F.concat(deal["summary"], marks), F.lit("## Recommendation"), deal["recommendation"], F.lit("## Evidence"), F.array_join(foot, "\n"))


def joined_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claim, evidence pairs out of the claims' lists of evidence ids; unknown ids are left out."""
    pairs = claims.select("claim_id", F.explode("evidence_ids").alias("evidence_id")).distinct()
    return pairs.join(evidence, "evidence_id")


def runs_of(runs: DataFrame, deals: DataFrame) -> DataFrame:
    """deal_id, run_id of runs that name a deal in one of their tags ("dealId:...")."""
    tagged = runs.select("run_id", "created_at", F.explode("tags").alias("tag")).where(F.startswith("tag", F.lit("dealId:")))
    return tagged.withColumn("deal_id", F.substring_index("tag", ":", -1)).join(deals.select("deal_id"), "deal_id", "left_semi").select("deal_id", "run_id", "created_at").distinct()


def tag_value(tags: Column, prefix: str) -> Column:
    """What follows a prefix in the first tag that begins with it, or null."""
    return F.substring(F.get(F.filter(tags, lambda t: t.startswith(prefix)), F.lit(0)), len(prefix) + 1, 1 << 30)


def saved(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Deals with the latest update of each id; of equal times the incoming one."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    columns = [c for c in stored.columns if c != "deal_id"]
    return both.groupBy("deal_id").agg(F.max_by(F.struct(*columns), F.struct("updated_at", "_new")).alias("d")).select("deal_id", "d.*").select(*stored.columns)


def evidence_graph(deals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (deal_id, id, type, label, confidence) and edges (deal_id, id, source, target, type, confidence).

    ``deals`` has deal_id, name, company, founder_score (0 to 100) and a list of texts per
    family. Each family is cut to its number; of equal ids the first counts, and an edge from a
    node to itself is left out. A founder's score above 1 counts as a percentage.
    """
    founder, company = F.concat(F.lit("person:"), "deal_id"), F.when(F.coalesce("company", F.lit("")) != "", F.concat(F.lit("company:"), F.lower("company")))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.col("founder_score") > 1, F.col("founder_score") / 100).otherwise(F.col("founder_score"))))
    base = deals.withColumns({"_founder": founder, "_company": company, "_score": score})
    first = base.select("deal_id", F.lit(-2).alias("family"), F.lit(0).alias("at"), F.col("_founder").alias("id"), F.lit("founder").alias("type"), F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit("Unknown founder")).alias("label"), F.col("_score").alias("confidence"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("edge"), F.lit(None).cast("double").alias("edge_confidence"))
    own = base.where("_company IS NOT NULL").select("deal_id", F.lit(-1).alias("family"), F.lit(0).alias("at"), F.col("_company").alias("id"), F.lit("company").alias("type"), F.col("company").alias("label"), F.lit(0.55).alias("confidence"), F.col("_founder").alias("source"), F.col("_company").alias("target"), F.lit("FOUNDER_OF").alias("edge"), F.col("_score").alias("edge_confidence"))
    rows = first.unionByName(own)
    for order, (family, (most, kind, edge, sure)) in enumerate(FAMILIES.items()):
        hub = F.coalesce("_company", "_founder") if family in OF_COMPANY else F.col("_founder")
        items = base.select("deal_id", hub.alias("hub"), F.posexplode(F.slice(family, 1, most)).alias("at", "text"))
        node = F.concat(F.lit(f"{family}:"), F.lower("text"))
        rated = F.when(F.lower("text").rlike("founder|co-founder|cofounder"), "cofounder").otherwise(kind) if family == "roles" else F.lit(kind)
        ends = (node, F.col("hub")) if family in INWARD else (F.col("hub"), node)
        part = items.select("deal_id", F.lit(order).alias("family"), "at", node.alias("id"), rated.alias("type"), T.truncate_middle(F.col("text"), 54).alias("label"), F.lit(sure).alias("confidence"), ends[0].alias("source"), ends[1].alias("target"), F.lit(edge).alias("edge"), F.lit(sure).alias("edge_confidence"))
        rows = rows.unionByName(part)
    order = F.struct("family", "at")
    nodes = rows.groupBy("deal_id", "id").agg(F.min_by(F.struct("type", "label", "confidence"), order).alias("n")).select("deal_id", "id", "n.*")
    linked = rows.where("edge IS NOT NULL AND source != target").withColumn("edge_id", F.concat_ws("_", "source", "edge", "target"))
    edges = linked.groupBy("deal_id", "edge_id").agg(F.min_by(F.struct("source", "target", F.col("edge").alias("type"), F.col("edge_confidence").alias("confidence")), order).alias("e")).select("deal_id", F.col("edge_id").alias("id"), "e.*")
    return nodes, edges


def visible(nodes: DataFrame, edges: DataFrame, types: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of some types, and edges with both ends among them."""
    kept = nodes.where(F.col("type").isin(*types))
    ends = kept.select("deal_id", "id")
    shown = edges.join(ends.withColumnRenamed("id", "source"), ["deal_id", "source"], "left_semi").join(ends.withColumnRenamed("id", "target"), ["deal_id", "target"], "left_semi")
    return kept, shown


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """deal_id, graph: nodes and edges of a deal as one JSON text, in the order of their ids."""
    n = nodes.groupBy("deal_id").agg(F.sort_array(F.collect_list(F.struct("id", "type", "label", "confidence"))).alias("nodes"))
    e = edges.groupBy("deal_id").agg(F.sort_array(F.collect_list(F.struct("id", "source", "target", "type", "confidence"))).alias("edges"))
    return n.join(e, "deal_id", "left").select("deal_id", F.to_json(F.struct("nodes", F.coalesce("edges", F.array().cast(e.schema["edges"].dataType)).alias("edges"))).alias("graph"))


def graph_places(nodes: DataFrame, width: int = 900, height: int = 620) -> DataFrame:
    """Nodes with x and y on a ring around the founder, in the order of their ids."""
    w = Window.partitionBy("deal_id").orderBy("id")
    ring = nodes.where("type != 'founder'").withColumn("k", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("deal_id")))
    angle = 2 * F.pi() * F.col("k") / F.col("n")
    around = ring.select("deal_id", "id", F.round(width / 2 + 0.38 * width * F.cos(angle), 2).alias("x"), F.round(height / 2 + 0.38 * height * F.sin(angle), 2).alias("y"))
    return around.unionByName(nodes.where("type = 'founder'").select("deal_id", "id", F.lit(width / 2).alias("x"), F.lit(height / 2).alias("y")))
