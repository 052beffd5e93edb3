"""Stages of screening: what still needs work, vectors, theses, verdicts, scores, visits, erasure."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.functions import scores as S
from siltwork.functions import text as T
from siltwork.operators.ranking import global_rank

PRIVATE = ("extension_private", "whatsapp")
TEXT_CHARS, LOCAL_BATCH, HOSTED_BATCH = 4000, 8, 64


def embed(rows: DataFrame, key: str, text: str, model: Callable[[list[str]], list[list[float]]], batch: int = HOSTED_BATCH) -> DataFrame:
    """key, embedding: vectors of cut texts, asked of ``model`` ``batch`` at a time.

    The model is any function from texts to as many vectors, in their order; it runs inside
    the tasks. Null and blank texts are asked for nothing and get no row.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            texts, vectors = given.column("text").to_pylist(), []
            for a in range(0, len(texts), batch):
                found = model(texts[a : a + batch])
                if len(found) != len(texts[a : a + batch]):
                    raise ValueError("a model must give one vector per text")
                vectors += found
            yield pa.RecordBatch.from_arrays([given.column(key), pa.array(vectors, pa.list_(pa.float64()))], names=[key, "embedding"])

    asked = rows.where(F.trim(F.coalesce(text, F.lit(""))) != "").select(key, F.substring(text, 1, TEXT_CHARS).alias("text"))
    return asked.mapInArrow(run, f"{key} {kind}, embedding array<double>")


def hashed_words(size: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A model without training: counts of words by a fixed hash."""

    def model(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), size))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                out[i, sum(b * (k + 1) for k, b in enumerate(word.encode())) % size] += 1
        return out.tolist()

    return model


def cosines(rows: DataFrame, key: str, vector: str, queries: DataFrame) -> DataFrame:
    """key, query, cosine of all rows with few queries (query, vector), as one matrix product per batch.

    Queries are read on the driver: a thesis has a handful of phrasings. 0 for null and zero
    vectors and for vectors of another length.
    """
    known = [(r["query"], r["vector"]) for r in queries.orderBy("query").collect()]
    kind, query_kind = rows.schema[key].dataType.simpleString(), queries.schema["query"].dataType.simpleString()
    units = []
    for _, v in known:
        v = np.asarray(v, np.float64)
        units.append(v / (np.linalg.norm(v) or 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            begins = np.cumsum(sizes) - sizes
            out = np.zeros((len(sizes), len(units)))
            for size in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == size)
                block = flat[begins[at][:, None] + np.arange(size)]
                norms = np.linalg.norm(block, axis=1)
                fit = [j for j, u in enumerate(units) if len(u) == size]
                dots = block @ np.array([units[j] for j in fit]).reshape(len(fit), size).T
                out[np.ix_(at, fit)] = np.divide(dots, norms[:, None], out=np.zeros_like(dots), where=norms[:, None] > 0)
            keys = batch.column(key).take(pa.array(np.repeat(np.arange(len(sizes)), len(units))))
            names = pa.array([q for q, _ in known] * len(sizes))
            yield pa.RecordBatch.from_arrays([keys, names, pa.array(out.ravel())], names=[key, "query", "cosine"])

    return rows.select(key, F.coalesce(F.col(vector).cast("array<double>"), F.array().cast("array<double>")).alias("vector")).mapInArrow(run, f"{key} {kind}, query {query_kind}, cosine double")


def pending_vectors(candidates: DataFrame, model: str, local: bool) -> DataFrame:
    """Unfiltered candidates without a vector of this model; private ones only for a local model."""
    need = candidates.where(F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(F.lit(model))).where("filtered_reason IS NULL")
    return need if local else need.where(~F.col("source").isin(*PRIVATE))


def best_allowed(scored: DataFrame, texts: DataFrame, key: str, excludes: DataFrame) -> DataFrame:
    """key, similarity, thesis over theses (ord) that do not exclude the text; -1 and null if all do.

    ``scored`` has key, thesis, ord, cosine; ``excludes`` thesis and a list of terms.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    barred = texts.select(key, low.alias("low")).join(F.broadcast(excludes), F.exists("terms", lambda t: F.col("low").contains(F.lower(t)))).select(key, "thesis")
    best = scored.join(barred, [key, "thesis"], "left_anti").groupBy(key).agg(F.max("cosine").alias("similarity"), F.max_by("thesis", F.struct("cosine", -F.col("ord"))).alias("thesis"))
    return texts.select(key).join(best, key, "left").select(key, F.coalesce("similarity", F.lit(-1.0)).alias("similarity"), "thesis")


def survivors(candidates: DataFrame, threshold: float, most: int) -> DataFrame:
    """The best candidates from a threshold on."""
    return candidates.where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "id").limit(most)


def shortlist(candidates: DataFrame, thesis=None, confidence: float = 0.0, most: int = 50) -> DataFrame:
    """The best scored startups, of one thesis if named, sure enough if asked, ties by id."""
    able = candidates.where("score IS NOT NULL AND is_startup = 1")
    able = able if thesis is None else able.where(F.col("thesis") == thesis)
    return (able.where(F.col("confidence") >= confidence) if confidence else able).orderBy(F.desc("score"), "id").limit(most)


def missing_terms(text: Column, terms: Column) -> Column:
    """Terms of a list that a text lacks."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(terms, lambda t: ~low.contains(F.lower(t)))


def triage(rows: DataFrame, key: str, judge: Callable[[str, str], str], capacity: int | None = None, order: Sequence[Column] = ()) -> DataFrame:
    """key, answer, error of asking ``judge`` (text, thesis) for each row inside the tasks.

    With a ``capacity`` only so many rows are asked, the first in ``order``, ties by key; rows
    that were not asked have neither answer nor error. Answers that hold no JSON object are
    errors and are not repeated.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers, errors = [], []
            for text, thesis, asked in zip(*[batch.column(c).to_pylist() for c in ("text", "thesis", "asked")]):
                if not asked:
                    answers.append(None)
                    errors.append(None)
                    continue
                found = balanced_object(judge(text or "", thesis or ""))
                answers.append(found)
                errors.append(None if found else "no object in the answer")
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=[key, "answer", "error"])

    turn = F.lit(True)
    if capacity is not None:
        rows, turn = global_rank(rows, [*order, F.col(key)], "__turn"), F.col("__turn") <= capacity
    return rows.select(key, "text", "thesis", turn.alias("asked")).mapInArrow(run, f"{key} {kind}, answer string, error string")


def balanced_object(text: str) -> str | None:
    """The first balanced JSON object of a chatty text, fences and words around it off."""
    begin = text.find("{")
    while begin >= 0:
        depth, quoted, skip = 0, False, False
        for at in range(begin, len(text)):
            c = text[at]
            if skip:
                skip = False
            elif quoted:
                quoted, skip = c != '"', c == "\\"
            elif c == '"':
                quoted = True
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if not depth:
                    return text[begin : at + 1]
        begin = text.find("{", begin + 1)
    return None


def verdict_columns(answer: Column, signals: Sequence[str]) -> dict[str, Column]:
    """Scores of all signals (0 where missing), is_startup and stage out of a verdict's JSON."""
    kind = ", ".join(f"{s} struct<score:double,quote:string>" for s in signals) + ", stage string"
    v = F.from_json(answer, kind)
    out = {s: F.coalesce(v[s]["score"], F.lit(0.0)) for s in signals}
    return out | {"is_startup": (out[signals[0]] >= 0.5).cast("int"), "stage": v["stage"]}


def quotes_checked(answer: Column, text: Column, signals: Sequence[str]) -> Column:
    """A verdict's JSON with quotes blanked that do not stand in the text."""
    kind = ", ".join(f"{s} struct<score:double,quote:string>" for s in signals) + ", stage string"
    v = F.from_json(answer, kind)
    parts = [F.struct(v[s]["score"].alias("score"), F.when(T.quote_in(F.coalesce(v[s]["quote"], F.lit("")), text), v[s]["quote"]).otherwise("").alias("quote")).alias(s) for s in signals]
    return F.to_json(F.struct(*parts, v["stage"].alias("stage")))


def thesis_match(answer: Column, confidence: Column) -> Column:
    """The old verdicts' own value, else the confidence; null without a readable verdict."""
    parsed = F.from_json(answer, "map<string,string>")
    return F.when(parsed.isNotNull(), F.coalesce(F.try_element_at(parsed, F.lit("thesis_match")).try_cast("double"), confidence))


def active_weights(fitted: dict | None, corpus_model: str, least: int = 40) -> dict[str, float]:
    """Fitted rank weights if they rest on enough labels of this corpus's model, else the defaults."""
    usable = fitted and fitted.get("labels", 0) >= least and fitted.get("model") == corpus_model
    return fitted["weights"] if usable else S.RANK_WEIGHTS


def ground_report(report: Column, text: Column, factual: Sequence[str]) -> tuple[Column, Column]:
    """A report (map) with unsupported factual fields set to "unknown", and their names."""
    passes = ("", "unknown", "n/a", "none", "yes", "no", "y", "n")
    haystack = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "^https?://", "")

    def wrong(value: Column) -> Column:
        plain = F.regexp_replace(T.strip(F.lower(value)), "^https?://|/$", "")
        return ~plain.isin(*passes) & ~haystack.contains(F.substring(plain, 1, 40))

    removed = F.map_filter(report, lambda k, v: k.isin(*factual) & wrong(F.coalesce(v, F.lit(""))))
    clean = F.transform_values(report, lambda k, v: F.when(k.isin(*factual) & wrong(F.coalesce(v, F.lit(""))), "unknown").otherwise(v))
    return clean, F.array_sort(F.map_keys(removed))


def record_visits(nodes: DataFrame, visits: DataFrame) -> DataFrame:
    """Nodes with their counters raised by visits (source, node, seen, hits, at, exhausted)."""
    latest = visits.groupBy("source", "node").agg(F.sum("seen").alias("_seen"), F.sum("hits").alias("_hits"), F.max("at").alias("_at"), F.max_by("exhausted", "at").alias("_ex"))
    joined = nodes.join(latest, ["source", "node"], "left")
    new = {"seen": F.col("seen") + F.coalesce("_seen", F.lit(0)), "hits": F.col("hits") + F.coalesce("_hits", F.lit(0)), "last_visited": F.coalesce("_at", "last_visited"), "exhausted": F.coalesce("_ex", "exhausted")}
    return joined.withColumns(new).select(*nodes.columns)


def add_nodes(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Unknown nodes one deeper than the node that led to them; known and deactivated ones stay as they are.

    ``found`` has source, node, parent. Of several parents the shallowest, then first by name, counts.
    """
    depth = nodes.select("source", F.col("node").alias("parent"), (F.col("depth") + 1).alias("depth"))
    new = found.join(depth, ["source", "parent"]).join(nodes.select("source", "node"), ["source", "node"], "left_anti")
    return new.groupBy("source", "node").agg(F.min("depth").alias("depth"), F.min_by("parent", F.struct("depth", "parent")).alias("parent"))


def deactivate(nodes: DataFrame, rejected: DataFrame) -> DataFrame:
    """Nodes with ``active`` 0 where rejected; rows and counters stay."""
    gone = rejected.select("source", "node").distinct().withColumn("_gone", F.lit(True))
    return nodes.join(gone, ["source", "node"], "left").withColumn("active", F.when(F.col("_gone"), 0).otherwise(F.col("active"))).drop("_gone")


def erase_author(tables: dict[str, DataFrame], author: str) -> dict[str, DataFrame]:
    """All tables without one person.

    ``tables`` has candidates (id, author), messages (sender), activity (author), nodes (source,
    node, display_name, parent), entities (entity, name, norm_name, handle), evidence (entity,
    candidate) and duplicates (id, duplicate_of). Entities go by name or by a handle of any
    source; an author's signs are no wildcards. Evidence of what went goes too; others' nodes
    lose the person as their parent.
    """
    name = F.lit(author)
    norm = T.normal_name(name)
    gone = tables["candidates"].where(F.col("author") == name).select("id")
    who = (F.col("name") == name) | ((norm != "") & (F.col("norm_name") == norm)) | F.coalesce(F.lower("handle").endswith(F.lower(F.concat(F.lit(":"), name))), F.lit(False))
    entities = tables["entities"].where(F.coalesce(who, F.lit(False))).select("entity")
    nodes = tables["nodes"].where(~F.coalesce((F.col("node") == name) | (F.col("display_name") == name), F.lit(False)))
    copies = gone.withColumnRenamed("id", "duplicate_of")
    return {
        "candidates": tables["candidates"].where(~F.col("author").eqNullSafe(name)),
        "messages": tables["messages"].where(~F.col("sender").eqNullSafe(name)),
        "activity": tables["activity"].where(~F.col("author").eqNullSafe(name)),
        "nodes": nodes.withColumn("parent", F.when(~F.col("parent").eqNullSafe(name), F.col("parent"))),
        "entities": tables["entities"].join(entities, "entity", "left_anti"),
        "evidence": tables["evidence"].join(entities, "entity", "left_anti").join(gone.withColumnRenamed("id", "candidate"), "candidate", "left_anti").select(*tables["evidence"].columns),
        "duplicates": tables["duplicates"].join(gone, "id", "left_anti").join(copies, "duplicate_of", "left_anti").select(*tables["duplicates"].columns),
    }


def mark_duplicates(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """Writes "duplicate: 0.93 similar to ..." as the reason of duplicates that have none yet.

    ``found`` has id, duplicate_of, similarity.
    """
    reason = F.concat(F.lit("duplicate: "), F.format_string("%.2f", "similarity"), F.lit(" similar to "), F.substring("duplicate_of", 1, 12))
    return candidates.join(found, "id", "left").withColumn("filtered_reason", F.coalesce("filtered_reason", F.when(F.col("duplicate_of").isNotNull(), reason))).drop("duplicate_of", "similarity")


def expired(updated: Column, now_s: int, days: int) -> Column:
    """Whether an ISO time is older than so many days; unreadable ones and 0 days never are."""
    return F.lit(days > 0) & F.coalesce(F.unix_timestamp(F.try_to_timestamp(updated)) < now_s - days * 86400, F.lit(False))
