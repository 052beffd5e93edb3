"""Mentions out of candidates, and entities out of mentions that carry any number of keys."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltwork.functions import text as T
from siltwork.operators.graph import resolve_entities
from siltwork.operators.ranking import ensure_checkpoint_dir

#: An owner and a repository as a title, sources whose author is the founder, kinds of keys.
REPOSITORY = r"^([A-Za-z0-9][A-Za-z0-9_.-]*)/([A-Za-z0-9_.-]+)$"
FIRST_HAND = ("hackernews", "reddit", "whatsapp")
KEYS = ("domain", "github", "linkedin", "handle")


def extract_mentions(candidates: DataFrame) -> DataFrame:
    """arrival, at, name, kind, domain, github, linkedin, handle, candidate, source, role of all mentions.

    ``candidates`` has arrival, id, source, title, raw_text and author. The owner of a
    repository comes first, then the links of title and text in order, then the author of a
    first-hand post. Links of hosts that name no company are no mention.
    """

    def mention(name, kind, role, **keys) -> F.Column:
        fields = [keys.get(k, F.lit(None).cast("string")).alias(k) for k in KEYS]
        return F.struct(name.alias("name"), kind.alias("kind"), *fields, role.alias("role"))

    owner = F.regexp_extract(F.trim(F.coalesce("title", F.lit(""))), REPOSITORY, 1)
    first = F.when((F.col("source") == "github") & (owner != ""), mention(owner, F.lit("company"), F.lit("founder_of"), github=F.lower(owner)))
    body = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("raw_text", F.lit("")))
    found = F.transform(F.regexp_extract_all(body, F.lit(f"({T.URL})"), 1), lambda u: F.regexp_replace(u, r"[.,)]+$", ""))

    def linked(url: F.Column) -> F.Column:
        handle, domain = T.profile_handle(url), T.company_domain(url)
        person = (handle["kind"] == "linkedin") & url.contains("/in/")
        kind = F.when(person, "person").otherwise("company")
        return F.when(
            handle.isNotNull(),
            mention(handle["value"], kind, F.lit("mentioned"), github=F.when(handle["kind"] == "github", handle["value"]), linkedin=F.when(handle["kind"] == "linkedin", handle["value"])),
        ).when(domain.isNotNull(), mention(domain, F.lit("company"), F.lit("mentioned"), domain=domain))

    writer = F.when((F.coalesce("author", F.lit("")) != "") & F.col("source").isin(*FIRST_HAND), mention(F.col("author"), F.lit("person"), F.lit("author"), handle=F.concat_ws(":", "source", F.lower("author"))))
    rows = candidates.select("arrival", F.col("id").alias("candidate"), "source", F.posexplode(F.array_compact(F.concat(F.array(first), F.transform(found, linked), F.array(writer)))).alias("at", "m"))
    return rows.select("arrival", "at", "m.name", "m.kind", *[f"m.{k}" for k in KEYS], "candidate", "source", "m.role")


def components(edges: DataFrame) -> DataFrame:
    """node, component of an edge list ``u``, ``v`` of texts: the least node reachable.

    Each round takes the least label among neighbours and then that label's label, so rounds
    grow with the logarithm of the longest way. Labels are stored between rounds.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    both = edges.union(edges.select("v", "u")).where("u != v").distinct().checkpoint()
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")).checkpoint()
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("other"))
        lower = labels.join(near, "node").select("node", F.least("label", "other").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = lower.join(jump, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "old").checkpoint()
        labels = new.select("node", "label")
        if new.where("label != old").isEmpty():
            return labels.withColumnRenamed("label", "component")


SALT = 16
PLACED = "what string, key string, at long, entity_id string, created long, kind string, norm string"


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Who holds each key from when on, and which entities are made and which keys they take.

    Events come component by component, in order of arrival; see ``_history``.
    """
    component = None
    entities: list[dict] = []
    holders: dict[str, int] = {}
    named: dict[tuple, list[int]] = {}
    for batch in batches:
        out: list[tuple] = []
        for part, arrival, known, kind, norm, keys in zip(*[batch.column(c).to_pylist() for c in ("component", "arrival", "known", "kind", "norm", "keys")]):
            if part != component:
                component, entities, holders, named = part, [], {}, {}
            hits = [] if known else [holders[k] for k in keys if k in holders]
            if not hits and not known:
                hits = [e for e in named.get((kind, norm), ()) if norm and not (keys and entities[e]["kinds"])]
            if hits:
                at = min(hits)
            else:
                seed = "|".join(sorted(keys)) or f"{kind}:{norm}"
                at = len(entities)
                entities.append({"id": known or hashlib.sha256(seed.encode()).hexdigest()[:32], "created": arrival, "kinds": set()})
                named.setdefault((kind, norm), []).append(at)
                if not known:
                    out.append(("entity", None, arrival, entities[at]["id"], arrival, kind, norm))
            entity = entities[at]
            for key in keys:
                key_kind = key.split(":", 1)[0]
                if key_kind not in entity["kinds"]:
                    entity["kinds"].add(key_kind)
                    if not known:
                        out.append(("taken", key, arrival, entity["id"], entity["created"], kind, norm))
                    if at < holders.get(key, at + 1):
                        holders[key] = at
                        out.append(("holder", key, arrival, entity["id"], entity["created"], kind, norm))
        columns = list(zip(*out)) or [()] * 7
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["what", "key", "at", "entity_id", "created", "kind", "norm"])


def _stored_events(stored: DataFrame, keyed: DataFrame, unkeyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored entities that new mentions can meet: the first holder of each of their keys, and those without a key of their names; and all held keys of interest."""
    known = stored.withColumn("keys", _keys())
    asked = keyed.select(F.explode("keys").alias("key")).distinct()
    held = known.select(F.explode("keys").alias("key"), "first_at", "entity_id").join(asked, "key", "left_semi")
    first = held.groupBy("key").agg(F.min_by("entity_id", "first_at").alias("entity_id"))
    names = keyed.where("norm != ''").select("kind", "norm").unionByName(unkeyed.select("kind", "norm")).distinct()
    bare = known.where("size(keys) = 0 AND norm != ''").join(names, ["kind", "norm"], "left_semi").select("entity_id")
    ids = first.select("entity_id").unionByName(bare).distinct()
    events = known.join(ids, "entity_id", "left_semi").select(F.col("first_at").alias("arrival"), F.col("entity_id").alias("known"), "kind", "norm", "keys")
    return events, first.select("key")


def _keys() -> F.Column:
    """The keys of a row with their kinds, in a fixed order."""
    return F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}:"), F.col(k))) for k in KEYS]))


def _history(mentions: DataFrame, stored: DataFrame | None) -> DataFrame:
    """What ``_replay`` says of all mentions, from a replay of those few that can change anything.

    A mention without keys changes something only as the first of its kind and name, one with
    keys only as the first of its set of keys, or as the first of it after a key of the set got
    an earlier holder. Names bind an event to others only where a mention without keys makes an
    entity: to mentions up to the first whose keys are all new, which is the one that entity
    takes in. So neither a common key nor a common name makes a large component.
    """
    name_node = F.concat_ws(":", F.lit("name"), "kind", "norm")
    keyed = mentions.where("size(keys) > 0").groupBy("kset").agg(F.min("arrival").alias("arrival"), F.min_by("kind", "arrival").alias("kind"), F.min_by("norm", "arrival").alias("norm"), F.first("keys").alias("keys")).checkpoint()
    unkeyed = mentions.where("size(keys) = 0 AND norm != ''").groupBy("kind", "norm").agg(F.min("arrival").alias("u"))
    known = known_keys = None
    if stored is not None:
        unkeyed = unkeyed.join(stored.select("kind", "norm").distinct(), ["kind", "norm"], "left_anti")
        known, known_keys = _stored_events(stored, keyed, unkeyed)
        known = known.checkpoint()
    spread = keyed.select("kset", "arrival", F.explode("keys").alias("key"))
    first = spread.groupBy("key").agg(F.min("arrival").alias("first"))
    if known_keys is not None:
        first = first.join(known_keys, "key", "left_anti")
    fresh = spread.join(first, "key", "left").groupBy("kset").agg(F.bool_and(F.coalesce(F.col("first") == F.col("arrival"), F.lit(False))).alias("fresh"))
    makers = unkeyed if known is None else unkeyed.unionByName(known.where("size(keys) = 0").select("kind", "norm", F.col("arrival").alias("u")))
    named = keyed.join(fresh, "kset").where("norm != ''").join(makers, ["kind", "norm"])
    bound = named.groupBy("kind", "norm").agg(F.bool_or(F.expr("fresh AND arrival < u")).alias("taken"), F.min(F.when(F.expr("fresh AND arrival > u"), F.col("arrival"))).alias("until"))
    live = makers.join(bound, ["kind", "norm"], "left").where("NOT coalesce(taken, false)")
    near = keyed.join(live, ["kind", "norm"]).where("arrival < u OR until IS NULL OR arrival <= until")
    edges = near.select(name_node.alias("u"), F.col("keys")[0].alias("v"))
    edges = edges.unionByName(keyed.where("size(keys) > 1").select(F.col("keys")[0].alias("u"), F.explode(F.slice("keys", F.lit(2), F.size("keys"))).alias("v")))
    columns = ["node", "arrival", "known", "kind", "norm", "keys"]
    none = F.lit(None).cast("string").alias("known")
    events = keyed.select(F.col("keys")[0].alias("node"), "arrival", none, "kind", "norm", "keys")
    events = events.unionByName(live.join(unkeyed.select("kind", "norm"), ["kind", "norm"], "left_semi").select(name_node.alias("node"), F.col("u").alias("arrival"), none, "kind", "norm", F.array().cast("array<string>").alias("keys")))
    if known is not None:
        edges = edges.unionByName(known.where("size(keys) > 1").select(F.col("keys")[0].alias("u"), F.explode(F.slice("keys", F.lit(2), F.size("keys"))).alias("v")))
        events = events.unionByName(known.select(F.coalesce(F.get("keys", F.lit(0)), name_node).alias("node"), "arrival", "known", "kind", "norm", "keys"))
    found = components(edges)
    events = events.select(*columns).checkpoint()
    many = mentions.where("size(keys) > 1").select("kset", "arrival", "kind", "norm", "keys")
    parts = int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        placed = events.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        dealt = placed.repartition(parts, "component").sortWithinPartitions("component", "arrival")
        history = dealt.select("component", *columns[1:]).mapInArrow(_replay, PLACED).checkpoint()
        holders = history.where("what = 'holder'")
        later = keyed.where("size(keys) > 1").select("kset", "arrival", F.explode("keys").alias("key")).join(holders.select("key", "at"), "key").where("at > arrival")
        changes = later.select("kset", "at").distinct()
        again = many.join(changes, "kset").where("arrival > at").groupBy("kset", "at").agg(F.min_by(F.struct("arrival", "kind", "norm", "keys"), "arrival").alias("m")).select("m.*").distinct()
        fresh_events = again.join(events.select("arrival"), "arrival", "left_anti").select(F.col("keys")[0].alias("node"), "arrival", none, "kind", "norm", "keys").checkpoint()
        if fresh_events.isEmpty():
            return history
        events = events.unionByName(fresh_events)


def _placements(mentions: DataFrame, history: DataFrame, stored: DataFrame | None) -> DataFrame:
    """arrival, entity_id, created, by_name of all mentions: keys as of their time, names by their first entity."""
    turn = Window.partitionBy("key").orderBy("at")
    holders = history.where("what = 'holder'").select("key", "at", F.lead("at").over(turn).alias("until"), "entity_id", "created")
    holders = holders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    asked = mentions.select("arrival", F.explode("keys").alias("key"), F.pmod(F.xxhash64("arrival"), F.lit(SALT)).cast("int").alias("salt"))
    held = asked.join(holders, ["key", "salt"]).where("at <= arrival AND (until IS NULL OR arrival < until)")
    keyed = held.groupBy("arrival").agg(F.min(F.struct("created", "entity_id")).alias("e")).select("arrival", "e.entity_id", F.lit(False).alias("by_name"))
    names = history.where("what = 'entity'").select("kind", "norm", "created", "entity_id")
    if stored is not None:
        names = names.unionByName(stored.select("kind", "norm", F.col("first_at").alias("created"), "entity_id"))
    names = names.where("norm != ''").groupBy("kind", "norm").agg(F.min("created").alias("created"), F.min_by("entity_id", "created").alias("entity_id"))
    names = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    bare = mentions.where("size(keys) = 0").select("arrival", "kind", "norm", F.pmod(F.xxhash64("arrival"), F.lit(SALT)).cast("int").alias("salt"))
    nameless = F.substring(F.sha2(F.concat("kind", F.lit(":")), 256), 1, 32)
    unkeyed = bare.join(names, ["kind", "norm", "salt"], "left").select("arrival", F.coalesce("entity_id", nameless).alias("entity_id"), F.coalesce(F.col("arrival") != F.col("created"), F.lit(False)).alias("by_name"))
    return keyed.unionByName(unkeyed)


def _rolled(placed: DataFrame) -> DataFrame:
    return placed.groupBy("entity_id").agg(
        F.min_by("kind", "arrival").alias("kind"),
        F.min_by("name", "arrival").alias("name"),
        F.min_by("norm", "arrival").alias("norm"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.min("arrival").alias("first_at"),
        F.max("arrival").alias("last_at"),
        F.max_by("by_name", "arrival").alias("needs_review"),
    )


def _prepared(mentions: DataFrame) -> DataFrame:
    keys = _keys()
    return mentions.withColumn("norm", F.coalesce("norm", F.lit(""))).withColumns({"keys": keys, "kset": F.array_join(keys, "\x01")})


ENTITY = ["entity_id", "kind", "name", "norm", *KEYS, "sources", "first_at", "last_at", "needs_review"]


def resolve_more(mentions: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities that new mentions make or change, and their evidence, given the stored entities.

    ``mentions`` as in ``resolve``; all arrive after what is stored. ``stored`` has the columns
    of ``ENTITY`` (sources as an array), or is None. The first table has these columns, one row
    per entity met; the second entity_id and candidate, each once. Batches one after the other
    give what ``resolve`` gives of all at once. An empty batch changes nothing.
    """
    ensure_checkpoint_dir(mentions.sparkSession)
    given = _prepared(mentions).checkpoint()
    history = _history(given, stored)
    placed = given.join(_placements(given, history, stored), "arrival").checkpoint()
    rolled = _rolled(placed)
    value = lambda k: F.when(F.substring_index("key", ":", 1) == k, F.expr(f"substring(key, {len(k) + 2})"))
    took = history.where("what = 'taken'").groupBy("entity_id").agg(*[F.max(value(k)).alias(k) for k in KEYS])  # one per kind
    new = rolled.join(took, "entity_id", "left")
    if stored is not None:
        old = stored.select("entity_id", *[F.col(c).alias(f"old_{c}") for c in ENTITY[1:]])
        new = new.join(old, "entity_id", "left")
        first = {c: F.coalesce(f"old_{c}", c) for c in ("kind", "name", "norm", *KEYS, "first_at")}
        sources = F.array_sort(F.array_distinct(F.concat(F.coalesce("old_sources", F.array().cast("array<string>")), "sources")))
        new = new.withColumns(first | {"sources": sources})
    evidence = placed.where("candidate IS NOT NULL").select("entity_id", "candidate").distinct()
    return new.select(*ENTITY), evidence


def resolve(mentions: DataFrame) -> DataFrame:
    """entity_id, kind, name, sources, mentions, first_at, last_at, needs_review of all mentions.

    ``mentions`` has arrival (unique), kind, name, norm, source, candidate and the keys domain,
    github, linkedin and handle. A mention goes to the earliest entity that holds one of its
    keys; else to the earliest of its kind and name, unless both have keys; else it makes one
    of its own. An entity takes the first key of each kind it meets. Only mentions that can
    change an entity are replayed in order, component by component; all others, however many
    share a key or a name, are placed by joins.
    """
    marked = _prepared(mentions)
    if marked.where("size(keys) > 1").isEmpty():
        return resolve_entities(marked.select("arrival", "kind", "name", "norm", F.get("keys", F.lit(0)).alias("key"), "source", "candidate"))
    rolled, evidence = resolve_more(mentions)
    counts = evidence.groupBy("entity_id").agg(F.count(F.lit(1)).alias("mentions"))
    return rolled.join(counts, "entity_id", "left").select("entity_id", "kind", "name", F.array_join("sources", ",").alias("sources"), F.coalesce("mentions", F.lit(0)).alias("mentions"), "first_at", "last_at", "needs_review")
