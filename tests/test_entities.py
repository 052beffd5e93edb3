"""Entities of mentions with several keys, one after the other, and mentions out of candidates."""

import hashlib
import random

from siltwork.operators.entities import ENTITY, KEYS, extract_mentions, resolve, resolve_more

SCHEMA = "arrival long, kind string, name string, norm string, domain string, github string, linkedin string, handle string, source string, candidate string"


def one_by_one(rows):
    """The rule as a plain loop over all entities."""
    entities = []
    for r in sorted(rows):
        arrival, kind, name, norm, *keys, source, candidate = r
        mine = {k: v for k, v in zip(KEYS, keys) if v}
        hit = next((e for e in entities if any(e["keys"].get(k) == v for k, v in mine.items())), None)
        by_name = None
        if hit is None and norm:
            by_name = next((e for e in entities if (e["kind"], e["norm"]) == (kind, norm) and not (mine and e["keys"])), None)
        e = hit or by_name
        if e is None:
            seed = "|".join(sorted(f"{k}:{v}" for k, v in mine.items())) or f"{kind}:{norm}"
            number = hashlib.sha256(seed.encode()).hexdigest()[:32]
            e = next((x for x in entities if x["id"] == number), None)  # those without name and key are one
        if e is None:
            e = {"id": number, "kind": kind, "norm": norm, "name": name, "keys": {}, "sources": set(), "seen": set(), "first": arrival}
            entities.append(e)
            e["review"] = False
        else:
            e["review"] = by_name is not None and not mine
        for k, v in mine.items():
            e["keys"].setdefault(k, v)
        e["sources"].add(source)
        e["seen"].add(candidate)
        e["last"] = arrival
    return sorted((e["id"], e["kind"], e["name"], ",".join(sorted(e["sources"])), len(e["seen"]), e["first"], e["last"], e["review"]) for e in entities)


def found(spark, rows):
    cols = ["entity_id", "kind", "name", "sources", "mentions", "first_at", "last_at", "needs_review"]
    return sorted(tuple(r) for r in resolve(spark.createDataFrame(rows, SCHEMA)).select(*cols).collect())


def test_named_cases(spark):
    rows = [
        (1, "company", "Acme", "acme", "acme.com", None, None, None, "reddit", "c1"),
        (2, "company", "ACME Inc", "acme", "acme.com", "acmehq", None, None, "github", "c2"),
        (3, "company", "Acme", "acme", "acme.io", None, None, None, "reddit", "c3"),
        (4, "company", "Acme", "acme", None, None, None, None, "whatsapp", "c4"),
        (5, "person", "Acme", "acme", None, None, None, None, "whatsapp", "c4"),
        (6, "company", "acmehq", "acmehq", None, "acmehq", None, None, "github", "c5"),
        (7, "person", "ann", "ann", None, None, None, "reddit:ann", "reddit", "c6"),
    ]
    assert found(spark, rows) == one_by_one(rows)


def test_random_mentions(spark):
    r = random.Random(5)
    for _ in range(2):
        rows = []
        for i in range(150):
            name = f"n{r.randrange(25)}"
            keys = [f"{k}{r.randrange(30)}" if r.random() < 0.3 else None for k in KEYS]
            rows.append((i, r.choice(("person", "company")), name.upper(), name, *keys, r.choice(("a", "b")), f"c{r.randrange(60)}"))
        assert found(spark, rows) == one_by_one(rows)


def test_extraction(spark):
    rows = [
        (1, "c1", "github", "Acme-HQ/rocket", "see https://acme.com/a. and (https://github.com/Acme-HQ/x)", "bob"),
        (2, "c2", "reddit", None, "https://www.linkedin.com/in/Ann-Lee/ https://linkedin.com/company/zed https://medium.com/p https://x.vercel.app", "Ann"),
        (3, "c3", "hackernews", "no links", None, None),
        (4, "c4", "substack", "a/b/c", "nothing", "writer"),
    ]
    got = extract_mentions(spark.createDataFrame(rows, "arrival long, id string, source string, title string, raw_text string, author string"))
    listed = sorted((m.arrival, m["at"], m.kind, m.name, m.domain, m.github, m.linkedin, m.handle, m.role) for m in got.collect())
    assert listed == [
        (1, 0, "company", "Acme-HQ", None, "acme-hq", None, None, "founder_of"),
        (1, 1, "company", "acme.com", "acme.com", None, None, None, "mentioned"),
        (1, 2, "company", "acme-hq", None, "acme-hq", None, None, "mentioned"),
        (2, 0, "person", "ann-lee", None, None, "ann-lee", None, "mentioned"),
        (2, 1, "company", "zed", None, None, "zed", None, "mentioned"),
        (2, 2, "person", "Ann", None, None, None, "reddit:ann", "author"),
    ]


def random_mentions(seed, n, names=12, values=9, share=0.3):
    r, rows = random.Random(seed), []
    for i in range(n):
        name = f"n{r.randrange(names)}" if r.random() < 0.95 else ""
        keys = [f"{k}{r.randrange(values)}" if r.random() < share else None for k in KEYS]
        rows.append((i, r.choice(("person", "company")), name.upper(), name, *keys, r.choice(("a", "b")), f"c{r.randrange(60)}" if r.random() < 0.9 else None))
    return rows


def with_candidates(rows):
    """The plain loop counts a missing candidate as one more; the tables do not."""
    return [(*r[:-1], f"only{r[0]}" if r[-1] is None else r[-1]) for r in rows]


def test_batches_equal_the_whole(spark):
    for seed, share in ((2, 0.5),):
        rows = with_candidates(random_mentions(seed, 200, share=share))
        want = one_by_one(rows)
        assert found(spark, rows) == want
        stored, evidence = None, []
        for a, b in ((0, 70), (70, 70), (70, 150), (150, 200)):
            changed, more = resolve_more(spark.createDataFrame(rows[a:b], SCHEMA), stored)
            changed, evidence = {r["entity_id"]: r for r in changed.collect()}, evidence + [tuple(r) for r in more.collect()]
            if stored is not None:
                changed = {r["entity_id"]: r for r in stored.collect()} | changed
            kind = "entity_id string, kind string, name string, norm string, domain string, github string, linkedin string, handle string, sources array<string>, first_at long, last_at long, needs_review boolean"
            stored = spark.createDataFrame([tuple(r[c] for c in ENTITY) for r in changed.values()], kind)
        counts = {}
        for entity, candidate in evidence:
            counts.setdefault(entity, set()).add(candidate)
        got = [(r["entity_id"], r["kind"], r["name"], ",".join(r["sources"]), len(counts[r["entity_id"]]), r["first_at"], r["last_at"], r["needs_review"]) for r in stored.collect()]
        assert sorted(got) == want


def test_a_common_name(spark):
    """One name of 200,000 mentions, half of them with keys of their own, and one key of a third of them."""
    from pyspark.sql import functions as F

    null = F.lit(None).cast("string")
    n = F.col("id")
    rows = spark.range(200_000).select(
        n.alias("arrival"), F.lit("company").alias("kind"), F.lit("App").alias("name"), F.lit("app").alias("norm"),
        F.when(n % 3 == 1, F.concat(F.lit("d"), n)).when(n % 3 == 2, F.lit("hot")).alias("domain"), F.when(n % 1000 == 2, F.concat(F.lit("g"), n % 7)).alias("github"),
        null.alias("linkedin"), null.alias("handle"), F.lit("s").alias("source"), F.concat(F.lit("c"), n).alias("candidate"),
    )
    got = resolve(rows).collect()
    assert sum(r["mentions"] for r in got) == 200_000
    small = [tuple(r) for r in rows.where("arrival < 2500").collect()]
    assert found(spark, small) == one_by_one(small)


def test_stream_goes_on(spark, tmp_path):
    """Files of mentions that arrive between runs, and a run without any."""
    from siltwork.streaming.entities import resolve_arriving

    rows = with_candidates(random_mentions(4, 120, share=0.4))
    for a, b in ((0, 60), (60, 120), (120, 120)):
        if b > a:
            spark.createDataFrame(rows[a:b], SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        got = resolve_arriving(stream, str(tmp_path / "state"))
        assert sorted((r["entity_id"], r["kind"], r["name"], r["sources"], r["mentions"], r["first_at"], r["last_at"], r["needs_review"]) for r in got.collect()) == one_by_one(rows[:b])
