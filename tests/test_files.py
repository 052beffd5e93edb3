"""Readers of dropped files, and the shipped rules on plain English cases."""

import zipfile

from pyspark.sql import functions as F

from siltwork.functions import text as T
from siltwork.operators.filters import reject
from siltwork.sources import files as R
from siltwork.sources.chats import parse_chats

ANDROID = "12/09/2026, 10:01 - Ann: hello\nsecond line\n12/09/2026, 10:02 - Messages are end-to-end encrypted\ngoes on\n12/09/2026, 10:03 - Bob: <Media omitted>\n12/09/2026, 10:04 - Bob: see https://x.io: now\n"
IOS = "[2026-09-12, 10:01:22] Cem: ‎we launched\n[2026-09-12, 10:02:00] Cem: null\n"


def test_chat_exports(spark, tmp_path):
    (tmp_path / "WhatsApp Chat with Deals.txt").write_text(ANDROID)
    with zipfile.ZipFile(tmp_path / "Founders_chat.zip", "w") as z:
        z.writestr("photo.jpg", b"x")
        z.writestr("_chat.txt", IOS)
    with zipfile.ZipFile(tmp_path / "empty.zip", "w") as z:
        z.writestr("photo.jpg", b"x")
    got = sorted((r.chat, r.sender, r.sent_at, r.text, r.line_no) for r in parse_chats(R.chat_exports(spark, str(tmp_path))).collect())
    assert got == [
        ("Deals", "Ann", "12/09/2026, 10:01", "hello\nsecond line\ngoes on", 1),
        ("Deals", "Bob", "12/09/2026, 10:04", "see https://x.io: now", 6),
        ("Founders", "Cem", "2026-09-12, 10:01:22", "we launched", 1),
    ]


def test_mails(spark, tmp_path):
    (tmp_path / "fund").mkdir()
    (tmp_path / "fund" / "a lead.eml").write_bytes(b"Subject: Acme raises\r\nFrom: Ann <ann@acme.io>\r\nDate: Sat, 12 Sep 2026 10:00:00 +0000\r\nContent-Type: text/plain\r\n\r\nWe build rockets.\r\n\r\nSent from my phone\r\n")
    (tmp_path / "fund" / "b.eml").write_bytes(b'From: Bob\r\nMIME-Version: 1.0\r\nContent-Type: multipart/alternative; boundary="x"\r\n\r\n--x\r\nContent-Type: text/html\r\n\r\n<p>no</p>\r\n--x\r\nContent-Type: text/plain\r\n\r\nplain part\r\n--x--\r\n')
    got = sorted((r.source_url, r.title, r.author, r.node, r.raw_text, r.posted_at) for r in R.mails(spark, str(tmp_path)).collect())
    assert got == [
        ("inbound://a lead.eml", "Acme raises", "Ann <ann@acme.io>", "fund", "Acme raises\n\nWe build rockets.", "Sat, 12 Sep 2026 10:00:00 +0000"),
        ("inbound://b.eml", "b", "Bob", "fund", "b\n\nplain part", None),
    ]


def test_forms(spark, tmp_path):
    path = tmp_path / "form.csv"
    path.write_text('Timestamp,Company name,What do you do?,Website,Founder email,Round\n1,Acme,"Rockets, cheap",https://acme.io,ann@acme.io,seed\n2,,,x,y,z\n3,,Only a pitch,,,\n')
    got = [(r.source_url, r.title, r.author, r.raw_text) for r in R.forms(R.numbered_csv(spark, str(path)), "form.csv").collect()]
    assert got == [("inbound://form.csv#2", "Acme", "ann@acme.io", "Acme\n\nRockets, cheap\n\nhttps://acme.io\n\nseed\n\nann@acme.io"), ("inbound://form.csv#4", "Only a pitch", "", "Only a pitch")]


def test_labels_and_profiles(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text("similarity,label\n0.5,Yes\n0.25,n\n0.1,\n0.75, 1 \n")
    assert [tuple(r) for r in R.label_rows(R.numbered_csv(spark, str(path))).collect()] == [(0.5, 1), (0.25, 0), (0.75, 1)]
    path = tmp_path / "people.csv"
    path.write_text("Full Name,Title,skills,profile_url,Experience\nAnn,CEO,\"sql, rust;\",https://x.io/a,\"one;two\"\n,nobody,,,\nBob,,,ftp://no,\n")
    good, bad = R.imported_profiles(R.numbered_csv(spark, str(path)))
    assert [(r.name, r.headline, r.skills, r.experience, r.posts) for r in good.collect()] == [("Ann", "CEO", ["sql", "rust"], ["one", "two"], [])]
    assert [tuple(r) for r in bad.orderBy("row").collect()] == [(2, "name is required"), (3, "profile_url must be an address")]
    texts = spark.createDataFrame([('{"name": "Ann"}',), (' [{"name": "Bob"}, {"name": "Cem"}]',), ("broken",)], "body string")
    assert sorted(r.name or "" for r in R.json_profiles(texts, "struct<name:string>").collect()) in (["Ann", "Bob"], ["", "Ann", "Bob"])


def test_theses(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"id": 212, "name": 212, "prose": "B2B", "exclude": ["idea stage"], "weights": {"timing": 1}}')
    (tmp_path / "a.json").write_text('{"id": "a", "report_fields": [{"key": "k", "label": "K"}]}')
    got = [(r.id, r.name, r.prose, r.exclude, r.weights, r.ord) for r in R.theses(spark, str(tmp_path)).orderBy("ord").collect()]
    assert got == [("a", "a", "", [], {}, 0), ("212", "212", "B2B", ["idea stage"], {"timing": 1.0}, 1)]


def test_shipped_rules(spark):
    now = 1789171200
    cases = [
        ("I built a tool that reconciles invoices for small firms and we launched last week.", now, None),
        ("We're hiring a senior engineer, remote position, competitive salary, apply now please.", now, "job_ad"),
        ("Black Friday: use this coupon for a discount code on everything in our shop, buy now!", now, "promo"),
        ("Ask HN: how do people find the first ten customers for a new developer tool?", now, "question"),
        ("Ask HN: I built a scheduler for clinics, what would you want from it before paying?", now, None),
        ("x" * 39, now, "too_short"),
        ("A long enough text about nothing in particular that is simply very old by now.", now - 900 * 86400, "too_old"),
        ("A long enough text about nothing in particular without any date at all to go by.", None, None),
    ]
    rows = spark.createDataFrame([(i, t, p) for i, (t, p, _) in enumerate(cases)], "i int, text string, posted long")
    got = [r.reason for r in rows.select("i", reject(F.col("text"), F.col("posted"), now).alias("reason")).orderBy("i").collect()]
    assert got == [c[2] for c in cases]


def test_shipped_redaction_and_addresses(spark):
    rows = spark.createDataFrame([("Mail ann@acme.io or +1 (555) 010-9999  now, @ann.\nWe launched rockets. Nothing here.",)], "text string")
    got = rows.select(T.scrub(F.col("text")).alias("s"), T.fragment(F.col("text"), names=("rockets",)).alias("f")).first()
    assert got.s == "Mail [email] or [phone] now, [handle]\nWe launched rockets. Nothing here."
    assert got.f == "We launched [name]."
    urls = {"https://www.acme.com/x": ("acme.com", None), "https://acme.substack.com": (None, None), "https://github.com/Acme/x": (None, ("github", "acme")), "https://linkedin.com/company/Zed/": (None, ("linkedin", "zed")), "no url": (None, None)}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", T.company_domain(F.col("u")).alias("d"), T.profile_handle(F.col("u")).alias("h"))
    assert {r.u: (r.d, tuple(r.h) if r.h else None) for r in rows.collect()} == urls
