"""Addresses, names of persons, page health and passages against lists of expected results."""

from pyspark.sql import functions as F

from millrace.functions import names, passages, text
from millrace.operators import rank
from millrace.plans import catalog, web
from millrace.sources import pages

KEYS = [
    "facebook:collegea", "facebook:id:12345678", "facebook:group:alumni", "facebook:id:123456789012", "facebook:id:1234567", "instagram:college_a", "page:https://instagram.com/p/Abc123", "x:collegea",
    "page:https://x.com/CollegeA/status/1", "page:https://x.com/search?q=a", "youtube:@collegea", "youtube:channel:UCabcDEF", "youtube:user:collegea", "youtube:video:dQw4", "youtube:video:dQw4",
    "linkedin:school:college-a", "page:https://linkedin.com/feed", "threads:collegea", "whatsapp:919876543210", "whatsapp:group:AbC", "telegram:collegea", "telegram:group:XyZ", "github:collegea",
    "page:https://github.com/topics", "reddit:r:collegea", "reddit:post:abc", "reddit:u:someone", "linktree:collegea", "snapchat:collegea", "pinterest:college/board", "sharechat:collegea",
    "google_play:app:in.ac.a.app", "web:college-a.ac.in", "page:https://college-a.ac.in/about?a=1&x=2", "page:https://timesofindia.com/college", "page:https://shiksha.com/college/a",
    "page:https://collegedunia.com/reviews/a", "page:https://quora.com/What-is-A", "page:https://ugc.gov.in/list", "web:kea.kar.nic.in", "web:harvard.edu", "web:example.org",
    "page:https://deccanherald.com/x", None, "page:https://en.wikipedia.org/wiki/A", "page:https://open.spotify.com/show/1",
]
WITHOUT = {
    "Dr. Ravi Kumar G K, the principal, spoke.": "[name], the principal, spoke.",
    "Ramesh Kumar S/O Late Gowda vs State of Karnataka": "[name] S/O Late [name] vs State of Karnataka",
    "Sri Siddhartha Institute of Technology opens": "Sri Siddhartha Institute of Technology opens",
    "Sri Rama Navami festival": "Sri Rama Navami festival",
    "Priya Sharma (student) joined": "[name] (student) joined",
    "mail dr.ravi@college.org or http://x.org/Dr. Ravi": "mail dr.ravi@college.org or http://x.org/Dr. Ravi",
    "Hon. Justice Rao heard Anil Kumar vs Sunil Kumar": "Hon. Justice Rao heard [name] vs [name]",
    "Dr Ravi Kumar's lab": "[name]'s lab",
    "x" * 100_000 + " Dr. Anna Lee": "x" * 100_000 + " [name]",
}


def test_addresses_name_accounts(spark):
    rows = spark.createDataFrame(list(enumerate(web.URLS)), "i int, x string").withColumn("h", text.site(F.col("x"))).withColumn("p", text.platform(F.col("h")))
    assert [r.k for r in rows.orderBy("i").select(text.account_key(F.col("x"), F.col("h"), F.col("p")).alias("k")).collect()] == KEYS


def test_names_of_persons_go_and_others_stay(spark):
    rows = spark.createDataFrame(list(enumerate([*WITHOUT, None, ""])), "i int, x string")
    assert [r.y for r in rows.orderBy("i").select(names.without_names("x").alias("y")).collect()] == [*WITHOUT.values(), None, ""]
    assert names.redacted("Dr. Nirmala Rao spoke", frozenset({"nirmala", "rao"})) == "Dr. Nirmala Rao spoke"


def test_redacted_documents_are_otherwise_whole(spark):
    before = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in catalog.QUERIES["name_redaction"](spark, "/root/testdata/sf0.001").collect():
        assert r.text == before[r.doc_id] or "[name]" in r.text


def page(n_hidden, href, body="", title="t"):
    links = "".join(f'<a style="display: none" href="{href}{i}">x</a>' for i in range(n_hidden))
    return f"<html><title>{title}</title><body>{body}{links}<p>{'words ' * 100}</p></body></html>"


def test_page_verdicts(spark, tmp_path):
    made = {
        1: (page(0, ""), "clean"), 2: (page(4, "http://o.com/"), "clean"), 3: (page(5, "http://o.com/"), "suspect"), 4: (page(1, "http://rolex.com/"), "compromised"), 5: (page(0, "", title="Situs Gacor"), "hijacked"),
        6: (page(0, "", body="This domain is for sale"), "parked"), 7: (None, "clean"), 8: ("".join(f'<a href="http://casino{i}.com">x</a>' for i in range(3)), "compromised"),
    }
    spark.createDataFrame([(i, f"http://own{i}.org/", h) for i, (h, _) in made.items()], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.verdict for r in catalog.QUERIES["page_integrity"](spark, str(tmp_path)).collect()}
    assert got == {i: v for i, (_, v) in made.items()}
    links = pages.page_links(spark.read.parquet(f"{tmp_path}/pages.parquet")).where("page_id = 3").orderBy("position").collect()
    assert [(r.area, r.target) for r in links] == [("hidden", f"http://o.com/{i}") for i in range(5)]
    texts = {r.page_id: (r.title, r.text) for r in pages.page_text(spark.read.parquet(f"{tmp_path}/pages.parquet")).collect()}
    assert texts[5][0] == "Situs Gacor" and texts[6][1].startswith("This domain is for sale") and texts[7] == ("", "")


def test_chunks():
    assert passages.chunks_of("") == [] and passages.chunks_of(" a  b.\n\n\n c ") == ["a b. c"]
    long = passages.chunks_of("x" * 2000)
    assert [len(c) for c in long] == [900, 900, 500] and long[1][:150] == long[0][-150:]
    heading = passages.chunks_of("Title\n\n" + "word " * 170 + ". Then more text follows here. " * 3)
    assert heading[0].startswith("Title word") and all(len(c) <= 900 for c in heading)


def test_embeddings_are_of_length_one_and_like_for_like(spark):
    rows = spark.createDataFrame([("fees and hostel fees",), ("hostel fees",), ("the of",), (None,)], "x string").select(passages.embedded("x").alias("v")).collect()
    a, b, c, d = (r.v for r in rows)
    dot = lambda x, y: sum(i * j for i, j in zip(x, y, strict=True))
    assert abs(dot(a, a) - 1) < 1e-9 and dot(a, b) > 0.5 and not any(c) and not any(d) and len(a) == 512


def test_search_and_rerank_agree_with_a_plain_version(spark):
    docs = [(1, "hostel fees are due in June. " * 3), (2, "library opens at nine"), (3, "fees of the hostel and the library"), (4, None), (5, "")]
    asked = [(1, "hostel fees"), (2, "when does the library open"), (3, "")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string")
    got = rank.hybrid_search(d, q, "doc_id", "text", "item_id", "text", 2)
    for item, question in asked:
        want = []
        for key, body in docs:
            for i, p in enumerate(passages.chunks_of(body)):
                like = sum(x * y for x, y in zip(passages.embedding(p), passages.embedding(question), strict=True))
                t = set(rank.tokens_of(question))
                score = round(0.7 * like + (0.3 * len(t & set(rank.tokens_of(p))) / len(t) if t else 0), 6)
                want += [(-score, key, i)] if score > 0 else []
        assert [(r.doc_id, r.place) for r in got.where(F.col("item_id") == item).orderBy("rank").collect()] == [w[1:] for w in sorted(want)[:2]]
    top = rank.retrieve(d, q, "doc_id", "text", "item_id", "text").where("item_id = 1").orderBy("rank").collect()
    assert top[0].doc_id == 1 and top[0].reranked == 1.0  # the best BM25, every term and every pair of words
    said = rank.answers(rank.retrieve(d, q, "doc_id", "text", "item_id", "text"), "item_id", "doc_id").where("item_id = 1").first()
    assert said.citations[0] == "[doc-1:page 1]" and said.answer.startswith("1. hostel fees are due")


def test_equal_passages_of_a_task_go_by_the_order_of_their_keys(spark):
    docs = spark.createDataFrame([(k, "Fees of the college are due in June.") for k in (10, 9, 100)] + [(None, "Other words.")], "doc_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(1, "college fees in June"), (2, "nothing")], "item_id long, text string")
    got = rank.hybrid_search(docs, asked, "doc_id", "text", "item_id", "text", 2).orderBy("rank").collect()
    assert [(r.item_id, r.doc_id, r["rank"]) for r in got] == [(1, 9, 1), (1, 10, 2)]


def test_platforms_by_the_last_labels_are_those_of_all_names(spark):
    hosts = ["", None, "com", ".com", "t.me", "at.me", "a.t.me", "x.com", "max.com", "play.google.com", "google.com", "a.play.google.com", "gdg.community.dev", "community.dev", "www.www.x.com", "m.in.x.com", "in.m.x.com", "web.x", "web.com", "business.fb.com."]
    rows = spark.createDataFrame([(h, f"https://{h}/a") for h in hosts], "h string, x string").withColumns({"p": text.platform(F.col("h")), "s": text.site(F.col("x"))})
    for r in rows.collect():
        want = next((p for n, p in text.PLATFORM_HOSTS.items() if r.h == n or r.h and r.h.endswith("." + n)), "website") if r.h else None
        host = (r.h or "None").lower().rstrip(".")
        for p in text.HOST_PREFIXES:
            if host.startswith(p) and "." in host[len(p) :]:
                host = host[len(p) :]
        assert r.p == want and r.s in (host, None), r
    plan = rows.select(text.platform(text.site(F.col("x"))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("HOST") < 12  # the address is not parsed for each platform


def test_tasks_of_the_hybrid_search_do_not_grow_with_the_documents(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "concat('library and hostel block ', id) as text").repartition(300)
    asked = spark.createDataFrame([(1, "hostel block 17")], "q long, text string")
    found = rank.hybrid_search(docs, asked, "doc_id", "text", "q", "text", 3)
    assert f"Coalesce {rank.TASKS_A_CORE * spark.sparkContext.defaultParallelism}" in found._jdf.queryExecution().sparkPlan().toString()
    assert [r.doc_id for r in found.where("rank = 1").collect()] == [17]
