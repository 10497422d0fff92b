"""Topics, sources, addresses, page health and names: lists of cases as the web has them, dealt over the customers, and each rule as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, text
from ..sources import pages
from .registry import query
from .roles import table

HEADLINES = [
    "Admissions open for 2025 intake", "Seats left after counselling", "Campus drive: 40 students hired", "Recruiters visit for placements", "Hackathon and cultural fest", "Festival of lights celebrated",
    "NIRF rankings announced", "College rated top college in the state", "NAAC accreditation renewed", "Approved by AICTE", "Exam results: topper named", "Merit list out", "New principal appointed",
    "Faculties meet", "Hostel building opens", "Library and labs", "Fee refund promised", "Scholarships for girls", "Students protest fee hike", "FIR filed, police at the gate", "First label of the day",
    "High court stays order", "Research grant and patents", "Journal launched", "New programme introduces AI", "Announcing the symposium", "Weather is fine", "", "Ragging complaint suspended lecturer",
    "Vice-Chancellor's workshop", "Cut-off marks", "Inaugurated by the minister", "show cause notice issued", "A laboratory facility", "Internships and offer letters", "sports meet", "UGC affiliated", "exams",
    "staffs", "launches", "rank 1",
]
QUESTIONS = [
    "What happened on the internet about our college this week?", "placement news", "Tell me the latest hostel fees", "Any protest in March 2024?", "fee fee fees", "who is the new principal of engineering block a", "",
    "AI lab opening dates and faculty list for research scholars", "ಕಾಲೇಜು ಸುದ್ದಿ", "co-ed hostel", "is it", "rankings vs rankings", "NIRF-2024 rank of the institution",
]
URLS = [
    "https://www.facebook.com/CollegeA/", "https://m.facebook.com/profile.php?id=12345678", "https://facebook.com/groups/Alumni/", "https://facebook.com/pages/Some-College/123456789012", "https://fb.com/College-A-1234567",
    "https://www.instagram.com/college_a/", "https://instagram.com/p/Abc123/", "https://twitter.com/CollegeA", "https://x.com/CollegeA/status/1", "https://x.com/search?q=a", "https://www.youtube.com/@CollegeA",
    "https://youtube.com/channel/UCabcDEF", "https://youtube.com/user/CollegeA", "https://www.youtube.com/watch?v=dQw4", "https://youtu.be/dQw4", "https://in.linkedin.com/school/College-A/", "https://www.linkedin.com/feed/",
    "https://threads.net/@CollegeA", "https://wa.me/919876543210", "https://chat.whatsapp.com/AbC", "https://t.me/CollegeA", "https://t.me/joinchat/XyZ", "https://github.com/CollegeA/repo", "https://github.com/topics",
    "https://www.reddit.com/r/CollegeA/", "https://reddit.com/r/CollegeA/comments/abc/title/", "https://reddit.com/u/Someone", "https://linktr.ee/CollegeA", "https://www.snapchat.com/add/CollegeA", "https://pinterest.com/College/board",
    "https://sharechat.com/profile/CollegeA", "https://play.google.com/store/apps/details?id=in.ac.a.app", "https://www.college-a.ac.in/", "https://college-a.ac.in/about?x=2&a=1&utm_source=z", "https://timesofindia.com/college",
    "https://www.shiksha.com/college/a", "https://collegedunia.com/reviews/a", "https://quora.com/What-is-A", "https://ugc.gov.in/list", "https://kea.kar.nic.in/", "https://harvard.edu/", "https://example.org/", "https://deccanherald.com/x",
    "mailto:a@b.c", "https://en.wikipedia.org/wiki/A", "https://open.spotify.com/show/1",
]
HOSTS = ["www.college.ac.in", "roll.org", "corn.co.in", "ab.com", "a1-b0.net", "mmm.edu.in", "x.y.z.com", "hello.in", "b--d.org", "news.co.uk", "olo.in", "burner.com"]
SENTENCES = [
    "Dr. Ravi Kumar G K, the principal, spoke.", "Review by Anil Kumar, 2nd year CSE", "Ramesh Kumar S/O Late Gowda vs State of Karnataka", "Sri Lanka tour", "Sri Siddhartha Institute of Technology opens", "Prof. Anne-Marie D'Souza won",
    "Smt. Lakshmi vs State", "Contact principal Ravi Rao: office hours", "The college opened.", "Priya Sharma (student) joined", "mail dr.ravi@college.org or http://x.org/Dr. Ravi", "Sri Rama Navami festival", "Posted by: Kiran B, faculty",
    "BGSCET vs State Board", "", "Mr. X", "Hon. Justice Rao heard Anil Kumar vs Sunil Kumar", "Shri Nirmala Swami blessed", "the student Asha Devi and HOD Mohan Lal met", "Kum. Asha", "Dr Ravi Kumar's lab",
]


def _sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _dealt(values: list[str]) -> str:
    return f"(select c_custkey, ([{', '.join(map(_sql, values))}])[cast(c_custkey % {len(values)} as integer) + 1] as x from customer)"


def _rows(spark, sf, values: list[str], name: str = "x"):
    x = F.element_at(F.array(*map(F.lit, values)), (F.col("c_custkey") % len(values) + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", x.alias(name))


def _tags_sql(c: str) -> str:
    ways = ", ".join(f"case when regexp_matches(lower({c}), '{text.keyword_pattern(words)}') then '{topic}' end" for topic, words in text.TOPICS.items())
    return f"list_filter([{ways}], lambda t: t is not null)"


@query(f"select c_custkey, {_tags_sql('x')} as tags from {_dealt(HEADLINES)}")
def topic_tags(spark, sf):
    return _rows(spark, sf, HEADLINES).select("c_custkey", text.tags(F.col("x")).alias("tags"))


_STOPS = ", ".join(map(_sql, text.QUESTION_STOPS))
_FOUND = f"list_filter(regexp_extract_all(lower(x), '[a-z\\x{{0C80}}-\\x{{0CFF}}][a-z0-9\\x{{0C80}}-\\x{{0CFF}}-]{{2,}}'), lambda t: t not in ({_STOPS}))"
_TERMS = "list_filter(f, lambda t, i: list_position(f, t) = i)[1:6]"


@query(f"select c_custkey, {_TERMS} as terms from (select c_custkey, {_FOUND} as f from {_dealt(QUESTIONS)})")
def question_terms(spark, sf):
    return _rows(spark, sf, QUESTIONS).select("c_custkey", text.question_terms(F.col("x")).alias("terms"))


@query(
    f"""with q as (select c_custkey, {_TERMS} as terms from (select c_custkey, {_FOUND} as f from {_dealt(QUESTIONS)})), h as (select c_custkey, x, {_tags_sql('x')} as tags from {_dealt(HEADLINES)})
      select c_custkey, case when c_custkey % 5 > 0 then round(least(1.0, 0.4 + case when len(terms) > 0 then 0.4 * len(list_filter(terms, lambda t: contains(lower(x), t))) / len(terms) else 0.2 end
        + case when len(tags) > 0 then 0.1 else 0 end), 3) else 0 end as score, case when c_custkey % 5 > 0 then round(least(1.0, 0.4 + case when len(terms) > 0 then 0.4 * len(list_filter(terms, lambda t: contains(lower(x), t))) / len(terms) else 0.2 end
        + case when list_has_any(tags, ['fees', 'event']) then 0.2 else 0 end), 3) else 0 end as wanted from q join h using (c_custkey)"""
)
def relevance_scores(spark, sf):
    rows = _rows(spark, sf, QUESTIONS, "q").join(_rows(spark, sf, HEADLINES), "c_custkey").withColumns({"terms": text.question_terms(F.col("q")), "tags": text.tags(F.col("x"))})
    score = lambda wanted: text.relevance(F.col("terms"), F.col("x"), F.col("c_custkey") % 5 > 0, F.col("tags"), wanted)
    return rows.select("c_custkey", score(None).alias("score"), score(["fees", "event"]).alias("wanted"))


_HOST = "regexp_replace(regexp_extract(lower(x), '^[a-z]+://([^/?#:]*)', 1), '^www\\.', '')"
_re = lambda values: "|".join(v.replace(".", "[.]") for v in values)
_UNDER = lambda values: f"regexp_matches(host, '(^|[.])({_re(values)})$')"
_CLASS = f"""case when c_custkey % 50 = 49 then 'official_website' when regexp_matches(host || lower(x), '{_re(text.FORUMS)}') then 'public_forum' when {_UNDER(text.SOCIAL)} then 'public_social'
  when {_UNDER(text.PORTALS)} then 'education_portal' when {_UNDER(text.GOVERNMENT)} then case when regexp_matches(host, '({_re(text.ACADEMIC)})$') then 'academic_website' else 'government' end
  when regexp_matches(host, '({_re(text.ACADEMIC)})$') then 'academic_website' when regexp_matches(host, '{_re(text.NEWS)}') then 'news' else 'other_web' end"""


@query(f"select c_custkey, {_CLASS} as source from (select c_custkey, x, {_HOST} as host from {_dealt(URLS)})")
def source_classes(spark, sf):
    return _rows(spark, sf, URLS).select("c_custkey", text.source_class(F.col("x"), F.col("c_custkey") % 50 == 49).alias("source"))


@query(
    f"""with s as (select c_custkey, {_CLASS} as source from (select c_custkey, x, {_HOST} as host from {_dealt(URLS)})), h as (select c_custkey, list_has_any({_tags_sql('x')}, [{', '.join(map(_sql, text.IMPORTANT))}]) as hot from {_dealt(HEADLINES)})
      select c_custkey, case when hot and source in ('official_website', 'government', 'news') then 'high' when hot or source in ('official_website', 'government') then 'medium' else 'low' end as importance from s join h using (c_custkey)"""
)
def finding_importance(spark, sf):
    rows = _rows(spark, sf, URLS, "url").join(_rows(spark, sf, HEADLINES), "c_custkey")
    return rows.select("c_custkey", text.importance(text.source_class(F.col("url"), F.col("c_custkey") % 50 == 49), text.tags(F.col("x"))).alias("importance"))


@query(
    f"""with d as (select c_custkey, {_CLASS} as source, {_tags_sql('h')} as topics from (select u.c_custkey, u.x, h.x as h, {_HOST.replace('(x)', '(u.x)')} as host from {_dealt(URLS)} u join {_dealt(HEADLINES)} h using (c_custkey)))
      select c_custkey, source from d where list_has_any(topics, ['controversy', 'fees']) is not true"""
)
def without_sensitive_topics(spark, sf):
    rows = _rows(spark, sf, URLS, "url").join(_rows(spark, sf, HEADLINES), "c_custkey")
    topics = text.tags(F.col("x"))
    rows = rows.select("c_custkey", text.source_class(F.col("url"), F.col("c_custkey") % 50 == 49).alias("source"), topics.alias("topics"))
    return rows.where(~F.arrays_overlap("topics", F.array(F.lit("controversy"), F.lit("fees")))).drop("topics")


_SITE = "rtrim(regexp_extract(lower(x), '^[a-z]+://([^/?#:]*)', 1), '.')"
for _p in text.HOST_PREFIXES:
    _SITE = f"(select case when starts_with(h, '{_p}') and length(h) - length(replace(h, '.', '')) >= 2 then h[{len(_p) + 1}:] else h end from (select {_SITE} as h))"
_PLATFORM = "case when coalesce(host, '') = '' then null " + " ".join(f"when host = '{s}' or ends_with(host, '.{s}') then '{p}'" for s, p in text.PLATFORM_HOSTS.items()) + " else 'website' end"


@query(f"select c_custkey, {_PLATFORM} as platform from (select c_custkey, {_SITE} as host from {_dealt(URLS)})")
def address_platforms(spark, sf):
    return _rows(spark, sf, URLS).select("c_custkey", text.platform(text.site(F.col("x"))).alias("platform"))


@query()
def account_addresses(spark, sf):
    """The account, group, video or page that each address names; held against a list in the tests."""
    rows = _rows(spark, sf, URLS).withColumn("host", text.site(F.col("x"))).withColumn("platform", text.platform(F.col("host")))
    return rows.select("c_custkey", "x", "platform", text.account_key(F.col("x"), F.col("host"), F.col("platform")).alias("asset_key"))


_TWO = ", ".join(map(_sql, text.TWO_PART_SUFFIXES))
_REGISTRABLE = f"(select case when array_to_string(l[greatest(len(l) - 1, 1):], '.') in ({_TWO}) then array_to_string(l[greatest(len(l) - 2, 1):], '.') else array_to_string(l[greatest(len(l) - 1, 1):], '.') end from (select string_split(x, '.') as l))"


@query(f"select c_custkey, {_REGISTRABLE} as name from {_dealt(HOSTS)}")
def registrable_names(spark, sf):
    return _rows(spark, sf, HOSTS).select("c_custkey", text.registrable(F.col("x")).alias("name"))


_SLIPS = " union all ".join(
    [
        "select own, label[:i-1] || label[i+1:] as s, suffix from p", "select own, label[:i-1] || label[i+1:i+1] || label[i:i] || label[i+2:], suffix from p", "select own, label[:i] || label[i:], suffix from p",
        "select own, label[:i-1] || '-' || label[i:], suffix from p",
        *(f"select own, label[:i-1] || '{b}' || label[i+{len(a)}:], suffix from p where starts_with(label[i:], '{a}')" for a, b in (("o", "0"), ("0", "o"), ("l", "1"), ("1", "l"), ("rn", "m"), ("m", "rn"))),
    ]
)


@query(
    f"""with n as (select distinct {_REGISTRABLE} as own from {_dealt(HOSTS)}), l as (select own, split_part(own, '.', 1) as label, own[length(split_part(own, '.', 1)) + 2:] as suffix from n),
      p as (select own, label, suffix, unnest(range(1, length(label) + 1)) as i from l where length(label) >= 4), s as ({_SLIPS}),
      every as (select own, s || '.' || suffix as variant from s where regexp_matches(s, '^[a-z0-9]([a-z0-9-]*[a-z0-9])?$') and not contains(s, '--') and length(s) <= 63
        union all select own, label || '.' || t from l, (select unnest([{', '.join(map(_sql, text.SUFFIXES))}]) as t) where t <> suffix)
      select distinct own as host, variant from every where variant <> own"""
)
def look_alike_names(spark, sf):
    hosts = _rows(spark, sf, HOSTS).select(text.registrable(F.col("x")).alias("host")).distinct()
    return hosts.select("host", F.explode(text.look_alikes(F.col("host"))).alias("variant"))


@query()
def page_integrity(spark, sf):
    """Every page with its links that lead away, hidden or to spam, and the verdict."""
    own = table(spark, sf, "pages").select("page_id", "html", text.domain(F.col("url")).alias("own"))
    links = pages.page_links(table(spark, sf, "pages")).withColumn("host", text.domain(F.col("target"))).join(own.drop("html"), "page_id")
    away, hidden = F.col("host") != F.col("own"), F.col("area") == "hidden"
    spam = F.col("target").rlike(text.SPAM)
    counted = links.groupBy("page_id").agg(
        F.count("*").alias("links"), F.count_if(away & hidden).alias("hidden_away"),
        F.count_if(away & hidden & (spam | F.col("label").rlike(text.SPAM))).alias("hidden_spam"), F.count_if(away & ~hidden & spam).alias("visible_spam"),
    )
    numbers = ["links", "hidden_away", "hidden_spam", "visible_spam"]
    every = own.join(pages.page_text(table(spark, sf, "pages")), "page_id", "left").join(counted, "page_id", "left").fillna(0, numbers)
    c = F.col
    return every.select("page_id", *numbers, text.integrity(c("html"), c("title"), c("text"), c("hidden_spam"), c("visible_spam"), c("hidden_away")).alias("verdict"))


@query()
def name_redaction(spark, sf):
    """Whole documents without the names of persons."""
    return table(spark, sf, "documents").select("doc_id", names.without_names("text").alias("text"))


@query()
def name_redaction_cases(spark, sf):
    return _rows(spark, sf, SENTENCES).select("c_custkey", "x", names.without_names("x").alias("text"))


_ABS = "cast(abs(v) as varchar)"


@query(
    f"""select event_id, case when v < 0 then '-' else '' end || case when length({_ABS}) <= 3 then {_ABS} else
      ltrim(reverse(regexp_replace(reverse({_ABS}[:length({_ABS}) - 3]), '(..)', '\\1,', 'g')), ',') || ',' || {_ABS}[length({_ABS}) - 2:] end as money
      from (select event_id, case event_id % 4 when 0 then event_id when 1 then event_id * 97 when 2 then -event_id * 9973 else event_id * 99999989 end as v from events)"""
)
def grouped_money(spark, sf):
    v = F.expr("case event_id % 4 when 0 then event_id when 1 then event_id * 97 when 2 then -event_id * 9973 else event_id * 99999989 end")
    return table(spark, sf, "events").select("event_id", text.grouped_number(v.cast("double")).alias("money"))
