"""Text expressions: tokens, tags, addresses, sources, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a query.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this",
    "to", "was", "were", "what", "when", "which", "with",
)
#: Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref")


def tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 in lower case, longer than one, less stop words; repeats stay."""
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


#: Topics and their keywords; one that ends with * is a stem, others may take s or es.
TOPICS = {
    "admission": ("admission", "apply", "application", "intake", "seat", "counselling", "counseling", "cutoff", "cut-off", "eligibility"),
    "placement": ("placement", "recruit*", "package", "hired", "campus drive", "internship", "offer letter"),
    "event": ("event", "fest*", "seminar", "workshop", "conference", "celebrat*", "inaugurat*", "webinar", "hackathon", "cultural", "sports meet", "symposium"),
    "ranking": ("rank*", "nirf", "rated", "top college"),
    "accreditation": ("naac", "nba", "accredit*", "autonomous", "affiliat*", "approved by", "ugc", "aicte"),
    "results": ("result", "topper", "pass percentage", "exam", "examination", "merit"),
    "faculty": ("facult*", "professor", "lecturer", "staff", "appointed", "principal", "vice chancellor", "vice-chancellor", "hod"),
    "campus": ("campus", "hostel", "infrastructure", "librar*", "lab", "laborator*", "building", "facilit*"),
    "fees": ("fee", "scholarship", "tuition", "refund"),
    "controversy": (
        "protest*", "complaint", "allegation", "alleged", "fir", "police", "strike", "suspend*", "suspension", "ragging", "harass*", "fraud*",
        "high court", "supreme court", "court order", "court case", "show-cause notice", "show cause notice", "petition",
    ),
    "research": ("research", "patent", "publication", "journal", "grant", "innovation"),
    "announcement": ("announce*", "launch*", "new program", "new programme", "new course", "starts", "introduces"),
}
IMPORTANT = ("accreditation", "ranking", "controversy", "announcement", "admission", "placement")
#: Domains of source classes, in the order in which they are tried, and marks of news sites.
FORUMS = ("reddit.com", "quora.com", "shiksha.com/forum", "collegedunia.com/reviews", "pagalguy.com")
SOCIAL = ("facebook.com", "instagram.com", "twitter.com", "x.com", "linkedin.com", "youtube.com", "threads.net", "t.me")
PORTALS = (
    "shiksha.com", "collegedunia.com", "careers360.com", "collegedekho.com", "getmyuni.com", "collegesearch.in", "collegebatch.com", "edufever.com",
    "universitykart.com", "aglasem.com", "sarvgyan.com", "targetstudy.com", "campusoption.com",
)
GOVERNMENT = ("gov.in", "nic.in", "ugc.gov.in", "aicte-india.org", "naac.gov.in", "nirfindia.org", "education.gov.in", "nba.co.in", "ncte.gov.in", "kea.kar.nic.in", "ac.in")
ACADEMIC = (".edu", ".edu.in", ".ac.in")
NEWS = (
    "news", "times", "express", "hindu", "ndtv", "deccan", "herald", "tribune", "mirror", "chronicle", "today", "post", "gazette", "journal", "prabha", "vijaya",
    "udayavani", "tv9", "abplive", "zee", "indiatoday", "livemint", "firstpost", "thequint", "scroll.in", "theprint", "outlook", "week", "edexlive", "newsminute",
    "bhaskar", "jagran", "patrika", "lokmat", "samachar",
)
#: Words of a question that are no search terms.
QUESTION_STOPS = (
    "what", "happened", "about", "our", "the", "on", "internet", "this", "week", "month", "today", "college", "institution", "online", "news", "is", "are", "there", "any",
    "of", "for", "in", "and", "tell", "me", "find", "search", "please", "latest", "recent", "update", "updates", "give", "a", "an", "to", "with", "did", "do", "has", "have",
    "been", "was", "were", "we", "us", "it", "that", "which", "how",
)


def keyword_pattern(words: tuple[str, ...]) -> str:
    """A pattern without look-arounds for any of the words as a whole word."""
    ways = [f"{w[:-1]}[a-z]*" if w.endswith("*") else f"{w}(?:s|es)?" for w in words]
    return f"(?:^|[^a-z0-9])(?:{'|'.join(ways)})(?:[^a-z0-9]|$)"


def tags(c: Column, topics: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Topics of which a keyword occurs, in their order."""
    text = F.lower(c)
    return F.array_compact(F.array(*(F.when(text.rlike(keyword_pattern(words)), F.lit(topic)) for topic, words in (topics or TOPICS).items())))


def question_terms(c: Column) -> Column:
    """Up to six different words of three letters or more that are no ordinary words of questions, in their order."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"[a-z\x{0C80}-\x{0CFF}][a-z0-9\x{0C80}-\x{0CFF}-]{2,}"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(found, lambda t: ~t.isin(*QUESTION_STOPS))), F.lit(1), F.lit(6))


def relevance(terms: Column, text: Column, matched: Column, topics: Column, wanted: list[str] | None = None) -> Column:
    """0 without a match; else 0.4, 0.4 for the share of terms in the text (0.2 without terms), and for its topics 0.2 if one is wanted, or 0.1 if none is asked for."""
    hits = F.size(F.filter(terms, lambda t: F.contains(F.lower(text), t)))
    share = F.when(F.size(terms) > 0, 0.4 * hits / F.size(terms)).otherwise(0.2)
    bonus = F.when(F.arrays_overlap(topics, F.array(*map(F.lit, wanted))), 0.2) if wanted else F.when(F.size(topics) > 0, 0.1)
    return F.when(matched, F.round(F.least(F.lit(1.0), 0.4 + share + bonus.otherwise(0.0)), 3)).otherwise(0.0)


def importance(source: Column, topics: Column) -> Column:
    """high, medium or low from the class of a source and its topics."""
    hot = F.arrays_overlap(topics, F.array(*map(F.lit, IMPORTANT)))
    own = source.isin("official_website", "government")
    return F.when(hot & (own | (source == "news")), "high").when(hot | own, "medium").otherwise("low")


def under(host: Column, domains: tuple[str, ...]) -> Column:
    """Whether a host is one of the domains or lies under one."""
    return F.coalesce(host.rlike("(^|[.])(" + "|".join(d.replace(".", "[.]") for d in domains) + ")$"), F.lit(False))


def source_class(url: Column, official: Column | None = None) -> Column:
    """One of eight classes by the address: official site, forum, social page, portal, academic, government, news, other."""
    host, whole = domain(url), F.concat(F.coalesce(domain(url), F.lit("")), F.lower(url))
    ends = lambda ends_: F.coalesce(host.rlike("(" + "|".join(e.replace(".", "[.]") for e in ends_) + ")$"), F.lit(False))
    return (
        F.when(official if official is not None else F.lit(False), "official_website")
        .when(whole.rlike("|".join(f.replace(".", "[.]") for f in FORUMS)), "public_forum")
        .when(under(host, SOCIAL), "public_social")
        .when(under(host, PORTALS), "education_portal")
        .when(under(host, GOVERNMENT), F.when(ends(ACADEMIC), "academic_website").otherwise("government"))
        .when(ends(ACADEMIC), "academic_website")
        .when(F.coalesce(host.rlike("|".join(n.replace(".", "[.]") for n in NEWS)), F.lit(False)), "news")
        .otherwise("other_web")
    )


def domain(url: Column) -> Column:
    """Host in lower case, without www and port."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def canonical_url(url: Column) -> Column:
    """https, host without www or port, no tracking parameters, sorted query, no closing slash; null if it has no host."""
    host, path = domain(url), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    pairs = F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&")
    kept = F.array_sort(F.filter(pairs, lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.coalesce(host, F.lit("")) != "", F.concat(F.lit("https://"), host, F.regexp_replace(path, "/+$", ""), query))


def in_holdout(key: Column, percent: int) -> Column:
    """A fixed part of all keys: the first 32 bits of SHA-256, modulo 100."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint") % 100 < percent


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0).cast("double"), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def citations(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\[(doc-[A-Za-z0-9-]+:page \d+)\]"), F.lit(1))


def language(c: Column) -> Column:
    """By script: Devanagari hi, Kannada kn, else en."""
    return F.when(c.rlike(r"[ऀ-ॿ]"), "hi").when(c.rlike(r"[ಀ-೿]"), "kn").otherwise("en")


def warnings(c: Column, phrases: list[str]) -> Column:
    """Marker phrases that an untrusted text contains."""
    text = F.lower(c)
    return F.filter(F.array(*map(F.lit, phrases)), lambda p: text.contains(p))


def grouped_number(c: Column) -> Column:
    """Digits in groups as Indian money is written: 12,34,567."""
    whole = F.round(c, 0).cast("decimal(38,0)").cast("string")
    digits, sign = F.ltrim(whole, F.lit("-")), F.when(whole.startswith("-"), "-").otherwise("")
    head = F.regexp_replace(F.substring(digits, F.lit(1), F.length(digits) - 3), r"(\d)(?=(\d\d)+$)", "$1,")
    return F.concat(sign, F.when(F.length(digits) <= 3, digits).otherwise(F.concat(head, F.lit(","), F.right(digits, F.lit(3)))))


#: Words of gambling pages, patterns of spam and of domains for sale.
GAMBLING = ("gacor", "togel", "slot", "judi", "maxwin", "situs", "bandar", "tebak angka", "prediksi", "rtp", "casino", "sbobet", "toto", "4d", "jackpot", "betting")
SPAM = (
    r"(?i)replica|rolex|relogio|montre|orologi|vape|casino|gacor|togel|\bslot\b|slot-?online|judi|sbobet|\btoto\b|poker|viagra|cialis|escort|payday|bet365|1xbet|maxwin|"
    "bandar|pinjol|porn|xxx"
)
PARKED = (
    r"(?i)window\.location\.href\s*=\s*[\"']/lander[\"']|this domain (?:name )?(?:is|may be) for sale|buy this domain|domain (?:is )?for sale|sedoparking|parkingcrew|bodis\.com|"
    r"afternic|dan\.com/buy|is parked free|parked (?:free|domain)|domain has expired|this domain has been registered"
)


def gambling_terms(c: Column) -> Column:
    """How many different words of gambling pages a text has."""
    text = F.lower(F.coalesce(c, F.lit("")))
    return sum((text.rlike(f"(?:^|[^a-z0-9]){w}(?:[^a-z0-9]|$)").cast("int") for w in GAMBLING), F.lit(0))


def integrity(html: Column, title: Column, visible: Column, hidden_spam: Column, visible_spam: Column, hidden_away: Column) -> Column:
    """parked, hijacked, compromised, suspect or clean, from a page's source, title, text and counts of links that lead away."""
    parked = F.coalesce(html, F.lit("")).rlike(PARKED) | F.coalesce(visible, F.lit("")).rlike(PARKED) | ((F.length(html) < 400) & F.contains(html, F.lit("/lander")))
    return (
        F.when(F.coalesce(parked, F.lit(False)), "parked")
        .when((gambling_terms(title) >= 2) | (gambling_terms(visible) >= 4), "hijacked")
        .when((hidden_spam > 0) | (visible_spam >= 3), "compromised")
        .when(hidden_away >= 5, "suspect")
        .otherwise("clean")
    )


#: Hosts of platforms, in the order in which they are tried.
PLATFORM_HOSTS = {
    "facebook.com": "facebook", "fb.com": "facebook", "fb.me": "facebook", "instagram.com": "instagram", "twitter.com": "x", "x.com": "x", "youtube.com": "youtube",
    "youtu.be": "youtube", "linkedin.com": "linkedin", "threads.net": "threads", "threads.com": "threads", "wa.me": "whatsapp", "wa.link": "whatsapp",
    "whatsapp.com": "whatsapp", "t.me": "telegram", "telegram.me": "telegram", "github.com": "github", "reddit.com": "reddit", "snapchat.com": "snapchat",
    "pinterest.com": "pinterest", "sharechat.com": "sharechat", "spotify.com": "spotify", "linktr.ee": "linktree", "bio.link": "linktree", "unstop.com": "unstop",
    "devpost.com": "devpost", "gdg.community.dev": "gdg", "quora.com": "quora", "wikipedia.org": "wikipedia", "wikidata.org": "wikidata", "play.google.com": "google_play",
}
#: Host prefixes that name the same site, and first path parts that are no account.
HOST_PREFIXES = ("www.", "m.", "mobile.", "web.", "in.", "en.", "business.")
RESERVED = {
    "instagram": ("p", "reel", "reels", "tv", "stories", "explore", "popular", "accounts", "direct"),
    "x": ("i", "home", "search", "intent", "share", "hashtag", "explore"),
    "facebook": ("sharer", "sharer.php", "dialog", "plugins", "watch", "events", "hashtag", "login", "photo.php", "story.php", "permalink.php", "share"),
    "threads": ("search", "intent"),
    "github": ("orgs", "sponsors", "topics", "search", "login"),
}


def site(url: Column) -> Column:
    """Host in lower case without the prefixes that name the same site."""
    host = F.rtrim(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit("."))
    prefixes = "".join(f"(?:{p.replace('.', '[.]')}(?=.*[.]))?" for p in HOST_PREFIXES)  # each once, in this order
    return F.regexp_replace(host, f"^{prefixes}", "")


def platform(host: Column) -> Column:
    """The platform that a host, as site() gives it, belongs to, or website: its last labels are looked up, so that the host is worked out for a few places only."""
    names = F.create_map(*(F.lit(x) for kv in PLATFORM_HOSTS.items() for x in kv))
    ends = [F.try_element_at(names, F.substring_index(host, ".", -n)) for n in sorted({s.count(".") + 1 for s in PLATFORM_HOSTS})]
    return F.when(F.coalesce(host, F.lit("")) != "", F.coalesce(*ends, F.lit("website")))


def account_key(url: Column, host: Column, where: Column) -> Column:
    """What an address names on its platform, as platform:key; a site's front page as web:host, other pages as page:address; null if it has no host.

    host and where are columns made with site() and platform().
    """
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda x: x != "")
    raw = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    part = lambda i: F.lower(raw(i))
    given = lambda name: F.try_parse_url(url, F.lit("QUERY"), F.lit(name))
    free = lambda name, c: (c != "") & ~c.isin(*RESERVED[name])
    key = lambda *c: F.concat(where, F.lit(":"), *c)
    handle = F.ltrim(part(0), F.lit("@"))
    number = F.regexp_extract(F.when(part(0).isin("people", "pages", "p"), F.element_at(F.concat(F.array(F.lit("")), parts), -1)).otherwise(raw(0)), r"(?:^|-)(\d{6,})$", 1)
    n = F.size(parts)
    accounts = (
        F.when((where == "website") & (n == 0) & F.try_parse_url(url, F.lit("QUERY")).isNull(), F.concat(F.lit("web:"), host))
        .when((where == "instagram") & free("instagram", handle) | (where == "threads") & free("threads", handle), key(handle))
        .when((where == "x") & free("x", part(0)) & (part(1) != "status"), key(part(0)))
        .when((where == "facebook") & (part(0) == "profile.php") & given("id").isNotNull(), key(F.lit("id:"), given("id")))
        .when((where == "facebook") & (part(0) == "groups") & (n >= 2), key(F.lit("group:"), part(1)))
        .when((where == "facebook") & free("facebook", part(0)) & (number != ""), key(F.lit("id:"), number))
        .when((where == "facebook") & free("facebook", part(0)) & ~part(0).isin("people", "pages", "p"), key(part(0)))
        .when((where == "youtube") & part(0).startswith("@"), key(part(0)))
        .when((where == "youtube") & (part(0) == "channel") & (n >= 2), key(F.lit("channel:"), raw(1)))
        .when((where == "youtube") & part(0).isin("c", "user") & (n >= 2), key(part(0), F.lit(":"), part(1)))
        .when((where == "youtube") & (part(0) == "watch") & given("v").isNotNull(), key(F.lit("video:"), given("v")))
        .when((where == "youtube") & (host == "youtu.be") & (n > 0), key(F.lit("video:"), raw(0)))
        .when((where == "linkedin") & part(0).isin("company", "school", "showcase", "in") & (n >= 2), key(part(0), F.lit(":"), part(1)))
        .when((where == "whatsapp") & (host == "chat.whatsapp.com") & (n > 0), key(F.lit("group:"), raw(0)))
        .when((where == "whatsapp") & (host == "wa.me") & raw(0).rlike(r"^\d+$"), key(raw(0)))
        .when((where == "telegram") & ((part(0) == "joinchat") | part(0).startswith("+")), key(F.lit("group:"), F.element_at(F.concat(F.array(F.lit("")), parts), -1)))
        .when(where.isin("telegram", "linktree") & (n > 0), key(part(0)))
        .when((where == "github") & free("github", part(0)), key(part(0)))
        .when((where == "reddit") & (part(0) == "r") & (n >= 4) & (part(2) == "comments"), key(F.lit("post:"), part(3)))
        .when((where == "reddit") & (part(0) == "r") & (n >= 2), key(F.lit("r:"), part(1)))
        .when((where == "reddit") & part(0).isin("user", "u") & (n >= 2), key(F.lit("u:"), part(1)))
        .when((where == "sharechat") & (part(0) == "profile") & (n >= 2) | (where == "snapchat") & (part(0) == "add") & (n >= 2), key(part(1)))
        .when((where == "pinterest") & (n >= 2), key(part(0), F.lit("/"), part(1)))
        .when((where == "google_play") & F.lower(F.array_join(F.slice(parts, 1, 3), "/")).isin("store/apps/details") & given("id").isNotNull(), key(F.lit("app:"), given("id")))
    )
    return F.when(where.isNotNull(), F.coalesce(accounts, F.concat(F.lit("page:"), canonical_url(url))))


#: Suffixes tried for look-alike names, and letters drawn alike.
SUFFIXES = ("in", "co.in", "org", "com", "net", "edu.in", "ac.in")
TWO_PART_SUFFIXES = ("co.in", "ac.in", "edu.in", "gov.in", "org.in", "net.in", "co.uk", "ac.uk", "org.uk", "gov.uk", "com.au", "edu.au")


def registrable(host: Column) -> Column:
    """The name under its public suffix that someone registered: two parts, or three where the suffix has two."""
    parts = F.split(host, r"\.")
    two = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), ".")
    three = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(3)), ".")
    return F.when(two.isin(*TWO_PART_SUFFIXES), three).otherwise(two)


def look_alikes(host: Column) -> Column:
    """Registrable names one slip away: other suffixes; for names of four letters or more a letter less, two exchanged, one doubled, 0 for o, 1 for l, m for rn (and back), a hyphen."""
    own = registrable(host)
    label = F.substring_index(own, ".", 1)
    suffix = F.substring(own, F.length(label) + 2, F.lit(100))
    n = F.length(label)
    at = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    left, right = lambda i: F.substring(label, F.lit(1), i), lambda i: F.substring(label, i, F.lit(100))

    def exchanged(a: str, b: str):
        return lambda i: F.when(right(i).startswith(a), F.concat(left(i - 1), F.lit(b), right(i + len(a))))

    ways = [
        F.transform(at, lambda i: F.concat(left(i - 1), right(i + 1))),
        F.transform(at, lambda i: F.concat(left(i - 1), F.substring(label, i + 1, F.lit(1)), F.substring(label, i, F.lit(1)), right(i + 2))),
        F.transform(at, lambda i: F.concat(left(i), right(i))),
        F.transform(at, lambda i: F.concat(left(i - 1), F.lit("-"), right(i))),
        *(F.transform(at, exchanged(a, b)) for a, b in (("o", "0"), ("0", "o"), ("l", "1"), ("1", "l"), ("rn", "m"), ("m", "rn"))),
    ]
    slips = F.filter(F.concat(*ways), lambda x: x.rlike("^[a-z0-9]([a-z0-9-]*[a-z0-9])?$") & ~F.contains(x, F.lit("--")) & (F.length(x) <= 63))
    slips = F.when(n >= 4, F.transform(slips, lambda x: F.concat(x, F.lit("."), suffix))).otherwise(F.array().cast("array<string>"))
    others = F.transform(F.filter(F.array(*map(F.lit, SUFFIXES)), lambda x: x != suffix), lambda x: F.concat(label, F.lit("."), x))
    return F.array_distinct(F.filter(F.concat(others, slips), lambda x: x.isNotNull() & (x != own)))
