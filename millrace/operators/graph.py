"""Grades of accounts from an append-only log of evidence, and measures of the map they make."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Grades from best to worst.
RANKS = {"O": 6, "A": 5, "A-arch": 4, "B": 3, "C": 2, "unrated": 1, "D": 0}


def rank_of(grade: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in RANKS.items() for x in pair)), grade)


def grade_of(rank: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in RANKS.items() for x in pair[::-1])), rank)


def standing(evidence: DataFrame, scope: list[str]) -> DataFrame:
    """Supports that no later refutation of the same scope cancels."""
    refuted = F.max(F.when(F.col("polarity") == "refutes", F.col("observed_at"))).over(Window.partitionBy(*scope))
    return evidence.withColumn("_refuted", refuted).where(
        (F.col("polarity") == "supports") & (F.col("_refuted").isNull() | (F.col("observed_at") > F.col("_refuted")))
    ).drop("_refuted")


def graded(evidence: DataFrame, scope: list[str]) -> DataFrame:
    """For each asset its grade: own site O, anchored link A, two independent channels B, one C, refuted D, else unrated.

    Community records count as one channel however many there are.
    """
    held = standing(evidence, scope)
    channel = F.when(F.col("kind") == "community_record", "community").otherwise(F.col("channel"))
    sums = held.groupBy("asset_id").agg(
        F.count_distinct(channel).alias("channels"), F.bool_or(F.col("kind") == "own_site").alias("own"), F.bool_or(F.col("kind") == "site_link").alias("anchored")
    )
    every = evidence.groupBy("asset_id").agg(F.bool_or(F.col("polarity") == "refutes").alias("refuted"))
    rank = (
        F.when(F.col("own"), 6).when(F.col("anchored"), 5).when(F.col("channels") >= 2, 3).when(F.col("channels") == 1, 2)
        .when(F.col("refuted"), 0).otherwise(1)
    )
    return every.join(sums, "asset_id", "left").select("asset_id", rank.alias("rank"), grade_of(rank).alias("grade"), F.coalesce("channels", F.lit(0)).alias("channels"))


def disputed(assets: DataFrame) -> DataFrame:
    """assets with disputed: B or better, one of several official accounts of an entity on a platform of which none is anchored."""
    official = F.when((F.col("relation") == "official") & (F.col("rank") >= 3), 1).otherwise(0)
    w = Window.partitionBy("entity_id", "platform")
    many = F.sum(official).over(w) >= 2
    return assets.withColumn("disputed", (official == 1) & many & (F.max(F.when(official == 1, F.col("rank"))).over(w) < 5))


def superseded(evidence: DataFrame, keep: list[list[str]], key: str = "evidence_id") -> DataFrame:
    """Evidence that is not the latest of any of the given scopes."""
    marks = [
        F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc("observed_at"), F.desc(key))) == 1 for scope in keep
    ]
    used = marks[0]
    for m in marks[1:]:
        used |= m
    return evidence.withColumn("_used", used).where(~F.col("_used")).drop("_used")


def map_metrics(assets: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: assets, verified ones, hold-out recall, seed rate and canary leaks; platform_metrics() has the precision."""
    ranked = assets.select("asset_key", "rank")
    both = gold.join(ranked, "asset_key", "left")
    good = F.coalesce(F.col("rank"), F.lit(-1)) >= 3
    of = lambda split: F.col("split") == split
    share = lambda hit, n: F.when(n > 0, F.round(hit / n, 4))
    sums = both.agg(
        F.count_if(of("holdout")).alias("_h"), F.count_if(of("holdout") & good).alias("_hg"), F.count_if(of("seed")).alias("_s"),
        F.count_if(of("seed") & good).alias("_sg"), F.count_if(of("canary") & good).alias("canary_leaks"),
    )
    verified = assets.agg(F.count_if(F.col("rank") >= 3).alias("verified"), F.count(F.lit(1)).alias("assets"))
    return verified.crossJoin(sums).select(
        "assets", "verified", "canary_leaks", share(F.col("_hg"), F.col("_h")).alias("holdout_recall"), share(F.col("_sg"), F.col("_s")).alias("seed_rate"),
    )


def platform_metrics(assets: DataFrame, gold: DataFrame) -> DataFrame:
    """By platform and for all (null): assets, verified, precision (of verified ones in gold the share that are no canaries) and hold-out recall."""
    both = assets.join(gold.select("asset_id", "split"), "asset_id", "left")
    good, split = F.col("rank") >= 3, F.col("split")
    ratio = lambda hit, every: F.round(F.count_if(hit) / F.nullif(F.count_if(every), F.lit(0)), 4)
    return both.rollup("platform").agg(
        F.count(F.lit(1)).alias("assets"), F.count_if(good).alias("verified"), ratio(good & split.isin("seed", "holdout"), good & split.isNotNull()).alias("precision"),
        ratio((split == "holdout") & good, split == "holdout").alias("holdout_recall"),
    )


def freshness(assets: DataFrame, verified_at: str, now: Column) -> DataFrame:
    """Share verified within 7, 30 and 90 days, and the median age in days."""
    age = F.date_diff(now, F.col(verified_at))
    return assets.agg(
        *(F.round(F.avg(F.when(age <= d, 1.0).otherwise(0.0)), 4).alias(f"within_{d}") for d in (7, 30, 90)), F.median(age).alias("median_age")
    )


def coverage(assets: DataFrame, platform: str, first: Column, second: Column) -> DataFrame:
    """By platform and for all: Chapman's estimate from what two ways of finding found, and the share found."""
    marked = assets.select(platform, first.alias("_a"), second.alias("_b"))
    n1, n2, m = F.count_if("_a"), F.count_if("_b"), F.count_if(F.col("_a") & F.col("_b"))
    found = F.count_if(F.col("_a") | F.col("_b"))
    total = (n1 + 1) * (n2 + 1) / (m + 1) - 1
    return marked.rollup(platform).agg(
        n1.alias("n1"), n2.alias("n2"), m.alias("both"), F.round(total, 4).alias("estimate"),
        F.round(F.when(total > 0, F.least(F.lit(1.0), found / total)), 4).alias("coverage"),
    )


def gate(before: DataFrame, after: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """publish and reasons: whether new metrics may be published, and what speaks against it.

    Both have one row: holdout_recall, seed_rate, precision (null: not known, which says nothing) and canary_leaks, the keys of
    known look-alikes that would be graded well.  No share may fall by more than the tolerance; a look-alike that did
    not leak before must not, even if another stopped.
    """
    shares = ("holdout_recall", "seed_rate", "precision")
    old = before.select(*(F.col(c).alias(f"_{c}") for c in (*shares, "canary_leaks")))
    leaks = F.array_sort(F.array_except("canary_leaks", "_canary_leaks"))
    fell = [F.when(F.col(f"_{c}") - F.col(c) > tolerance, F.lit(c)) for c in shares]
    named = F.when(F.size(leaks) > 0, F.concat(F.lit("leaks "), F.array_join(leaks, ", ")))
    return after.crossJoin(old).select(F.array_compact(F.array(named, *fell)).alias("reasons")).select((F.size("reasons") == 0).alias("publish"), "reasons")


def removals(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links whose last word was support and that a later clean fetch of their page no longer has."""
    last = links.groupBy("asset_id", "page").agg(F.max_by("polarity", "observed_at").alias("polarity"), F.max("observed_at").alias("observed_at"))
    return last.where("polarity = 'supports'").join(pages, "page").where(F.col("fetched_at") > F.col("observed_at")).select("asset_id", "page")


#: Grades one step down, kinds whose channel corroborates, and kinds that need a source that vouches.
STEP_DOWN = {"O": "A", "A": "B", "A-arch": "C", "B": "C", "C": "C"}
CORROBORATING = ("search_snippet", "directory_record", "community_record", "hub_link", "reviewer_confirm", "backlink", "api_identity")
VOUCHED = ("official_link", "hub_link", "subdomain", "backlink")
#: Rows of evidence that a task of full_grades() gets at most, about, as it sorts them for four kinds of windows at once; and from how many on another core helps.
PART_ROWS, CORE_ROWS = 200_000, 10_000


def found_by(evidence: DataFrame) -> DataFrame:
    """(source_asset_id, own_channels): the channels that support each asset that is a source of others."""
    channel = F.when(F.col("kind") == "community_record", "community").otherwise(F.col("channel"))
    held = evidence.where((F.col("polarity") == "supports") & F.col("kind").isin(*CORROBORATING))
    return held.groupBy(F.col("asset_id").alias("source_asset_id")).agg(F.collect_set(channel).alias("own_channels"))  # channels are few


def full_grades(evidence: DataFrame) -> DataFrame:
    """Grades by the whole rule: (asset_id, rank, grade, channels, reason).

    Cancelled supports: from a source that was refuted; a configured domain whose last word is a refutation;
    all up to a change of identity; a link that a later fetch of its page no longer had; an owner's word taken
    back.  A source that lost its anchor leaves links of before as archived, and hubs and subdomains as C.
    D stands for a rejection, a look-alike, an impersonation, a hijacked or a parked page that no reviewer
    confirmed after.  Two channels make B; a hub's channel is none where every source it came through stands
    on channels that the asset has already.
    Assets are dealt over as many tasks as the evidence needs, so that what a task holds does not grow with it.
    """
    n = evidence.count()
    evidence = evidence.repartition(max(1, -(-n // PART_ROWS), min(-(-n // CORE_ROWS), evidence.sparkSession.sparkContext.defaultParallelism)), "asset_id")
    asset, kind, at = Window.partitionBy("asset_id"), F.col("kind"), F.col("observed_at")
    against, supports = F.col("polarity") == "refutes", F.col("polarity") == "supports"
    last = lambda what, scope: F.max(F.when(what, at)).over(scope)
    source = Window.partitionBy("asset_id", "source_asset_id")
    rows = evidence.withColumns({
        "_source_refuted": last(against & (kind == "source_refuted"), source).isNotNull() & F.col("source_asset_id").isNotNull(),
        "_unconfigured": F.coalesce(last(against & (kind == "configured_domain"), asset) >= last(kind == "configured_domain", asset), F.lit(False)),
        "_reassigned": last(against & (kind == "identity_changed"), asset),
        "_withdrawn": last(against & (kind == "official_link"), Window.partitionBy("asset_id", "source_url")),
        "_anchor_lost": last(against & (kind == "anchor_lost"), source),
        "_owner_back": last(against & (kind == "owner_claim"), Window.partitionBy("asset_id", "channel")),
        "_rejected": last(against & (kind.isin("reviewer_reject", "lookalike", "impersonation") | ((kind == "integrity") & F.col("detail").rlike("^(hijacked|parked)"))), asset),
        "_confirmed": last(supports & (kind == "reviewer_confirm") & (F.col("observed_via") == "reviewer"), asset),
    })
    later = lambda c: F.coalesce(F.col(c) > at, F.lit(False))
    stands = (
        supports & ~(F.col("_source_refuted") & kind.isin(*VOUCHED)) & ~(F.col("_unconfigured") & (kind == "configured_domain"))
        & F.coalesce(at > F.col("_reassigned"), F.lit(True)) & ~((kind == "official_link") & later("_withdrawn"))
    )
    stale = F.col("source_asset_id").isNotNull() & later("_anchor_lost")
    via = F.when(stale & (kind == "official_link") & (F.col("observed_via") == "live"), "archive").otherwise(F.col("observed_via"))
    first = F.substring_index("detail", ":", 1)
    down = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in STEP_DOWN.items() for x in kv)), first), F.lit("C"))
    grade = (
        F.when(stale & kind.isin("hub_link", "subdomain"), "C")
        .when((kind == "owner_claim") & (via == "owner") & ~F.coalesce(F.col("_owner_back") >= at, F.lit(False)), "O")
        .when((kind == "official_link") & (via == "live"), F.when(first.isin("O", "A"), "A").when(first == "B", "B").otherwise("C"))
        .when((kind == "official_link") & (via == "archive"), F.when(first.isin("O", "A", "A-arch"), "A-arch").otherwise("C"))
        .when(kind == "official_link", "C")
        .when(kind == "configured_domain", "A")
        .when(kind == "hub_link", down)
        .when((kind == "subdomain") & (via == "live"), down)
        .when(kind == "directory_record", F.when(first == "authority", "A").otherwise("B"))
        .when(kind == "reviewer_confirm", "B")
        .when(kind.isin("api_identity", "search_snippet", "backlink", "community_record", "imported_claim"), "C")
    )
    channel = F.when(kind == "community_record", "community").otherwise(F.col("channel"))
    counts = stands & kind.isin(*CORROBORATING) & ~(stale & kind.isin("hub_link", "subdomain"))
    hub = counts & kind.isin("hub_link", "backlink") & F.col("source_asset_id").isNotNull()
    marked = rows.withColumns({"_rank": F.when(stands, rank_of(grade)), "_channel": F.when(counts, channel), "_through": F.when(hub, F.col("source_asset_id"))})
    sums = marked.groupBy("asset_id").agg(
        F.max("_rank").alias("_best"), F.max_by("kind", F.struct("_rank", F.col("observed_at"))).alias("reason"), F.collect_set("_channel").alias("_all"),
        F.coalesce(F.max("_rejected") >= F.coalesce(F.max("_confirmed"), F.lit("0001-01-01").cast("timestamp")), F.lit(False)).alias("_down"),
    )
    through = marked.where(F.col("_through").isNotNull()).select("asset_id", F.col("_channel").alias("_hub"), F.col("_through").alias("source_asset_id")).distinct()
    doubtful = through.join(found_by(evidence), "source_asset_id", "left").join(sums.select("asset_id", "_all"), "asset_id")
    others = F.array_remove("_all", F.col("_hub"))
    leans = F.col("own_channels").isNotNull() & (F.size(F.array_except("own_channels", others)) == 0)
    dropped = doubtful.groupBy("asset_id", "_hub").agg(F.bool_and(leans).alias("_leans")).where("_leans").groupBy("asset_id").agg(F.count(F.lit(1)).alias("_fewer"))
    n = F.size("_all") - F.coalesce("_fewer", F.lit(0))
    best = F.greatest(F.coalesce("_best", F.lit(1)), F.when(n >= 2, 3).otherwise(1))
    rank = F.when(F.col("_down"), 0).otherwise(best)
    return sums.join(dropped, "asset_id", "left").select("asset_id", rank.alias("rank"), grade_of(rank).alias("grade"), n.cast("long").alias("channels"), F.when(~F.col("_down") & F.col("_best").isNotNull(), F.col("reason")).alias("reason"))


#: Statuses that say that a site is out of its owner's hands.
SECURITY = ("compromised", "hijacked", "parked", "redirected", "dead")
_PROPOSAL = ("proposed_grade", "proposed_reasons", "proposed_scorer", "proposed_run")


def regraded(stored: DataFrame, computed: DataFrame, version: str, run: str, proposed: bool = False, publish: bool = False) -> DataFrame:
    """The stored grades after new ones were computed, with action: same, restamped, published or parked.

    stored has asset_id, grade, reasons, scorer_version, status and the proposal that waits (proposed_grade,
    _reasons, _scorer, _run; null: none); computed has asset_id, grade, reasons and status (null: as before), a
    row for each asset at most.  An equal grade only brings reasons and rule up to date and leaves what waits.
    Another grade is parked as a proposal where all are (proposed), where an older rule made the stored one, or where
    a proposal waits, which keeps its run; but a fall to D, or of a site out of its owner's hands, and all that
    publish forces take effect at once and clear the proposal.  Assets that were not computed stay.
    """
    new = computed.select("asset_id", *(F.col(c).alias(f"_{c}") for c in ("grade", "reasons", "status")))
    order = lambda c: F.coalesce(rank_of(F.col(c)), F.lit(RANKS["unrated"]))
    status = F.coalesce("_status", "status")
    stale = F.coalesce((F.col("scorer_version") != "") & (F.col("scorer_version") != version), F.lit(False))
    outright = F.lit(publish) | ((order("_grade") < order("grade")) & F.coalesce((F.col("_grade") == "D") | status.isin(*SECURITY), F.lit(False)))
    waits = F.lit(proposed) | ((stale | F.col("proposed_grade").isNotNull()) & ~outright)
    same = F.col("_grade").eqNullSafe(F.col("grade"))
    action = (
        F.when(F.col("_grade").isNull(), "same").when(same & (stale | ~F.col("_reasons").eqNullSafe(F.col("reasons"))), "restamped")
        .when(same, "same").when(waits, "parked").otherwise("published")
    )
    rows = stored.join(new, "asset_id", "left").withColumn("action", action)
    shown, parked = F.col("action").isin("published", "restamped"), F.col("action") == "parked"
    proposal = {"proposed_grade": F.col("_grade"), "proposed_reasons": F.col("_reasons"), "proposed_scorer": F.lit(version), "proposed_run": F.coalesce("proposed_run", F.lit(run))}
    after = {c: F.when(parked, v).when(F.col("action") != "published", F.col(c)) for c, v in proposal.items()}
    after |= {"grade": F.when(F.col("action") == "published", F.col("_grade")).otherwise(F.col("grade")), "status": status}
    after |= {"reasons": F.when(shown, F.col("_reasons")).otherwise(F.col("reasons")), "scorer_version": F.when(shown, F.lit(version)).otherwise(F.col("scorer_version"))}
    return rows.select(*(after.get(c, F.col(c)).alias(c) for c in stored.columns), "action")


def settled_proposals(stored: DataFrame, apply: Column, run: str | None = None) -> DataFrame:
    """stored after its proposals (of one run, or all) were published where apply holds, else discarded.

    Either way the grade stands under the proposal's rule, so that one discarded is not raised again by the same rule.
    """
    mine = F.col("proposed_grade").isNotNull() & (F.lit(True) if run is None else F.coalesce(F.col("proposed_run") == run, F.lit(False)))
    taken = mine & apply
    after = {c: F.when(~mine, F.col(c)) for c in _PROPOSAL}
    after |= {"grade": F.when(taken, F.col("proposed_grade")).otherwise(F.col("grade")), "reasons": F.when(taken, F.coalesce("proposed_reasons", "reasons")).otherwise(F.col("reasons"))}
    after["scorer_version"] = F.when(mine, F.coalesce("proposed_scorer", "scorer_version")).otherwise(F.col("scorer_version"))
    return stored.select(*(after.get(c, F.col(c)).alias(c) for c in stored.columns))


def rescored(stored: DataFrame, computed: DataFrame, version: str, run: str, measure: Callable[[DataFrame], DataFrame], tolerance: float = 0.02) -> DataFrame:
    """All grades under a new rule: parked as proposals of the run, and published if the gate lets the measures pass, else left waiting.

    measure makes the one row that gate() compares from assets and their grades; it sees the stored ones, then the proposed.
    Adds publish, the gate's word.
    """
    parked = regraded(stored, computed, version, run, proposed=True).drop("action")
    shown = parked.withColumn("grade", F.coalesce("proposed_grade", "grade"))
    verdict = gate(measure(stored), measure(shown), tolerance).select("publish")
    rows = parked.crossJoin(F.broadcast(verdict))  # one row
    passed = settled_proposals(rows, F.lit(True), run)
    return rows.where(~F.col("publish")).unionByName(passed.where("publish"))
