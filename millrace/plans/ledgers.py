"""Queries of budgets, suppression lists and alike names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keyed import fingerprint
from ..operators import alike, budgets, graph, stores
from .registry import query
from .roles import table

_CAPS = (120.0, 280.0)

#: Every fifth event hands back what it names; three tenants in each day and kind of event.
_ASKED = """r as (select event_id, cast(ts as date) as day, event_type, user_id % 3 as tenant, value as units, event_id % 5 = 0 as back,
  row_number() over (partition by cast(ts as date), event_type order by ts, event_id) as n from events)"""
_FOLD = f"""{_ASKED}, f as (select day, event_type, 0::bigint as n, 0::bigint as event_id, 0::bigint as tenant, false as back, 0.0::double as units, false as ok, 0.0::double as a, 0.0::double as b, 0.0::double as c, 0.0::double as total from r where n = 1
  union all select day, event_type, n, event_id, tenant, back, units, ok, case when ok and tenant = 0 then greatest(0.0, a + step) else a end, case when ok and tenant = 1 then greatest(0.0, b + step) else b end,
    case when ok and tenant = 2 then greatest(0.0, c + step) else c end, case when ok then greatest(0.0, total + step) else total end
  from (select r.day, r.event_type, r.n, r.event_id, r.tenant, r.back, r.units, f.a, f.b, f.c, f.total, case when r.back then -r.units else r.units end as step,
    r.back or (case r.tenant when 0 then f.a when 1 then f.b else f.c end + r.units <= {_CAPS[0]} and f.total + r.units <= {_CAPS[1]}) as ok
    from f join r on r.day = f.day and r.event_type = f.event_type and r.n = f.n + 1))"""


def _reserved(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", "ts", "to_date(ts) as day", "event_type", "user_id % 3 as tenant", "value as units", "event_id % 5 = 0 as back")
    return budgets.reserved(rows, ["day", "event_type"], "tenant", ["ts", "event_id"], "units", *_CAPS, F.when(F.col("back"), budgets.REFUND).otherwise(budgets.RESERVE))


@query(f"""with recursive {_FOLD} select event_id, ok as admitted, round(case tenant when 0 then a when 1 then b else c end, 4) as tenant_used, round(total, 4) as global_used from f where n > 0""")
def reserved_budgets(spark, sf):
    """Which requests got their units, by a cap of each tenant and one of all, with what was handed back."""
    return _reserved(spark, sf).select("event_id", "admitted", F.round("tenant_used", 4).alias("tenant_used"), F.round("global_used", 4).alias("global_used"))


@query(f"""with recursive {_FOLD} select day, event_type, round(max_by(total, n), 4) as used, count(*) filter (where ok and units > 0 and not back) as calls, count(*) filter (where not ok) as refused from f where n > 0 group by 1, 2""")
def spent_budgets(spark, sf):
    """What is used of each day's budget, and how many requests took from it or were refused."""
    got = budgets.spent(_reserved(spark, sf), ["day", "event_type"], ["ts", "event_id"], "global_used")
    return got.withColumn("used", F.round("used", 4))


_SECRET = b"a key of the tables"
_PADS = [bytes(b ^ byte for b in _SECRET.ljust(64, b"\0")).hex() for byte in (0x36, 0x5C)]
_HMAC = "sha256(unhex('{1}') || unhex(sha256(unhex('{0}') || encode(lower(trim({2})))))) ".format(*_PADS, "{0}")


@query(f"""select c_custkey, {_HMAC.format("c_name")} as key_hmac, exists (select 1 from orders where o_custkey = c_custkey and o_orderkey % 16 = 0) as suppressed from customer""")
def suppressed_accounts(spark, sf):
    """Accounts of customers whose orders put them on the list of their nation."""
    people = table(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("tenant"))
    asked = table(spark, sf, "orders").where("o_orderkey % 16 = 0").select(F.col("o_custkey").alias("c_custkey"))
    listed = people.join(asked, "c_custkey").select("tenant", fingerprint(_SECRET, F.concat(F.lit(" "), F.upper("c_name"))).alias("key_hmac"))
    got = stores.suppressed(people, listed, "tenant", "c_name", _SECRET)
    return got.select("c_custkey", fingerprint(_SECRET, F.col("c_name")).alias("key_hmac"), "suppressed")


@query("""with g as (select o_custkey as asset_key, min_by(o_orderpriority, o_orderkey) as found from orders group by 1), s as (select c_custkey, c_name from customer where c_custkey % 4 = 0)
  select coalesce(c_custkey, asset_key) as asset_key, case when asset_key % 9 = 0 then 'canary' when c_custkey is not null then 'seed' else 'holdout' end as split,
    case when asset_key % 9 = 0 then 'third_party' else 'official' end as relation, case when asset_key % 9 = 0 then 'D' when c_custkey is not null then 'B' else 'C' end as least_grade,
    case when asset_key % 9 = 0 then 'like ' || asset_key when c_custkey is not null then c_name else found end as entity_name from s full join g on c_custkey = asset_key""")
def gold_items(spark, sf):
    """Ground truth: stored seeds stay, the first order of another customer adds one, and known look-alikes become canaries."""
    stored = table(spark, sf, "customer").where("c_custkey % 4 = 0").selectExpr("c_custkey as asset_key", "'seed' as split", "'official' as relation", "'B' as least_grade", "c_name as entity_name")
    orders = table(spark, sf, "orders")
    rows = orders.selectExpr("o_custkey as asset_key", "o_orderkey as at", "'holdout' as split", "'official' as relation", "'C' as least_grade", "o_orderpriority as entity_name")
    like = orders.where("o_custkey % 9 = 0").selectExpr("o_custkey as asset_key", "concat('like ', o_custkey) as entity_name")
    return stores.with_canaries(stores.first_wins(stored, rows, ["asset_key"], ["at"]), like)


def customers(spark, sf):
    """Customers in threes: a name, the same less a letter, and one of five names that a third of all share.

    The names are made, as the table's own differ in a number only: most of them are alike, and the join is too slow for that (README).
    """
    own = "translate(left(md5(cast(c_custkey div 3 as string)), 22), '0123456789', 'ghijklmnop')"
    name = f"case c_custkey % 3 when 0 then concat('Ann ', {own}) when 1 then concat('ann ', left({own}, 8), substring({own}, 10)) else concat('Shared name ', c_custkey % 5) end as name"
    return table(spark, sf, "customer").selectExpr("c_custkey as key", name, "c_acctbal as balance", "concat('nation ', c_nationkey) as nation")


@query()
def alike_people(spark, sf):
    """Each customer's class of equal names and how many customers of other names are alike; no SQL, as it knows no such ratio."""
    return alike.alike_people(customers(spark, sf), "key", "name")


@query()
def corroborated_people(spark, sf):
    """Alike names of which two customers share a nation or a balance, however many others do; no SQL, as it knows no such ratio."""
    return alike.corroborated(customers(spark, sf), "key", "name", ["balance", "nation"])


_AT = lambda i: f"case {i} when 0 then 'O' when 1 then 'A' when 2 then 'B' when 3 then 'C' else 'D' end"
_HELD = f"""o_orderkey as asset_id, {_AT('o_orderkey % 5')} as grade, 'kept' as reasons, case o_orderkey % 3 when 0 then 'v1' when 1 then 'v2' end as scorer_version,
  case when o_custkey % 4 = 0 then 'parked' else 'live' end as status, case when o_orderkey % 7 = 0 then 'C' end as proposed_grade, case when o_orderkey % 7 = 0 then 'waits' end as proposed_reasons,
  case when o_orderkey % 7 = 0 then 'v1' end as proposed_scorer, case when o_orderkey % 7 = 0 then 'old' end as proposed_run"""
_FOUND = f"o_orderkey as asset_id, {_AT('(o_orderkey + o_custkey) % 5')} as grade, case when o_custkey % 2 = 0 then 'kept' else 'found' end as reasons, case when o_custkey % 10 = 3 then 'hijacked' end as status"
_MARKED = f"""s as (select {_HELD} from orders), c as (select {_FOUND} from orders where o_custkey % 6 <> 5),
  j as (select s.*, c.grade as g, c.reasons as r, coalesce(c.status, s.status) as st, coalesce(scorer_version <> 'v2', false) as stale, list_position(['O', 'A', 'B', 'C', 'D'], c.grade) > list_position(['O', 'A', 'B', 'C', 'D'], s.grade) as fell from s left join c using (asset_id)),
  a as (select *, case when g is null then 'same' when g = grade then case when stale or r <> reasons then 'restamped' else 'same' end
    when (stale or proposed_grade is not null) and not (fell and (g = 'D' or st in ('compromised', 'hijacked', 'parked', 'redirected', 'dead'))) then 'parked' else 'published' end as action from j)"""


def _grades(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.selectExpr(*_split(_HELD)), orders.where("o_custkey % 6 <> 5").selectExpr(*_split(_FOUND))


def _split(columns):
    import re

    return [c.strip() for c in re.split(r",(?![^(]*\))", columns)]


@query(f"""with {_MARKED} select asset_id, action, st as status, case when action = 'published' then g else grade end as grade, case when action in ('published', 'restamped') then r else reasons end as reasons,
  case when action in ('published', 'restamped') then 'v2' else scorer_version end as scorer_version, case action when 'parked' then g when 'published' then null else proposed_grade end as proposed_grade,
  case action when 'parked' then r when 'published' then null else proposed_reasons end as proposed_reasons, case action when 'parked' then 'v2' when 'published' then null else proposed_scorer end as proposed_scorer,
  case action when 'parked' then coalesce(proposed_run, 'now') when 'published' then null else proposed_run end as proposed_run from a""")
def regraded_assets(spark, sf):
    """Stored grades after a pass: what is published, what waits for a manager, what only gets the new rule."""
    return graph.regraded(*_grades(spark, sf), "v2", "now")


_RESCORED = """select '{0}' as name, asset_id, case when changed and publish and proposed_run is null then g else grade end as grade, case when changed and publish and proposed_run is null then null when changed then g else proposed_grade end as proposed_grade, publish
  from p, (select avg(case when grade in ('O', 'A', 'B') then 1.0 else 0 end) - avg(case when case when changed then g else coalesce(proposed_grade, grade) end in ('O', 'A', 'B') then 1.0 else 0 end) <= {1} as publish from p)"""


@query(f"with {_MARKED}, p as (select *, coalesce(g <> grade, false) as changed from j) {_RESCORED.format('usual', 0.02)} union all {_RESCORED.format('any', 1.0)}")
def rescored_assets(spark, sf):
    """All grades under a new rule, published if the gate lets them pass; proposals of other runs wait on."""
    stored, found = _grades(spark, sf)

    def measure(assets):
        return assets.agg(F.avg(F.col("grade").isin("O", "A", "B").cast("double")).alias("holdout_recall"), F.lit(1.0).alias("seed_rate"), F.lit(None).cast("double").alias("precision"), F.array().cast("array<string>").alias("canary_leaks"))

    runs = [graph.rescored(stored, found, "v2", "now", measure, t).select(F.lit(n).alias("name"), "asset_id", "grade", "proposed_grade", "publish") for n, t in (("usual", 0.02), ("any", 1.0))]
    return runs[0].union(runs[1])
