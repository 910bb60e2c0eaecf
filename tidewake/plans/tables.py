"""Queries of the sampling, aggregate, metric, join and text operators over the driver's tables, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import asof, declared, filters, geometry, intervals, islands, metrics, phases, sampling

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

C = F.col


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ms(c):
    """Milliseconds since the epoch of a timestamp without time zone."""
    c = C(c) if isinstance(c, str) else c
    return F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(1000).cast("decimal(10,0)")).cast("long")


HOURS6 = 6 * 3600 * 1000


@query(f"""WITH l AS (SELECT *, (epoch_us(ts) // 1000) AS t, LAG((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
, i AS (SELECT *, SUM(CASE WHEN p IS NULL OR t - p > {HOURS6} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM l)
, s AS (SELECT user_id, island, COUNT(*) AS events, MAX(t) - MIN(t) AS duration FROM i GROUP BY 1, 2)
, g AS (SELECT events, COUNT(*) AS n, list_sort(list(duration)) AS d FROM s GROUP BY events)
SELECT events, n, d[1 + CAST(round_even((n - 1) * 0.5, 0) AS BIGINT)] AS q_50, d[1 + CAST(round_even((n - 1) * 0.9, 0) AS BIGINT)] AS q_90, d[n] AS q_100 FROM g""")
def island_quantiles(spark, sf):
    """G1 and A2, the flagship: events to islands of at most six hours' silence, and exact quantiles of their lengths."""
    e = read(spark, sf, "events").select("user_id", "event_id", "ts", ms("ts").alias("t"))
    d = islands.gap_islands(e, ["user_id"], ["ts", "event_id"], "t", HOURS6)
    d = d.groupBy("user_id", "island").agg(F.count("*").alias("events"), (F.max("t") - F.min("t")).alias("duration"))
    return A.nearest_ranks(d, ["events"], "duration", [0.5, 0.9, 1.0])


def _rank_sql(q):
    return f"v[1 + CAST(round_even((n - 1) * {q}, 0) AS BIGINT)] AS q_{round(q * 100)}"


@query("WITH g AS (SELECT l_returnflag, COUNT(l_extendedprice) AS n, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY 1) SELECT l_returnflag, n, " + ", ".join(map(_rank_sql, A.QUANTILES)) + " FROM g")
def nearest_rank_quantiles(spark, sf):
    """A2, C9."""
    return A.nearest_ranks(read(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")


@query("SELECT l_returnflag, " + ", ".join(f"ROUND(quantile_cont(l_extendedprice, {q}), 6) AS p_{round(q * 100)}" for q in (0.25, 0.5, 0.9, 0.99)) + " FROM lineitem GROUP BY 1")
def linear_quantiles(spark, sf):
    """A3."""
    d = A.linear_quantiles(read(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.9, 0.99])
    return d.select("l_returnflag", *(F.round(c, 6).alias(c) for c in d.columns[1:]))


@query("SELECT l_returnflag, ROUND(quantile_cont(l_extendedprice, 0.5), 6) AS p_50 FROM (SELECT * FROM lineitem QUALIFY ROW_NUMBER() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey) <= 1000) GROUP BY 1")
def linear_quantiles_first(spark, sf):
    """A3 with its cap: of the first rows in a stated order."""
    return A.linear_quantiles(read(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.5], ["l_orderkey", "l_linenumber", "l_partkey"], 1000).withColumn("p_50", F.round("p_50", 6))


@query("""WITH o AS (SELECT c_nationkey, o_custkey, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey), c AS (SELECT c_nationkey, o_custkey, o_orderstatus, COUNT(*) AS n FROM o GROUP BY 1, 2, 3)
, s AS (SELECT *, n / SUM(n) OVER (PARTITION BY c_nationkey, o_custkey) AS share FROM c), u AS (SELECT c_nationkey, COUNT(DISTINCT o_custkey) AS units, CAST(SUM(n) AS BIGINT) AS samples FROM c GROUP BY 1)
SELECT s.c_nationkey, o_orderstatus, units, samples, ROUND(SUM(share) / units, 9) AS share, samples >= 30 AND units >= 3 AS supported FROM s JOIN u USING (c_nationkey) GROUP BY 1, 2, 3, 4""")
def equal_weight_shares(spark, sf):
    """Every customer counts alike."""
    d = read(spark, sf, "orders").join(read(spark, sf, "customer"), C("o_custkey") == C("c_custkey")).select("c_nationkey", "o_custkey", "o_orderstatus")
    return A.equal_weight_shares(d, ["c_nationkey"], "o_custkey", "o_orderstatus").withColumn("share", F.round("share", 9))


@query("""WITH o AS (SELECT o_orderstatus, o_custkey, AVG(o_totalprice) AS m FROM (SELECT * FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY o_orderkey) <= 3) GROUP BY 1, 2)
SELECT o_orderstatus, ROUND(AVG(m), 4) AS mean, COUNT(*) AS units FROM o GROUP BY 1""")
def mean_of_means(spark, sf):
    """A5."""
    return A.mean_of_means(read(spark, sf, "orders"), ["o_orderstatus"], "o_custkey", "o_totalprice", ["o_orderkey"], 3).withColumn("mean", F.round("mean", 4))


@query("SELECT concat_ws('/', 'event', event_type, CASE WHEN value > 50 THEN 'high' ELSE 'low' END) AS counter, COUNT(*) AS n FROM events GROUP BY 1")
def composite_counters(spark, sf):
    """A1."""
    return A.counters(read(spark, sf, "events"), F.lit("event"), "event_type", F.when(C("value") > 50, "high").otherwise("low"))


@query("SELECT role, text, COUNT(*) AS n FROM conversations WHERE length(text) BETWEEN 1 AND 160 AND NOT regexp_matches(text, '[\\x00-\\x1F\\x7F]') GROUP BY 1, 2 ORDER BY n DESC, role, text LIMIT 200")
def top_phrases(spark, sf):
    """A top-k report of whole turns."""
    return A.top_phrases(read(spark, sf, "conversations").select("role", "text"), ["role"], "text")


@query("SELECT l_suppkey, l_returnflag, COUNT(*) AS n, CAST(SUM(l_quantity) AS BIGINT) AS total FROM lineitem GROUP BY 1, 2")
def participant_facts(spark, sf):
    """Counts per participant and kind."""
    return A.participant_facts(read(spark, sf, "lineitem"), ["l_suppkey"], "l_returnflag", "l_quantity")


@query("""WITH s AS (SELECT o_custkey, COUNT(*) AS players, BOOL_OR(o_orderstatus = 'P') AS teams, CASE o_custkey % 3 WHEN 0 THEN 'team_mod' WHEN 1 THEN 'ffa_mod' ELSE 'generic' END AS adapter FROM orders GROUP BY 1)
SELECT o_custkey, CASE adapter WHEN 'team_mod' THEN CASE WHEN teams AND players > 2 THEN 'tdm' ELSE 'duel' END WHEN 'ffa_mod' THEN 'ffa' ELSE CASE WHEN teams THEN 'tdm' WHEN players = 2 THEN 'duel' WHEN players > 2 THEN 'ffa' ELSE 'unknown' END END AS mode,
 CASE adapter WHEN 'team_mod' THEN 1 WHEN 'ffa_mod' THEN 2 ELSE CASE WHEN teams OR players >= 2 THEN 1 ELSE 0 END END AS mode_conf FROM s""")
def mode_classification(spark, sf):
    """A13."""
    adapter = F.when(C("o_custkey") % 3 == 0, "team_mod").when(C("o_custkey") % 3 == 1, "ffa_mod").otherwise("generic")
    d = read(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("players"), F.bool_or(C("o_orderstatus") == "P").alias("teams")).withColumn("adapter", adapter)
    return phases.modes(d, "adapter", "teams", "players").select("o_custkey", "mode", "mode_conf")


@query("SELECT lang, source, COUNT(*) AS n, CAST(SUM(n_chars) AS BIGINT) AS chars, COUNT(DISTINCT md5(text)) AS texts FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def coverage_totals(spark, sf):
    """Frequencies, coverage and totals in one pass."""
    d = A.coverage(read(spark, sf, "documents"), ["lang", "source"], "n_chars", C("text"))
    return d.withColumnsRenamed({"total": "chars", "contents": "texts"})


@query("SELECT o_custkey, sha256(string_agg(sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority)), ',' ORDER BY o_orderkey)) AS fingerprint FROM orders GROUP BY 1")
def ordered_fingerprints(spark, sf):
    """A digest of a group's rows in order."""
    return A.fingerprints(read(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"], ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query("SELECT COUNT(*) AS n, CAST(SUM(CAST(concat('0x', substr(sha256(concat_ws('|', CAST(p_partkey AS VARCHAR), p_name, p_brand)), 1, 12)) AS BIGINT)) AS VARCHAR) AS digest FROM part")
def order_free_digest(spark, sf):
    """A digest that doesn't depend on the rows' order."""
    return A.digest(read(spark, sf, "part"), ["p_partkey", "p_name", "p_brand"]).withColumn("digest", C("digest").cast("string"))


@query("SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS customers, COUNT(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS positive FROM orders GROUP BY 1")
def distinct_groups(spark, sf):
    """A17."""
    return A.distinct_units(read(spark, sf, "orders"), ["o_orderpriority"], "o_custkey", C("o_orderstatus") == "F", "customers")


@query("WITH n AS (SELECT l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1) SELECT l_linenumber, n, ROUND(GREATEST(LEAST(SQRT((SELECT AVG(n) FROM n) / n), 4.0), 0.25), 9) AS weight FROM n")
def class_weights(spark, sf):
    """A18."""
    return A.class_weights(read(spark, sf, "lineitem"), "l_linenumber").withColumn("weight", F.round("weight", 9))


@query("""WITH t AS (SELECT l_linenumber - 2 AS target, CAST(l_quantity AS BIGINT) % 5 - 1 AS cur FROM lineitem), k AS (SELECT COUNT(CASE WHEN target >= 0 AND cur >= 0 THEN 1 END) AS known, COUNT(CASE WHEN target >= 0 AND cur >= 0 AND target <> cur THEN 1 END) AS changed FROM t)
SELECT known, changed, ROUND(GREATEST(LEAST(known / changed, 8.0), 1.0), 9) AS factor FROM k""")
def switch_factor(spark, sf):
    """A18."""
    d = read(spark, sf, "lineitem").select((C("l_linenumber") - 2).alias("target"), (C("l_quantity").cast("long") % 5 - 1).alias("cur"))
    return A.switch_factor(d, "target", "cur").withColumn("factor", F.round("factor", 9))


@query("SELECT COUNT(CASE WHEN toxic = 1 THEN 1 END) AS positive, COUNT(CASE WHEN toxic = 0 THEN 1 END) AS negative, ROUND(LEAST(SQRT(COUNT(CASE WHEN toxic = 0 THEN 1 END) / COUNT(CASE WHEN toxic = 1 THEN 1 END)), 16.0), 9) AS weight FROM labels")
def positive_weight(spark, sf):
    """A18."""
    return A.positive_weight(read(spark, sf, "labels").withColumn("m", F.lit(True)), "toxic", "m").withColumn("weight", F.round("weight", 9))


@query("WITH n AS (SELECT l_returnflag, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, l_linenumber AS majority, n FROM n QUALIFY ROW_NUMBER() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_linenumber) = 1")
def majority_class(spark, sf):
    """The least label of equally common ones."""
    return A.majority(read(spark, sf, "lineitem"), ["l_returnflag"], "l_linenumber")


@query("SELECT o_orderpriority, o_orderkey FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY sha256(CAST(o_orderkey AS VARCHAR))) <= 20")
def bottom_k_sample(spark, sf):
    """The sampling operator's own k."""
    return sampling.bottom_k(read(spark, sf, "orders"), ["o_orderpriority"], "o_orderkey", 20).select("o_orderpriority", "o_orderkey")


@query("""WITH e AS (SELECT * FROM orders WHERE o_totalprice < 300000), s AS (SELECT * FROM e QUALIFY ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY sha256(CAST(o_orderkey AS VARCHAR))) <= 10)
SELECT o_orderkey, sha256(o_orderpriority || '/' || o_orderstatus) AS code FROM s""")
def sample_then_encode(spark, sf):
    """What is costly is computed for the sampled rows only."""
    encode = lambda d: d.select("o_orderkey", F.sha2(F.concat("o_orderpriority", F.lit("/"), "o_orderstatus"), 256).alias("code"))
    return sampling.sample_then_encode(read(spark, sf, "orders"), ["o_orderpriority"], "o_orderkey", 10, C("o_totalprice") < 300000, encode)


GROUPED = """WITH p AS (SELECT DISTINCT c_mktsegment AS map, 'n' || c_nationkey AS a, 'n' || s_nationkey AS b FROM customer JOIN supplier ON c_custkey % 100 = s_suppkey)
, g AS (SELECT map, a, b, CASE WHEN a <> b THEN sha256('["' || map || '",["' || LEAST(a, b) || '","' || GREATEST(a, b) || '"]]') END AS grp FROM p)
, s AS (SELECT *, CASE WHEN grp IS NULL THEN 'quarantine' ELSE CASE CAST(concat('0x', substr(grp, 1, 8)) AS BIGINT) % 10 WHEN 8 THEN 'validation' WHEN 9 THEN 'test' ELSE 'train' END END AS split FROM g)"""


def _grouped(spark, sf):
    c, s = read(spark, sf, "customer"), read(spark, sf, "supplier")
    p = c.join(s, C("c_custkey") % 100 == C("s_suppkey")).select(C("c_mktsegment").alias("map"), F.concat(F.lit("n"), "c_nationkey").alias("a"), F.concat(F.lit("n"), "s_nationkey").alias("b")).distinct()
    g = p.withColumn("grp", sampling.pair_group(C("map"), C("a"), C("b")))
    return g.withColumn("split", sampling.split_of(C("grp")))


@query(f"{GROUPED} SELECT * FROM s")
def group_split(spark, sf):
    """Both orders of a pair are one group, and a group is in one split."""
    return _grouped(spark, sf)


@query(f"{GROUPED}, o AS (SELECT grp, CASE WHEN a < b THEN split ELSE 'test' END AS split FROM s WHERE grp IS NOT NULL) SELECT grp, COUNT(DISTINCT split) AS splits FROM o GROUP BY 1 HAVING COUNT(DISTINCT split) > 1")
def split_leaks(spark, sf):
    """U4: groups that a careless assignment puts into two splits."""
    d = _grouped(spark, sf).withColumn("split", F.when(C("a") < C("b"), C("split")).otherwise("test"))
    return sampling.leaks(d, "grp", "split")


@query("""WITH o AS (SELECT doc_id, lang, n_chars, 0 AS new FROM documents WHERE n_chars < 4000), n AS (SELECT doc_id, lang, n_chars, 1 AS new FROM documents WHERE n_chars >= 1000)
, b AS (SELECT * FROM (SELECT * FROM o UNION ALL SELECT * FROM n) QUALIFY ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY new DESC) = 1)
SELECT doc_id, lang, n_chars FROM b QUALIFY ROW_NUMBER() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR))) <= 200 // (SELECT COUNT(DISTINCT lang) FROM b)""")
def replay_merge(spark, sf):
    """Old and new rows without duplicates, shared out evenly over the maps (languages)."""
    d = read(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return sampling.replay_merge(d.where("n_chars < 4000"), d.where("n_chars >= 1000"), "doc_id", "lang", 200)


@query("""WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS v FROM orders), b AS (SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END FROM orders WHERE o_orderstatus <> 'P')
SELECT id FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id HAVING COUNT(DISTINCT v) > 1""")
def replay_conflicts(spark, sf):
    """Identities whose payload changed."""
    o = read(spark, sf, "orders")
    a = o.select(C("o_orderkey").alias("id"), C("o_orderstatus").alias("v"))
    b = o.where("o_orderstatus <> 'P'").select(C("o_orderkey").alias("id"), F.when(C("o_totalprice") > 400000, "X").otherwise(C("o_orderstatus")).alias("v"))
    return sampling.conflicts(a, b, "id", ["v"])


@query("WITH g AS (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer), f AS (SELECT *, CAST((ROW_NUMBER() OVER (PARTITION BY c_mktsegment ORDER BY sha256(CAST(c_nationkey AS VARCHAR))) - 1) % 5 AS INTEGER) AS fold FROM g) SELECT *, CASE fold WHEN 1 THEN 'validation' WHEN 2 THEN 'test' ELSE 'train' END AS role FROM f")
def group_folds(spark, sf):
    """U6."""
    return sampling.group_folds(read(spark, sf, "customer"), "c_mktsegment", "c_nationkey", 5).withColumn("role", sampling.fold_role(C("fold"), 1, 5))


@query("SELECT doc_id, sha256(text) AS h, lang IN ('en', 'fr') AS reused FROM documents")
def incremental_reuse(spark, sf):
    """Cached results where there are any, the rest computed."""
    d = read(spark, sf, "documents").select("doc_id", "text", "lang")
    work = lambda x: x.select("doc_id", F.sha2("text", 256).alias("h"))
    cached = work(d.where("lang IN ('en', 'fr')")).withColumn("reused", F.lit(True))
    return sampling.reuse_or_recompute(d, cached, ["doc_id"], lambda x: work(x).withColumn("reused", F.lit(False)))


@query("SELECT p_partkey, CASE WHEN p_size > 30 THEN 'new' WHEN p_type = 'SMALL' THEN 'issue' ELSE 'old' END AS origin FROM part WHERE p_size > 30 OR p_type = 'SMALL' OR p_size < 20")
def refresh_sources(spark, sf):
    """U8: the latest of old sources, old issues and new ones."""
    p = read(spark, sf, "part")
    part = lambda cond, name: p.where(cond).select("p_partkey", F.lit(name).alias("origin"))
    return sampling.refresh_sources(part("p_size < 20", "old"), part("p_type = 'SMALL'", "issue"), part("p_size > 30", "new"), ["p_partkey"])


@query("SELECT sha256(text) AS content_sha, MIN(doc_id) AS doc_id, COUNT(*) AS locations FROM documents GROUP BY 1")
def content_aliases(spark, sf):
    """One record a content, many locations."""
    return sampling.content_alias(read(spark, sf, "documents"), C("text"), ["doc_id"])[0]


@query("SELECT p_partkey, p_name FROM part WHERE p_size >= 10 AND p_name NOT LIKE '%ring%' ORDER BY sha256(p_name || '|' || p_partkey), p_partkey LIMIT 50")
def corpus_expansion(spark, sf):
    """The operator's own n more."""
    p = read(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    return sampling.expand(p, p.where("p_size < 10"), ["p_partkey"], C("p_name").contains("ring"), F.concat("p_name", F.lit("|"), C("p_partkey").cast("string")), 50).select("p_partkey", "p_name")


@query("""WITH r AS (SELECT CAST(o_custkey AS VARCHAR) AS rec, CASE WHEN o_orderkey % 7 = 0 THEN 'tricks' ELSE 'game' END AS role, o_orderpriority AS grp, 'test' AS split, o_orderkey FROM orders), c AS (SELECT rec, COUNT(DISTINCT role) > 1 AS conflict FROM r GROUP BY 1)
SELECT r.o_orderkey, rec, conflict, CASE WHEN conflict THEN NULL WHEN role = 'tricks' THEN 'trick-' || rec ELSE grp END AS grp, CASE WHEN conflict THEN 'quarantine' WHEN role = 'tricks' THEN 'train' ELSE split END AS split FROM r JOIN c USING (rec)""")
def role_precedence(spark, sf):
    """U11."""
    d = read(spark, sf, "orders").select("o_orderkey", C("o_custkey").cast("string").alias("rec"), F.when(C("o_orderkey") % 7 == 0, "tricks").otherwise("game").alias("role"), C("o_orderpriority").alias("grp"), F.lit("test").alias("split"))
    return sampling.roles(d, "rec", "role", "grp", "split").select("o_orderkey", "rec", "conflict", "grp", "split")


@query("SELECT p_partkey, upper(p_name) AS shown FROM part")
def memoised_by_distinct(spark, sf):
    """A costly function runs once per distinct value."""
    p = read(spark, sf, "part").select("p_partkey", "p_name")
    return sampling.by_distinct(p, ["p_name"], lambda d: d.withColumn("shown", F.upper("p_name"))).select("p_partkey", "shown")


@query("SELECT CASE WHEN l_quantity < 3 THEN 'few' WHEN l_discount > 0.08 THEN 'cheap' WHEN l_tax = 0 THEN 'untaxed' ELSE 'kept' END AS reason, COUNT(*) AS n FROM lineitem GROUP BY 1")
def reject_reasons(spark, sf):
    """the first reason counts."""
    return filters.reject_counts(read(spark, sf, "lineitem"), [("few", C("l_quantity") < 3), ("cheap", C("l_discount") > 0.08), ("untaxed", C("l_tax") == 0)])


@query("SELECT vec_id FROM embeddings WHERE list_max(list_transform(embedding, lambda x: ABS(x))) <= 0.35")
def outlier_guard(spark, sf):
    """every element finite and within bounds."""
    e = read(spark, sf, "embeddings")
    return e.where(S.finite("embedding", 64) & filters.without_outliers("embedding", 0.35)).select("vec_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def id_semi_filter(spark, sf):
    """F2, F10."""
    ids = read(spark, sf, "customer").where("c_acctbal < 0").select(C("c_custkey").alias("o_custkey"))
    return filters.of_ids(read(spark, sf, "orders"), ids, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("WITH p AS (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' OR l_quantity > 48) SELECT l_orderkey FROM p GROUP BY 1 HAVING COUNT(*) = 2 AND COUNT(DISTINCT l_suppkey) = 2")
def eligible_pairs(spark, sf):
    """F8."""
    d = read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", (C("l_returnflag") == "A").alias("active"), F.when(C("l_quantity") > 48, 1).otherwise(0).alias("kills"), F.lit(0).alias("deaths"))
    return intervals.eligible_pairs(d, ["l_orderkey"], "l_suppkey", "active", "kills", "deaths")


@query("SELECT l_orderkey, l_linenumber, l_partkey, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'")
def attach_groups(spark, sf):
    """J9."""
    g = read(spark, sf, "orders").select(C("o_orderkey").alias("l_orderkey"), "o_orderpriority", "o_orderstatus")
    return asof.attach(read(spark, sf, "lineitem"), g, ["l_orderkey"], C("o_orderstatus") == "P").select("l_orderkey", "l_linenumber", "l_partkey", "o_orderpriority")


@query("SELECT l_orderkey, COUNT(*) AS dropped FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1")
def unattached_rows(spark, sf):
    """What the join leaves out, counted."""
    g = read(spark, sf, "orders").select(C("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return asof.unattached(read(spark, sf, "lineitem"), g, ["l_orderkey"], C("o_orderstatus") == "P").groupBy("l_orderkey").agg(F.count("*").alias("dropped"))


@query("SELECT DISTINCT c_custkey, c_name, o_orderpriority FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F'")
def catalog_join(spark, sf):
    """J10."""
    return asof.catalog(read(spark, sf, "customer"), read(spark, sf, "orders"), "c_custkey", "o_custkey", C("o_orderstatus") == "F", ["c_custkey", "c_name", "o_orderpriority"])


@query("""WITH s AS (SELECT s_suppkey, 'k' || (s_suppkey % 40) AS target FROM supplier), d AS (SELECT 'k' || (n_nationkey % 18) AS target, n_nationkey FROM nation), n AS (SELECT target, COUNT(*) AS n, MIN(n_nationkey) AS k FROM d GROUP BY 1)
SELECT s_suppkey, CASE WHEN n = 1 THEN k END AS n_nationkey, CASE WHEN n IS NULL THEN 'missing_target' WHEN n > 1 THEN 'ambiguous_target' END AS reason FROM s LEFT JOIN n USING (target)""")
def named_targets(spark, sf):
    """J11."""
    s = read(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("k"), (C("s_suppkey") % 40).cast("string")).alias("target"))
    d = read(spark, sf, "nation").select(F.concat(F.lit("k"), (C("n_nationkey") % 18).cast("string")).alias("name"), "n_nationkey")
    return asof.named_target(s, d, "target", "name", ["n_nationkey"]).select("s_suppkey", "n_nationkey", "reason")


NEAREST = """WITH c AS (SELECT vec_id AS point_id, label AS klass, embedding AS v FROM embeddings WHERE vec_id < 30)
, d AS (SELECT e.vec_id, klass, point_id, list_sum(list_transform(list_zip(e.embedding, c.v), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) AS d2 FROM embeddings e, c)
, b AS (SELECT * FROM d QUALIFY ROW_NUMBER() OVER (PARTITION BY vec_id, klass ORDER BY d2, point_id) = 1)"""


def _nearest(spark, sf):
    e = read(spark, sf, "embeddings")
    points = e.where("vec_id < 30").select(C("vec_id").alias("point_id"), C("label").alias("klass"), C("embedding").alias("v"))
    return geometry.nearest(e, points, ["vec_id"], "klass", "point_id", "v", "embedding")


@query(f"{NEAREST} SELECT vec_id, klass, point_id, ROUND(d2, 6) AS d2 FROM b")
def nearest_landmarks(spark, sf):
    """The nearest landmark of each class; the landmarks are a fixed set of thirty."""
    return _nearest(spark, sf).withColumn("d2", F.round("d2", 6))


@query(f"{NEAREST}, m AS (SELECT * FROM b QUALIFY ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY d2, klass) = 1) SELECT vec_id, CASE WHEN SQRT(d2) <= 1.2 THEN 'c' || klass ELSE 'none_nearby' END AS label FROM m")
def nearest_within_radius(spark, sf):
    """J13."""
    d = geometry.nearest_class(_nearest(spark, sf), ["vec_id"], "klass", 1.2)
    return d.withColumn("label", F.when(C("label") != "none_nearby", F.concat(F.lit("c"), "label")).otherwise(C("label")))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation UNION SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey % 4 = 1), r(root, name) AS (SELECT r_regionkey, r_regionkey FROM region UNION SELECT r.root, e.b FROM r JOIN e ON r.name = e.a) SELECT root, name FROM r""")
def reachability(spark, sf):
    """Everything that firing a name reaches, each name once."""
    n = read(spark, sf, "nation")
    e = n.select(C("n_nationkey").alias("source"), ((C("n_nationkey") * 7 + 3) % 25).alias("target")).union(n.where("n_nationkey % 4 = 1").select("n_nationkey", "n_regionkey"))
    start = read(spark, sf, "region").select(C("r_regionkey").alias("root"), C("r_regionkey").alias("name"))
    return asof.closure(start, e)


@query("""WITH l AS (SELECT conv_id * 1000 + turn AS id, conv_id % 5 AS seg, turn * 100 AS t, CASE conv_id % 3 WHEN 0 THEN 'bob: ' WHEN 1 THEN 'al: ' ELSE 'x ' END || text AS text FROM conversations), k(seg, alias, s, e) AS (VALUES (0, 'bob', 0, 250), (0, 'al', 0, 900), (1, 'bob', 100, 200), (1, 'bob', 150, 300), (2, 'al', 0, 50), (3, 'bob', 0, 1000), (4, 'zed', 0, 1000))
, m AS (SELECT id, text, alias FROM l JOIN k ON l.seg = k.seg AND t BETWEEN s AND e AND starts_with(text, alias || ': ')) SELECT id, MIN(alias) AS alias, MIN(substr(text, length(alias) + 3)) AS line FROM m GROUP BY id HAVING COUNT(DISTINCT alias) = 1""")
def chat_lines(spark, sf):
    """Lines said by exactly one alias current at the time."""
    says = F.when(C("conv_id") % 3 == 0, "bob: ").when(C("conv_id") % 3 == 1, "al: ").otherwise("x ")
    l = read(spark, sf, "conversations").select((C("conv_id") * 1000 + C("turn")).alias("id"), (C("conv_id") % 5).alias("seg"), (C("turn") * 100).alias("t"), F.concat(says, "text").alias("text"))  # noqa: E741
    k = spark.createDataFrame([(0, "bob", 0, 250), (0, "al", 0, 900), (1, "bob", 100, 200), (1, "bob", 150, 300), (2, "al", 0, 50), (3, "bob", 0, 1000), (4, "zed", 0, 1000)], "seg long, alias string, s long, e long")
    return asof.spoken_lines(l, k, ["seg"], "id", "t", "text", "alias", "s", "e").select("id", "alias", "line")


SCORED = "WITH s AS (SELECT d.doc_id, lang, quality, toxic, CAST(concat('0x', substr(sha256(CAST(d.doc_id AS VARCHAR)), 1, 4)) AS BIGINT) % 101 / 100.0::DOUBLE AS p, l.doc_id % 7 <> 0 AS known FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def _scored(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "lang").join(read(spark, sf, "labels"), "doc_id")
    p = (F.conv(F.substring(F.sha2(C("doc_id").cast("string"), 256), 1, 4), 16, 10).cast("long") % 101) / 100.0
    return d.withColumn("p", p).withColumn("known", C("doc_id") % 7 != 0)


@query(f"{SCORED} SELECT COALESCE(lang, 'all') AS lang, COUNT(*) AS n, ROUND(SQRT(AVG(CASE WHEN known THEN (p - quality) * (p - quality) END)), 9) AS rmse, ROUND(AVG(CASE WHEN known THEN ABS(p - quality) END), 9) AS mae, ROUND(SQRT(AVG(CASE WHEN known THEN CAST(quality AS DOUBLE) * quality END)), 9) AS zero_rmse FROM s GROUP BY GROUPING SETS ((lang), ())")
def masked_errors(spark, sf):
    """Masked errors by language and over all, against a baseline."""
    e, m = C("p") - C("quality"), C("known")
    r = lambda c, n: F.round(c, 9).alias(n)
    return metrics.by_map_and_all(_scored(spark, sf), [], "lang", [F.count("*").alias("n"), r(metrics.rmse(e, m), "rmse"), r(metrics.mae(e, m), "mae"), r(metrics.rmse(C("quality").cast("double"), m), "zero_rmse")])


@query(f"""{SCORED} SELECT lang, COUNT(CASE WHEN known THEN 1 END) AS samples, COUNT(CASE WHEN known AND toxic = 1 THEN 1 END) AS positive, COUNT(CASE WHEN known AND toxic = 0 THEN 1 END) AS negative, ROUND(AVG(CASE WHEN known THEN (p - toxic) * (p - toxic) END), 9) AS brier,
 ROUND(AVG(CASE WHEN known THEN (0.25 - toxic) * (0.25 - toxic) END), 9) AS prior_brier, ROUND(AVG(CASE WHEN known THEN toxic END), 9) AS prevalence, ROUND(AVG(CASE WHEN known AND toxic = 1 THEN CAST(p >= 0.5 AS INT) END), 9) AS recall,
 ROUND(AVG(CASE WHEN known AND toxic = 0 THEN CAST(p < 0.5 AS INT) END), 9) AS specificity, ROUND(AVG(CASE WHEN known AND p >= 0.5 THEN CAST(toxic = 1 AS INT) END), 9) AS precision FROM s GROUP BY lang""")
def event_scores(spark, sf):
    """V2."""
    d = metrics.event_scores(_scored(spark, sf), ["lang"], "p", "toxic", "known", F.lit(0.25))
    return d.select("lang", "samples", "positive", "negative", *(F.round(c, 9).alias(c) for c in ("brier", "prior_brier", "prevalence", "recall", "specificity", "precision")))


@query(f"""{SCORED}, g AS (SELECT lang, p, COUNT(*) AS n, SUM(toxic) AS tp FROM s GROUP BY 1, 2), c AS (SELECT *, SUM(tp) OVER w AS ctp, SUM(n) OVER w AS cn, SUM(tp) OVER (PARTITION BY lang) AS pos FROM g WINDOW w AS (PARTITION BY lang ORDER BY p DESC ROWS UNBOUNDED PRECEDING))
SELECT lang, ROUND(SUM(CASE WHEN pos > 0 THEN ctp / cn * tp / pos END), 9) AS average_precision, CAST(MAX(pos) AS BIGINT) AS positive FROM c GROUP BY lang""")
def average_precision(spark, sf):
    """V3: tied scores are one threshold."""
    return metrics.average_precision(_scored(spark, sf), ["lang"], "p", "toxic").withColumn("average_precision", F.round("average_precision", 9))


CLASSES = "WITH s AS (SELECT l_returnflag, l_linenumber - 2 AS target, CAST(l_quantity AS INTEGER) % 6 AS chosen, CAST(FLOOR(l_extendedprice) AS BIGINT) % 7 - 1 AS cur, (l_discount * 9 + 0.05) AS p FROM lineitem)"


def _classes(spark, sf):
    return read(spark, sf, "lineitem").select(
        "l_returnflag", (C("l_linenumber") - 2).alias("target"), (C("l_quantity").cast("int") % 6).alias("chosen"), (F.floor("l_extendedprice") % 7 - 1).alias("cur"), (C("l_discount") * 9 + 0.05).alias("p")
    )


@query(f"""{CLASSES} SELECT l_returnflag, COUNT(CASE WHEN target >= 0 THEN 1 END) AS samples, ROUND(AVG(CASE WHEN target >= 0 THEN CAST(chosen = target AS INT) END), 9) AS accuracy, ROUND(AVG(CASE WHEN target >= 0 AND cur >= 0 THEN CAST(target = cur AS INT) END), 9) AS persistence,
 COUNT(CASE WHEN target >= 0 AND cur >= 0 AND target <> cur THEN 1 END) AS changed, ROUND(AVG(CASE WHEN target >= 0 AND cur >= 0 AND target <> cur THEN CAST(chosen = target AS INT) END), 9) AS changed_accuracy,
 ROUND(AVG(CASE WHEN target >= 0 AND cur >= 0 AND target = cur THEN CAST(chosen = target AS INT) END), 9) AS same_accuracy, ROUND(AVG(CASE WHEN target >= 0 THEN -LN(GREATEST(p, 1e-9)) END), 7) AS cross_entropy FROM s GROUP BY 1""")
def class_scores(spark, sf):
    """V4, M10."""
    d = metrics.class_scores(_classes(spark, sf), ["l_returnflag"], "chosen", "target", "cur", "p")
    r = lambda c, n=9: F.round(c, n).alias(c)
    return d.select("l_returnflag", "samples", r("accuracy"), r("persistence"), "changed", r("changed_accuracy"), r("same_accuracy"), r("cross_entropy", 7))


@query(f"""{CLASSES}, k AS (SELECT * FROM s WHERE target >= 0), a AS (SELECT l_returnflag, target AS c, COUNT(*) AS n, COUNT(CASE WHEN chosen = target THEN 1 END) AS h FROM k GROUP BY 1, 2), b AS (SELECT l_returnflag, chosen AS c, COUNT(*) AS m FROM k GROUP BY 1, 2)
SELECT a.l_returnflag, ROUND(AVG(2.0 * h / (n + COALESCE(m, 0))), 9) AS macro_f1, COUNT(*) AS classes FROM a LEFT JOIN b ON a.l_returnflag = b.l_returnflag AND a.c = b.c GROUP BY 1""")
def macro_f1(spark, sf):
    """V4."""
    return metrics.macro_f1(_classes(spark, sf), ["l_returnflag"], "chosen", "target").withColumn("macro_f1", F.round("macro_f1", 9))


@query("""WITH b AS (SELECT o_orderpriority, AVG(o_totalprice) AS loss, AVG(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS acc FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), a AS (SELECT o_orderpriority, AVG(o_totalprice) AS loss, AVG(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS acc FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT o_orderpriority, a.loss <= b.loss * 1.01 AS kept_loss, a.acc >= b.acc - 0.03 AS kept_acc, a.loss <= b.loss * 1.01 AND a.acc >= b.acc - 0.03 AS accepted FROM b JOIN a USING (o_orderpriority)""")
def retention_gates(spark, sf):
    """V5."""
    part = lambda i: read(spark, sf, "orders").where(C("o_orderkey") % 2 == i).groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("loss"), F.avg(F.when(C("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("acc"))
    return metrics.qualified(part(0), part(1), ["o_orderpriority"], {"loss": 1.01}, {"acc": -0.03})


@query("SELECT l_orderkey, l_partkey FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 2) OR l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 5000)")
def dangling_links(spark, sf):
    """V6: links with an end that isn't there."""
    nodes = read(spark, sf, "part").where("p_size > 2").select(C("p_partkey").alias("n"))
    orders = read(spark, sf, "orders").where("o_totalprice > 5000").select(C("o_orderkey").alias("n"))
    links = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return metrics.dangling(links, nodes, ["l_partkey"], "n").union(metrics.dangling(links, orders, ["l_orderkey"], "n")).distinct()


@query("SELECT COUNT(*) AS n, MIN(o_orderkey) AS least, MAX(o_orderkey) AS greatest, COUNT(DISTINCT o_orderkey) AS ids, MIN(o_orderkey) = 0 AND MAX(o_orderkey) = COUNT(*) - 1 AND COUNT(DISTINCT o_orderkey) = COUNT(*) AS ok FROM orders")
def contiguous_ids(spark, sf):
    """V6."""
    return metrics.contiguous(read(spark, sf, "orders"), "o_orderkey")


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, 'discount' AS rule FROM lineitem WHERE NOT l_discount <= 0.09 UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'quantity' FROM lineitem WHERE NOT l_quantity > 1""")
def constraint_violations(spark, sf):
    """V7: a row for every rule that a row breaks."""
    d = read(spark, sf, "lineitem").withColumn("id", C("l_orderkey") * 10 + C("l_linenumber"))
    return metrics.violations(d, "id", {"discount": C("l_discount") <= 0.09, "quantity": C("l_quantity") > 1})


@query("SELECT doc_id, 'a' AS only_in FROM documents WHERE lang = 'es' UNION ALL SELECT doc_id + 100000000, 'b' FROM documents WHERE lang = 'es'")
def table_difference(spark, sf):
    """V8: rows that only one of two tables has."""
    d = read(spark, sf, "documents")
    return metrics.same_rows(d.select("doc_id"), d.select(F.when(C("lang") == "es", C("doc_id") + 100000000).otherwise(C("doc_id")).alias("doc_id")))


@query("SELECT o_orderkey, CASE WHEN o_totalprice <> MAX(o_totalprice) OVER w THEN 'loss' WHEN COUNT(*) OVER (PARTITION BY o_custkey, o_totalprice) > 1 THEN 'draw' ELSE 'win' END AS result FROM (SELECT o_orderkey, o_custkey, FLOOR(o_totalprice / 20000) AS o_totalprice FROM orders) WINDOW w AS (PARTITION BY o_custkey)")
def score_results(spark, sf):
    """W6."""
    d = read(spark, sf, "orders").select("o_orderkey", "o_custkey", F.floor(C("o_totalprice") / 20000).alias("score"))
    return phases.results(d, ["o_custkey"], "score").select("o_orderkey", "result")


@query("""WITH r AS (SELECT o_orderkey, o_custkey, CAST(FLOOR(o_totalprice / 20000) AS BIGINT) AS s, o_orderkey % 3 AS team FROM orders), t AS (SELECT o_custkey, COALESCE(SUM(CASE WHEN team = 1 THEN s END), 0) AS a, COALESCE(SUM(CASE WHEN team = 2 THEN s END), 0) AS b FROM r GROUP BY 1)
SELECT o_orderkey, CASE WHEN team = 0 THEN 'unknown' WHEN a = b THEN 'draw' WHEN (a > b) = (team = 1) THEN 'win' ELSE 'loss' END AS result FROM r JOIN t USING (o_custkey)""")
def team_results(spark, sf):
    """W6 by teams."""
    d = read(spark, sf, "orders").select("o_orderkey", "o_custkey", F.floor(C("o_totalprice") / 20000).alias("score"), (C("o_orderkey") % 3).alias("team"))
    return phases.results(d, ["o_custkey"], "score", "team").select("o_orderkey", "result")


@query("""WITH e AS (SELECT user_id AS u, event_id AS id, (epoch_us(ts) // 1000) AS s, (epoch_us(ts) // 1000) + 3600000 AS e, LEAD((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events WHERE event_type = 'signup'), l AS (SELECT user_id AS u, event_id AS lid, (epoch_us(ts) // 1000) AS t FROM events WHERE event_type <> 'signup')
, m AS (SELECT e.u, e.id, lid, t, t <= e AS inside FROM e LEFT JOIN l ON l.u = e.u AND t BETWEEN s AND LEAST(e + 7200000, COALESCE(nx - 1, e + 7200000)))
SELECT id, COALESCE(arg_max(CASE WHEN inside THEN lid END, CASE WHEN inside THEN t END), arg_min(CASE WHEN NOT inside THEN lid END, CASE WHEN NOT inside THEN t END)) AS layout, CASE WHEN BOOL_OR(inside) THEN 'before_end' WHEN COUNT(lid) > 0 THEN 'after_end' ELSE 'no_table' END AS reason FROM m GROUP BY id""")
def final_tables(spark, sf):
    """The last layout of an epoch, else the first soon after it."""
    e = read(spark, sf, "events").select("user_id", C("event_id").alias("id"), ms("ts").alias("s"), "event_type")
    ep = e.where("event_type = 'signup'").withColumn("e", C("s") + 3600000)
    lay = e.where("event_type <> 'signup'").select("user_id", C("id").alias("lid"), C("s").alias("t"))
    return phases.boards(ep, lay, ["user_id"], "id", "s", "e", "lid", "t", 7200000).select("id", "layout", "reason")


@query("""WITH n AS (SELECT n_name, COUNT(*) AS n, MIN(s_suppkey) AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 7000 GROUP BY 1)
SELECT n_nationkey, CASE WHEN n = 1 THEN k END AS s_suppkey, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS status FROM nation LEFT JOIN n USING (n_name)""")
def unique_names(spark, sf):
    """C25."""
    n = read(spark, sf, "nation")
    s = read(spark, sf, "supplier").where("s_acctbal > 7000").join(n, C("s_nationkey") == C("n_nationkey")).select("n_name", "s_suppkey")
    return phases.unique_name(n, s, ["n_name"], ["s_suppkey"]).select("n_nationkey", "s_suppkey", "status")


@query("SELECT event_type, CAST(SUM(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, COUNT(*) AS n FROM events GROUP BY 1")
def json_payload(spark, sf):
    """T12."""
    d = read(spark, sf, "events").withColumn("p", X.payload("props", "k long"))
    return d.groupBy("event_type").agg(F.sum("p.k").alias("total"), F.count("*").alias("n"))


@query("""WITH a AS (SELECT c_custkey, lower(replace(n_name, '_', '')) AS wanted, CASE c_custkey % 5 WHEN 0 THEN n_name WHEN 1 THEN '^3-' || n_name || '-X9' WHEN 2 THEN replace(n_name, 'T', 'L') WHEN 3 THEN 'a longer name than ' || n_name ELSE c_mktsegment END AS alias FROM customer JOIN nation ON c_nationkey = n_nationkey)
, b AS (SELECT *, regexp_replace(lower(regexp_replace(alias, '\\^[0-9]', '', 'g')), '[^a-z0-9]', '', 'g') AS nick FROM a)
SELECT c_custkey, nick = wanted OR (contains(nick, wanted) AND length(nick) <= length(wanted) + 8) OR (ABS(length(nick) - length(wanted)) <= 1 AND levenshtein(nick, wanted) <= 1) AS matched FROM b""")
def fuzzy_names(spark, sf):
    """Decorated names and single typos of a wanted name."""
    d = read(spark, sf, "customer").join(read(spark, sf, "nation"), C("c_nationkey") == C("n_nationkey"))
    k, n = C("c_custkey") % 5, C("n_name")
    alias = F.when(k == 0, n).when(k == 1, F.concat(F.lit("^3-"), n, F.lit("-X9"))).when(k == 2, F.replace(n, F.lit("T"), F.lit("L"))).when(k == 3, F.concat(F.lit("a longer name than "), n)).otherwise(C("c_mktsegment"))
    return d.select("c_custkey", X.donor_match(F.array(X.nickname_ascii(alias)), X.nickname_ascii(n)).alias("matched"))


@query("SELECT p_partkey, lower(replace(p_name, ' ', '')) AS nick, lower(trim(p_name)) AS identity, substr(lower(p_name || ' of ' || p_brand), 1, 15) AS console FROM part")
def normalised_names(spark, sf):
    """Three normalisers that are not interchangeable."""
    deco = F.concat(F.lit("^1"), "p_name", F.lit("^7"))
    p = read(spark, sf, "part")
    return p.select("p_partkey", X.nickname_ascii(deco).alias("nick"), X.identity(F.array(deco, C("p_name"))).alias("identity"), X.console_name(F.concat("p_name", F.lit(" of "), "p_brand", F.lit("\t"))).alias("console"))


OBIT = """WITH l AS (SELECT o_orderkey, 'ann' || (o_orderkey % 7) || CASE o_orderkey % 6 WHEN 0 THEN ' was railed by ' WHEN 1 THEN ' ate ' WHEN 2 THEN ': hi ' WHEN 3 THEN ' saw ' WHEN 4 THEN ' was gunned down by ' ELSE ' feels ' END || 'bob' || (o_orderkey % 5) || CASE o_orderkey % 6 WHEN 1 THEN '''s rocket' WHEN 5 THEN '''s pain' ELSE '' END AS line FROM orders)"""


def _obituaries(spark, sf):
    k = C("o_orderkey")
    verb = F.when(k % 6 == 0, " was railed by ").when(k % 6 == 1, " ate ").when(k % 6 == 2, ": hi ").when(k % 6 == 3, " saw ").when(k % 6 == 4, " was gunned down by ").otherwise(" feels ")
    tail = F.when(k % 6 == 1, "'s rocket").when(k % 6 == 5, "'s pain").otherwise("")
    return read(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("ann"), (k % 7).cast("string"), verb, F.lit("bob"), (k % 5).cast("string"), tail).alias("line"))


@query(f"""{OBIT} SELECT o_orderkey, o_orderkey % 6 IN (0, 1, 4, 5) AS obituary, CASE WHEN o_orderkey % 5 < 4 THEN 'ann' || CASE WHEN o_orderkey % 7 < 5 THEN CAST(o_orderkey % 7 AS VARCHAR) ELSE '' END END AS victim, CASE WHEN o_orderkey % 5 < 4 THEN 'bob' || (o_orderkey % 5) END AS killer,
 CASE o_orderkey % 6 WHEN 0 THEN 'railgun' WHEN 1 THEN 'rocket_launcher' WHEN 4 THEN 'shotgun' WHEN 5 THEN 'grenades' END AS weapon FROM l""")
def obituaries(spark, sf):
    """T5, T6, T7."""
    roster = F.array(*(F.lit(x) for x in ["ann0", "ann1", "ann2", "ann3", "ann4", "bob0", "bob1", "bob2", "bob3", "bo", "ann"]))
    d = _obituaries(spark, sf).withColumn("who", X.obituary_names("line", roster))
    return d.select("o_orderkey", X.is_obituary("line").alias("obituary"), C("who.victim").alias("victim"), C("who.killer").alias("killer"), X.obituary_weapon("line").alias("weapon"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'q2dm' || (p_partkey % 8) END AS map, CASE p_partkey % 7 WHEN 0 THEN 'weapon' WHEN 1 THEN 'ammo' WHEN 2 THEN 'armor' WHEN 3 THEN 'health' WHEN 4 THEN 'health' WHEN 5 THEN 'capacity' ELSE 'other' END AS category,
 CASE p_partkey % 4 WHEN 0 THEN 'railgun' WHEN 1 THEN 'hyperblaster' END AS flash, CASE p_partkey % 3 WHEN 0 THEN 'item_health_mega' WHEN 1 THEN 'unknown' END AS item FROM part""")
def vocabularies(spark, sf):
    """T8, T10, T13."""
    k = C("p_partkey")
    path = F.when(k % 3 == 0, F.concat(F.lit("maps/q2dm"), (k % 8).cast("string"), F.lit(".bsp"))).otherwise("models/x.md2")
    cls = F.element_at(F.array(*map(F.lit, ["weapon_bfg", "ammo_cells", "item_armor_body", "item_health_mega", "item_adrenaline", "item_pack", "func_door"])), (k % 7 + 1).cast("int"))
    flash = F.element_at(F.array(F.lit(6), F.lit(14 + 128), F.lit(9), F.lit(11)), (k % 4 + 1).cast("int"))
    name = F.element_at(F.array(F.lit("Mega Health"), F.lit("Quad"), F.lit("")), (k % 3 + 1).cast("int"))
    return read(spark, sf, "part").select("p_partkey", X.map_name(path).alias("map"), X.category(cls).alias("category"), X.flash_weapon(flash).alias("flash"), X.pickup_item(name).alias("item"))


@query("SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"t\":\"' || event_type || '\"}' AS canonical FROM events")
def canonical_payload(spark, sf):
    """Sorted keys, no spaces."""
    e = read(spark, sf, "events")
    raw = F.concat(F.lit('{ "t": "'), "event_type", F.lit('", "k" : '), F.get_json_object("props", "$.k"), F.lit(" }"))
    return e.select("event_id", X.canonical_json(raw).alias("canonical"))


@query("SELECT c_custkey, 2 AS blocks, c_name AS name, CAST(c_nationkey AS VARCHAR) AS last FROM customer")
def entity_tokens(spark, sf):
    """Key and value blocks; the last of repeated keys counts."""
    text = F.concat(F.lit('{ "classname" "worldspawn" }\n{ "name" "'), "c_name", F.lit('" "k" "0" "k" "'), C("c_nationkey").cast("string"), F.lit('" }'))
    d = read(spark, sf, "customer").withColumn("e", X.entity_blocks(text))
    one = F.element_at("e", 2)
    return d.select("c_custkey", F.size("e").alias("blocks"), F.element_at(one, "name").alias("name"), F.element_at(one, "k").alias("last"))


# --- The declared query layer (from declaration: nothing implements it in what this follows). ---

MATCHES = """WITH m AS (SELECT o_orderkey AS id, o_custkey AS pov, (epoch_us(o_orderdate) // 1000) // 86400000 AS day, o_orderpriority AS map, o_orderkey % 4 AS mod_, CASE WHEN o_totalprice > 300000 THEN 'win' WHEN o_totalprice > 150000 THEN 'loss' ELSE 'draw' END AS result, o_orderkey % 11 AS opponent FROM orders)"""


def _matches(spark, sf):
    price = C("o_totalprice")
    return read(spark, sf, "orders").select(
        C("o_orderkey").alias("id"), C("o_custkey").alias("pov"), F.floor(ms("o_orderdate") / 86400000).alias("day"), C("o_orderpriority").alias("map"), (C("o_orderkey") % 4).alias("mod_"),
        F.when(price > 300000, "win").when(price > 150000, "loss").otherwise("draw").alias("result"), (C("o_orderkey") % 11).alias("opponent"),
    )


@query(f"{MATCHES} SELECT pov, COUNT(*) AS matches, COUNT(CASE WHEN result = 'win' THEN 1 END) AS wins, COUNT(CASE WHEN result = 'loss' THEN 1 END) AS losses, COUNT(CASE WHEN result = 'draw' THEN 1 END) AS draws FROM m WHERE day <= 10500 GROUP BY 1")
def match_totals(spark, sf):
    """Q1, from declaration."""
    return declared.totals(_matches(spark, sf).where("day <= 10500"), ["pov"], "result")


@query(f"{MATCHES} SELECT 'map' AS kind, map AS name, COUNT(*) AS matches, MIN(day) AS first_day, MAX(day) AS last_day FROM m GROUP BY 2 UNION ALL SELECT 'mod_', CAST(mod_ AS VARCHAR), COUNT(*), MIN(day), MAX(day) FROM m GROUP BY 2 UNION ALL SELECT 'opponent', CAST(opponent AS VARCHAR), COUNT(*), MIN(day), MAX(day) FROM m GROUP BY 2")
def named_buckets(spark, sf):
    """Q2, from declaration."""
    return declared.buckets(_matches(spark, sf), ["map", "mod_", "opponent"], "day")


@query(f"{MATCHES}, r AS (SELECT pov, id, day, ROW_NUMBER() OVER (PARTITION BY pov ORDER BY day DESC, id) AS rn, COUNT(*) OVER (PARTITION BY pov) AS n FROM m) SELECT pov, id, day, n > 8 AS rows_truncated FROM r WHERE rn <= 8")
def newest_rows(spark, sf):
    """Q3, from declaration: a report of the newest rows that says if there are more."""
    return declared.newest(_matches(spark, sf).select("pov", "id", "day"), ["pov"], "day", "id", 8)


@query("SELECT conv_id, turn, CASE WHEN n = 2 AND teams IS NULL THEN 'head_to_head' WHEN teams AND other THEN 'team' WHEN teams THEN 'unknown' ELSE 'placed' END AS relation FROM (SELECT conv_id, turn, COUNT(*) OVER (PARTITION BY conv_id) AS n, CASE WHEN conv_id % 3 = 0 THEN TRUE END AS teams, turn % 2 = 1 AS other FROM conversations)")
def opponent_relations(spark, sf):
    """Q4, from declaration."""
    from pyspark.sql import Window as W

    d = read(spark, sf, "conversations").select("conv_id", "turn", F.count("*").over(W.partitionBy("conv_id")).alias("n"), F.when(C("conv_id") % 3 == 0, True).alias("teams"), (C("turn") % 2 == 1).alias("other"))
    return d.select("conv_id", "turn", declared.relation(C("n"), C("teams"), C("other")).alias("relation"))


@query(f"{MATCHES} SELECT map AS name, COUNT(DISTINCT pov) AS recordings, MIN(id) AS first_id FROM m GROUP BY 1")
def discovered_names(spark, sf):
    """Q5, from declaration."""
    return declared.discovered(_matches(spark, sf), "map", "pov", "id")


@query("""WITH d AS (SELECT doc_id, sha256(text) AS h, lang || '/' || n_chars AS k FROM documents), c AS (SELECT *, COUNT(*) OVER (PARTITION BY h) AS nh, COUNT(*) OVER (PARTITION BY k) AS nk FROM d)
SELECT doc_id, CASE WHEN nh > 1 THEN 'exact' WHEN nk > 1 THEN 'maybe' ELSE 'none' END AS duplicate FROM c""")
def duplicate_flags(spark, sf):
    """Q6, from declaration."""
    d = read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.concat("lang", F.lit("/"), C("n_chars").cast("string")).alias("k"))
    return declared.duplicates(d, "h", ["k"]).select("doc_id", "duplicate")
