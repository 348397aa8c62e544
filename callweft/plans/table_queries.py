"""The operators applied to the given tables. Each query has a DuckDB counterpart in ``SQL``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweft.functions import text as tx
from callweft.operators import hierarchy, lookup, reach

QUERIES = {}
SQL = {}


def query(sql: str):
    """Register a query under its function's name with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- traces

GRAPH_SQL = """edges AS (
  SELECT DISTINCT 'n' || c_nationkey AS caller, 'c' || c_custkey AS callee FROM customer
  UNION ALL SELECT DISTINCT 'c' || o_custkey, 'o' || o_orderkey FROM orders
  UNION ALL SELECT DISTINCT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem
  UNION ALL SELECT DISTINCT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"""


def call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation -> customer -> order -> supplier -> nation: a graph with fan-out, fan-in and cycles."""
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    parts = [
        ("customer", ("n", "c_nationkey"), ("c", "c_custkey")), ("orders", ("c", "o_custkey"), ("o", "o_orderkey")),
        ("lineitem", ("o", "l_orderkey"), ("s", "l_suppkey")), ("supplier", ("s", "s_suppkey"), ("n", "s_nationkey")),
    ]
    every = None
    for source, a, b in parts:
        # Numbers are told apart before they become names: half the bytes to hash and to shuffle.
        part = table(spark, sf_dir, source).select(a[1], b[1]).distinct().select(name(*a).alias("caller"), name(*b).alias("callee"))
        every = part if every is None else every.unionByName(part)
    return every


def roots(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "root string")


REACH_SQL = """WITH RECURSIVE {graph}, r AS (
  SELECT '{root}' AS node, 0 AS depth UNION SELECT e.{to} , r.depth + 1 FROM r JOIN edges e ON e.{of} = r.node WHERE r.depth < {depth})
SELECT '{root}' AS root, node, min(depth)::INT AS depth FROM r GROUP BY node"""


@query(REACH_SQL.format(graph=GRAPH_SQL, root="c7", depth=5, of="caller", to="callee"))
def trace_reach_depth(spark, sf_dir):
    return reach.reach_depth(call_graph(spark, sf_dir), roots(spark, "c7"), 5)


@query(REACH_SQL.format(graph=GRAPH_SQL, root="s3", depth=3, of="callee", to="caller"))
def trace_callers_of_supplier(spark, sf_dir):
    return reach.reach_depth(reach.reversed_edges(call_graph(spark, sf_dir)), roots(spark, "s3"), 3)


@query(f"""WITH RECURSIVE {GRAPH_SQL}, p AS (
  SELECT 'n3' AS node, ['n3'] AS path UNION ALL
  SELECT e.callee, list_append(p.path, e.callee) FROM p JOIN edges e ON e.caller = p.node WHERE len(p.path) <= 2 AND NOT list_contains(p.path, e.callee))
SELECT array_to_string(path, '>') AS path, (len(path) - 1)::INT AS depth FROM p WHERE len(path) > 1""")
def trace_paths_limited(spark, sf_dir):
    found = reach.paths(call_graph(spark, sf_dir), roots(spark, "n3"), 2)
    return found.select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("depth"))


@query(f"""WITH {GRAPH_SQL}, one AS (SELECT callee FROM edges WHERE caller = 'n5'), two AS (SELECT DISTINCT e.callee AS node FROM one JOIN edges e ON e.caller = one.callee)
SELECT node, count(DISTINCT e.callee) AS pending FROM two LEFT JOIN edges e ON e.caller = node GROUP BY node""")
def trace_frontier_pending(spark, sf_dir):
    edges = call_graph(spark, sf_dir)
    return reach.frontier_pending(edges, reach.reach_depth(edges, roots(spark, "n5"), 2), 2).select("node", "pending")


@query(f"""WITH {GRAPH_SQL}, one AS (SELECT callee AS node, row_number() OVER (ORDER BY callee) AS k FROM edges WHERE caller = 'n2'),
l1 AS (SELECT node, k + 1 AS ord FROM one WHERE k < 500),
two AS (SELECT e.callee AS node, min(l1.ord) AS po, arg_min(l1.node, l1.ord) AS parent FROM l1 JOIN edges e ON e.caller = l1.node GROUP BY 1),
l2 AS (SELECT node, parent, row_number() OVER (ORDER BY po, node) AS k, (SELECT count(*) + 1 FROM l1) AS before FROM two)
SELECT 0 AS depth, 'n2' AS node, '' AS parent, 1::BIGINT AS ord UNION ALL SELECT 1, node, 'n2', ord FROM l1 UNION ALL SELECT 2, node, parent, k + before FROM l2 WHERE k <= 500 - before""")
def trace_fair_cap(spark, sf_dir):
    return reach.fair_cap(call_graph(spark, sf_dir), "n2", 2, 500).withColumn("parent", F.coalesce("parent", F.lit("")))


@query("SELECT l_suppkey AS caller, l_partkey AS callee, count(*) AS n_sites, min(l_orderkey) AS first_seq FROM lineitem GROUP BY 1, 2")
def edge_group_sites(spark, sf_dir):
    sites = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("caller"), F.col("l_partkey").alias("callee"), "l_orderkey")
    return reach.edge_groups(sites, "caller", "callee", "l_orderkey")


@query("SELECT depth, count(*) AS nodes, count(DISTINCT substr(node, 1, 1)) AS kinds, max(depth) OVER () AS deepest FROM (" + REACH_SQL.format(graph=GRAPH_SQL, root="n4", depth=3, of="caller", to="callee") + ") GROUP BY depth")
def tree_stats(spark, sf_dir):
    tree = reach.reach_depth(call_graph(spark, sf_dir), roots(spark, "n4"), 3)
    stats = tree.groupBy("depth").agg(F.count("*").alias("nodes"), F.count_distinct(F.substring("node", 1, 1)).alias("kinds"))
    return stats.withColumn("deepest", F.max("depth").over(Window.partitionBy(F.lit(1))))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def zero_caller_roots(spark, sf_dir):
    return reach.without_callers(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT coalesce(event_type, '(total)') AS kind, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ROLLUP (event_type)")
def entry_catalog_kinds(spark, sf_dir):
    return table(spark, sf_dir, "events").rollup("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")).select(F.coalesce("event_type", F.lit("(total)")).alias("kind"), "n", "users")


# ---------------------------------------------------------------- name resolution


@query("""WITH u AS (SELECT p_name, p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_partkey) = 1)
SELECT l_orderkey, l_linenumber, p_name, p_brand FROM lineitem JOIN u ON l_partkey = p_partkey""")
def unique_name_fallback(spark, sf_dir):
    owners = lookup.unique_owner(table(spark, sf_dir, "part"), ["p_name", "p_brand"], "p_partkey")
    calls = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return calls.join(owners, "p_partkey").select("l_orderkey", "l_linenumber", "p_name", "p_brand")


@query("""WITH b AS (SELECT p_name, p_brand, count(*) AS n, min(p_partkey) AS first, max(p_partkey) AS last FROM part GROUP BY 1, 2),
k AS (SELECT p_name, sum(n) AS total, sum(n) FILTER (p_brand = 'Brand#1') AS d, min(first) FILTER (p_brand = 'Brand#1') AS d1, max(last) FILTER (p_brand = 'Brand#1') AS d2 FROM b GROUP BY 1),
r AS (SELECT p_partkey AS caller, p_brand, b.n - 1 AS same, CASE WHEN b.first = p_partkey THEN b.last ELSE b.first END AS s1,
  coalesce(d, 0) - (p_brand = 'Brand#1')::INT AS dflt, CASE WHEN d1 = p_partkey THEN d2 ELSE d1 END AS f1, total - 1 AS others FROM part JOIN b USING (p_name, p_brand) JOIN k USING (p_name))
SELECT caller, CASE WHEN same = 1 THEN 'same' WHEN dflt = 1 THEN 'default' ELSE 'ambiguous' END AS via, CASE WHEN same = 1 THEN s1 WHEN dflt = 1 THEN f1 END AS target,
  CASE WHEN same = 1 OR dflt = 1 THEN 1 ELSE others END::BIGINT AS candidates FROM r WHERE others > 0""")
def duplicate_bucket_preference(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return lookup.bucket_choice(part, "p_partkey", "p_name", "p_brand", "Brand#1").withColumnRenamed("p_partkey", "caller")


#: Lines of a task that pairs them with those of their orders.
LINES_AT_ONCE = 250_000


@query("""WITH s AS (SELECT l.l_orderkey, l.l_linenumber, p.l_linenumber AS candidate, (CASE WHEN p.l_quantity = l.l_quantity THEN 3 WHEN abs(p.l_quantity - l.l_quantity) <= 2 THEN 2 ELSE 1 END) + (CASE WHEN p.l_extendedprice > 30000 THEN 1 ELSE 0 END) AS score
  FROM lineitem l JOIN lineitem p ON p.l_orderkey = l.l_orderkey AND p.l_linenumber <> l.l_linenumber)
SELECT l_orderkey, l_linenumber, score, candidate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY score DESC, candidate) AS k FROM s) WHERE k = 1""")
def overload_best_match(spark, sf_dir):
    """Every line with the line of the same order (its overloads: a few) that fits it best."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_extendedprice") > 30000).alias("dear"))
    # Tasks of a fixed number of lines: left to itself, Spark makes as many as there are cores, and they grow with the table.
    parts = max(spark.sparkContext.defaultParallelism, lines.count() // LINES_AT_ONCE + 1)
    lines = lines.repartition(parts, "l_orderkey")
    overloads = lines.select("l_orderkey", F.col("l_linenumber").alias("candidate"), F.col("l_quantity").alias("q"), F.col("dear").alias("c_dear"))
    close = F.when(F.col("q") == F.col("l_quantity"), 3).when(F.abs(F.col("q") - F.col("l_quantity")) <= 2, 2).otherwise(1)
    score = close + F.when(F.col("c_dear"), 1).otherwise(0)
    pairs = lines.join(overloads, "l_orderkey").filter("candidate <> l_linenumber")
    return lookup.best_number(pairs, ["l_orderkey", "l_linenumber"], score, "candidate", range(1, 5))


@query("""WITH c AS (SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey),
s AS (SELECT s_suppkey, s_nationkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0),
k AS (SELECT c_custkey, 1 AS rank, s_suppkey AS target FROM c JOIN s ON s_nationkey = c_nationkey
 UNION ALL SELECT c_custkey, 2, t FROM c JOIN (SELECT n_regionkey, min(s_suppkey) AS t FROM s GROUP BY 1) m USING (n_regionkey)
 UNION ALL SELECT c_custkey, 3, (SELECT min(s_suppkey) FROM s) FROM c)
SELECT c_custkey, rank, target FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY rank, target) AS n FROM k) WHERE n = 1""")
def scope_ranked_lookup(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    calls = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "n_regionkey")
    types = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_regionkey")
    inner = types.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("target"))
    outer = types.groupBy("n_regionkey").agg(F.min("s_suppkey").alias("target"))
    everywhere = types.agg(F.min("s_suppkey").alias("target")).filter("target is not null").withColumn("all", F.lit(1))
    return lookup.ranked_lookup(
        calls.select("c_custkey"),
        "c_custkey",
        calls.join(inner, F.col("c_nationkey") == F.col("s_nationkey")),
        calls.join(outer, "n_regionkey"),
        calls.withColumn("all", F.lit(1)).join(everywhere, "all"),
    )


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS declared_at FROM events""")
def nearest_declaration(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    last = lookup.last_before(events, "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "click", F.col("event_id")))
    return events.select("event_id", last.alias("declared_at"))


@query("""SELECT DISTINCT p.event_id, c.event_id AS evidence FROM events p JOIN events c ON c.user_id = p.user_id AND c.ts < p.ts WHERE p.event_type = 'purchase' AND c.event_type = 'click'""")
def range_evidence_before(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    uses = events.filter("event_type = 'purchase'").drop("event_type")
    return lookup.evidence_before(uses, events.filter("event_type = 'click'"), "user_id", "ts", "event_id").select("event_id", "evidence")


OPS = [("insert", ["signup", "purchase"]), ("update", ["view", "click"]), ("upsert", ["signup", "purchase", "view", "click"]), ("delete", ["error"])]


@query("""WITH ops(op, events) AS (VALUES ('insert', ['signup', 'purchase']), ('update', ['view', 'click']), ('upsert', ['signup', 'purchase', 'view', 'click']), ('delete', ['error'])),
u AS (SELECT user_id, list(DISTINCT event_type) AS types FROM events GROUP BY 1)
SELECT op, user_id FROM ops JOIN u ON list_has_any(events, types)""")
def op_event_overlap_join(spark, sf_dir):
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("types"))
    ops = spark.createDataFrame(OPS, "op string, events array<string>")
    return lookup.overlap_join(ops, users, "events", "types").select("op", "user_id")


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 400000) AS shadowed FROM customer""")
def static_semi_anti(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    big = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F' AND o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    yes = customers.join(big, "c_custkey", "left_semi").withColumn("shadowed", F.lit(True))
    return yes.unionByName(customers.join(big, "c_custkey", "left_anti").withColumn("shadowed", F.lit(False)))


# ---------------------------------------------------------------- hierarchies

TYPES_SQL = """parents AS (
  SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'r' || r_regionkey, 'base' FROM region)"""
CLOSED_SQL = "closed AS (SELECT child, parent AS ancestor, 1 AS hops FROM parents UNION ALL SELECT c.child, p.parent, c.hops + 1 FROM closed c JOIN parents p ON p.child = c.ancestor)"


def type_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    nations = table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent"))
    suppliers = table(spark, sf_dir, "supplier").select(name("s", "s_suppkey").alias("child"), name("n", "s_nationkey").alias("parent"))
    regions = table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("child"), F.lit("base").alias("parent"))
    return nations.unionByName(suppliers).unionByName(regions)


@query(f"WITH RECURSIVE {TYPES_SQL}, {CLOSED_SQL} SELECT child, ancestor, hops::INT AS hops FROM closed")
def hierarchy_closure(spark, sf_dir):
    return hierarchy.closure(type_parents(spark, sf_dir))


DECLARED_SQL = """declared AS (SELECT 'r' || r_regionkey AS owner, 'run' AS method FROM region UNION ALL SELECT 's' || s_suppkey, 'run' FROM supplier WHERE s_acctbal < 3000
  UNION ALL SELECT 'base', 'init' UNION ALL SELECT 'n' || n_nationkey, 'init' FROM nation WHERE n_nationkey % 3 = 0)"""


def declared_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string")).alias("owner")
    run, init = F.lit("run").alias("method"), F.lit("init").alias("method")
    found = table(spark, sf_dir, "region").select(name("r", "r_regionkey"), run)
    found = found.unionByName(table(spark, sf_dir, "supplier").filter("s_acctbal < 3000").select(name("s", "s_suppkey"), run))
    found = found.unionByName(spark.createDataFrame([("base", "init")], "owner string, method string"))
    return found.unionByName(table(spark, sf_dir, "nation").filter("n_nationkey % 3 = 0").select(name("n", "n_nationkey"), init))


@query(f"""WITH RECURSIVE {TYPES_SQL}, {CLOSED_SQL}, {DECLARED_SQL}
SELECT a.owner, a.method, b.owner AS descendant FROM closed JOIN declared a ON a.owner = ancestor JOIN declared b ON b.owner = child AND b.method = a.method""")
def override_fanout(spark, sf_dir):
    declared = declared_methods(spark, sf_dir)
    return hierarchy.override_fanout(declared, declared, hierarchy.closure(type_parents(spark, sf_dir)))


@query(f"""WITH RECURSIVE {TYPES_SQL}, {CLOSED_SQL}, {DECLARED_SQL}, w AS (SELECT 's' || s_suppkey AS owner, m AS method FROM supplier, (VALUES ('run'), ('init')) v(m)),
k AS (SELECT w.owner, w.method, w.owner AS a, 0 AS hops FROM w UNION ALL SELECT w.owner, w.method, ancestor, closed.hops FROM w JOIN closed ON child = w.owner)
SELECT k.owner, k.method, arg_min(a, hops) AS declared_in, min(hops)::INT AS hops FROM k JOIN declared d ON d.owner = a AND d.method = k.method GROUP BY 1, 2""")
def nearest_owner(spark, sf_dir):
    wanted = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("owner"), F.explode(F.array(F.lit("run"), F.lit("init"))).alias("method"))
    return hierarchy.nearest_owner(wanted, declared_methods(spark, sf_dir), hierarchy.closure(type_parents(spark, sf_dir)))


@query(f"""WITH RECURSIVE {TYPES_SQL}, {CLOSED_SQL}, c AS (SELECT c_custkey AS site, CASE WHEN c_custkey % 7 = 0 THEN 'base' WHEN c_custkey % 2 = 0 THEN 'n' || c_nationkey ELSE 'r' || (c_nationkey % 5) END AS caught FROM customer)
SELECT DISTINCT site, caught, 's1' AS type FROM c WHERE caught IN (SELECT ancestor FROM closed WHERE child = 's1') OR caught IN ('s1', 'base')""")
def catch_ancestor_match(spark, sf_dir):
    key = F.col("c_custkey")
    nation = F.col("c_nationkey")
    caught = F.when(key % 7 == 0, "base").when(key % 2 == 0, F.concat(F.lit("n"), nation.cast("string"))).otherwise(F.concat(F.lit("r"), (nation % 5).cast("string")))
    catches = table(spark, sf_dir, "customer").select(key.alias("site"), caught.alias("caught"))
    throws = spark.createDataFrame([("s1",)], "type string")
    return hierarchy.catchers(throws, catches, hierarchy.closure(type_parents(spark, sf_dir)), "base")


@query("SELECT o_custkey, min(o_orderstatus) AS literal FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1")
def literal_flow_single_assign(spark, sf_dir):
    return lookup.unique_owner(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus").withColumnRenamed("o_orderstatus", "literal")


# ---------------------------------------------------------------- extraction

@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
t AS (SELECT DISTINCT doc_id, n, unnest(regexp_extract_all(line, '[A-Za-z]{6,}')) AS token FROM l),
u AS (SELECT token FROM t GROUP BY 1 HAVING count(DISTINCT doc_id) = 1)
SELECT doc_id, token, n::INT AS line FROM t JOIN u USING (token)""")
def lexical_mentions(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    tokens = lines.select("doc_id", (F.col("n") + 1).alias("line"), F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit("[A-Za-z]{6,}"), F.lit(0)))).alias("token"))
    return tokens.join(lookup.unique_owner(tokens, ["token"], "doc_id").select("token"), "token").select("doc_id", "token", "line")


@query(r"""SELECT page_id, length(html) AS n_before, length(x) AS n_after, md5(x) AS hash FROM (
  SELECT page_id, html, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<script>.*?</script>', '', 'g') AS x FROM pages)""")
def strip_comments(spark, sf_dir):
    blank = tx.blank_keeping_lines(F.col("html"), r"(?s)<!--.*?-->", r"(?s)<script>.*?</script>")
    out = table(spark, sf_dir, "pages").select("page_id", F.char_length("html").cast("long").alias("n_before"), blank.alias("x"))
    return out.select("page_id", "n_before", F.char_length("x").cast("long").alias("n_after"), F.md5("x").alias("hash"))


@query("""SELECT page_id, unnest(l) AS href, generate_subscripts(l, 1)::INT AS at FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)""")
def html_link_extract(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(links).alias("p", "href")).select("page_id", "href", (F.col("p") + 1).alias("at"))


@query("""SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""")
def html_root_attr(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("""WITH h AS (SELECT page_id, string_split(regexp_extract(url, '://([^/]*)', 1), '.') AS p FROM pages)
SELECT page_id, array_to_string(p[:greatest(len(p) - 2, 0)], '.') AS namespace, array_to_string(p[greatest(len(p) - 1, 1):], '.') AS tail FROM h""")
def url_namespace_split(spark, sf_dir):
    namespace, tail = tx.namespace_split(F.regexp_extract("url", "://([^/]*)", 1), 2)
    return table(spark, sf_dir, "pages").select("page_id", namespace.alias("namespace"), tail.alias("tail"))


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1")
def json_props_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT page_id, unnest(l) AS tag, generate_subscripts(l, 1) AS at FROM (SELECT page_id, regexp_extract_all(html, '<(/?(?:p|h1|b|li))>', 1) AS l FROM pages))
SELECT page_id, a.at::INT AS opened, min(b.at)::INT AS closed FROM t a JOIN t b USING (page_id) WHERE a.tag = 'p' AND b.tag = '/p' AND b.at > a.at GROUP BY 1, 2""")
def script_next_tag_pair(spark, sf_dir):
    tags = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<(/?(?:p|h1|b|li))>"), F.lit(1))).alias("at", "tag"))
    w = Window.partitionBy("page_id").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    following = F.first(F.when(F.col("tag") == "/p", F.col("at")), ignorenulls=True).over(w)
    return tags.withColumn("closed", following + 1).filter("tag = 'p' AND closed IS NOT NULL").select("page_id", (F.col("at") + 1).alias("opened"), "closed")


@query(r"""SELECT doc_id, CASE WHEN o > 0 THEN 1 + length(substr(text, 1, o - 1)) - length(replace(substr(text, 1, o - 1), chr(10), '')) ELSE 0 END::INT AS line FROM (
  SELECT doc_id, text, CASE WHEN regexp_matches(text, '[a-z]{9,}') THEN strpos(text, regexp_extract(text, '[a-z]{9,}')) ELSE 0 END AS o FROM documents)""")
def line_of_offset(spark, sf_dir):
    first = F.regexp_extract("text", "[a-z]{9,}", 0)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("text").rlike("[a-z]{9,}"), F.position(first, F.col("text"))).otherwise(0).alias("o"))
    return docs.select("doc_id", tx.line_of(F.col("text"), F.col("o")).cast("int").alias("line"))


# ---------------------------------------------------------------- freshness, grouping, rendering

@query("""WITH cache AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 3 <> 0)
SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM cache c WHERE c.doc_id = d.doc_id AND c.n_chars = d.n_chars) THEN 'cached' ELSE 'parsed' END AS state FROM documents d""")
def incremental_anti(spark, sf_dir):
    from callweft.sources.incremental import split_fresh

    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    cache = docs.filter("doc_id % 3 <> 0").withColumn("n_chars", F.when(F.col("doc_id") % 10 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    fresh, stale = split_fresh(docs, cache, ["doc_id", "n_chars"])
    return fresh.select("doc_id", F.lit("cached").alias("state")).unionByName(stale.select("doc_id", F.lit("parsed").alias("state")))


@query("""SELECT u.conv_id, u.turn AS asked, min(a.turn) AS answered FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn > u.turn WHERE u.role = 'user' AND a.role = 'assistant' GROUP BY 1, 2""")
def bundle_group_join(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    asked = turns.filter("role = 'user'").select("conv_id", F.col("turn").alias("asked"))
    answers = turns.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("t"))
    return asked.join(answers, "conv_id").filter("t > asked").groupBy("conv_id", "asked").agg(F.min("t").alias("answered"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'part: ' || l_partkey || ', supplier: ' || l_suppkey ELSE l_partkey || ', ' || l_suppkey || ', ' || l_returnflag END AS args FROM lineitem""")
def args_zip_render(spark, sf_dir):
    names = F.array(F.lit("part"), F.lit("supplier"))
    two = F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    values = F.when(F.col("l_linenumber") % 2 == 0, two).otherwise(F.concat(two, F.array("l_returnflag")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tx.render_args(names, values).alias("args"))


@query("""SELECT greatest(least(trunc(o_totalprice / 1000)::BIGINT, 300), 10) AS bucket, count(*) AS n FROM orders GROUP BY 1""")
def clamp_buckets(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(tx.clamp(F.col("o_totalprice") / 1000, 10, 300, 10).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT md5(text) AS identity, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def dedupe_first_wins(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("identity")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("""WITH k(prefix, label) AS (VALUES ('http://', 'plain'), ('https://', 'secure'), ('https://m.', 'mobile'), ('https://m.th', 'deep')),
j AS (SELECT page_id, prefix, label, row_number() OVER (PARTITION BY page_id ORDER BY length(prefix) DESC) AS r FROM pages LEFT JOIN k ON starts_with(url, prefix))
SELECT page_id, prefix, label FROM j WHERE r = 1""")
def package_longest_prefix(spark, sf_dir):
    packages = spark.createDataFrame([("http://", "plain"), ("https://", "secure"), ("https://m.", "mobile"), ("https://m.th", "deep")], "prefix string, label string")
    return lookup.longest_prefix(table(spark, sf_dir, "pages").select("page_id", "url"), "url", packages, "prefix").select("page_id", "prefix", "label")


@query("""SELECT doc_id, toxic, source FROM documents JOIN labels USING (doc_id) ORDER BY toxic, lower(source), doc_id LIMIT 50""")
def sort_tests_last(spark, sf_dir):
    labelled = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    return labelled.orderBy("toxic", F.lower("source"), "doc_id").limit(50).select("doc_id", "toxic", "source")


@query("""WITH l AS (SELECT n_regionkey AS region, s_nationkey AS nation, s_suppkey AS leaf, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_nationkey, s_suppkey) AS place FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT region, nation, round(avg(place), 4) AS row_at, count(*) AS leaves FROM l GROUP BY 1, 2""")
def tree_layout_rows(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    leaves = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("region"), F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("leaf"))
    placed = reach.layout_rows(leaves, "region", ["nation", "leaf"])
    return placed.groupBy("region", "nation").agg(F.round(F.avg("row_at"), 4).alias("row_at"), F.count("*").alias("leaves"))


@query("""WITH p AS (SELECT ['c' || c_custkey, 'n' || c_nationkey, 'r' || n_regionkey] AS path FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT DISTINCT array_to_string(path[1:d], '>') AS prefix, CASE WHEN d > 1 THEN array_to_string(path[1:d - 1], '>') END AS parent, path[d] AS node, d::INT AS depth FROM p, (VALUES (1), (2), (3)) v(d)""")
def entry_first_reroot(spark, sf_dir):
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return reach.entry_first(joined.select(F.array(name("r", "n_regionkey"), name("n", "c_nationkey"), name("c", "c_custkey")).alias("path")))


@query("""SELECT 'both' AS kind, x AS nation FROM (SELECT s_nationkey AS x FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)
UNION ALL SELECT 'only_supplier', x FROM (SELECT s_nationkey AS x FROM supplier EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)
UNION ALL SELECT 'either', x FROM (SELECT s_nationkey AS x FROM supplier UNION SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)""")
def set_ops(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    b = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"))
    named = lambda kind, df: df.select(F.lit(kind).alias("kind"), "nation")
    return named("both", a.intersect(b)).unionByName(named("only_supplier", a.subtract(b))).unionByName(named("either", a.union(b).distinct()))


@query("""SELECT regexp_extract(url, '://([^/]*)', 1) AS host, count(*) AS refs, count(DISTINCT regexp_extract(html, 'lang="([^"]*)"', 1)) AS langs FROM pages GROUP BY 1""")
def external_refcount(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "://([^/]*)", 1).alias("host")).agg(F.count("*").alias("refs"), F.count_distinct(F.regexp_extract("html", 'lang="([^"]*)"', 1)).alias("langs"))


@query("""SELECT l_suppkey, count(*) AS calls, count(*) FILTER (l_returnflag = 'R') AS unresolved, count(*) FILTER (l_quantity > 45) AS over_cap FROM lineitem GROUP BY 1""")
def unresolved_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("calls"), F.count_if(F.col("l_returnflag") == "R").alias("unresolved"), F.count_if(F.col("l_quantity") > 45).alias("over_cap"))


@query("SELECT o_custkey, bool_and(o_orderstatus = 'F') AS approximate FROM orders GROUP BY 1")
def approx_every(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.every(F.col("o_orderstatus") == "F").alias("approximate"))


# ---------------------------------------------------------------- many roots, joined catalogs


@query(f"""WITH RECURSIVE {GRAPH_SQL}, r AS (
  SELECT 'n' || n_nationkey AS root, 'n' || n_nationkey AS node, 0 AS depth FROM nation
  UNION SELECT r.root, e.callee, r.depth + 1 FROM r JOIN edges e ON e.caller = r.node WHERE r.depth < 2)
SELECT root, depth, count(*) AS nodes FROM (SELECT root, node, min(depth)::INT AS depth FROM r GROUP BY 1, 2) GROUP BY 1, 2""")
def trace_many_roots(spark, sf_dir):
    starts = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("root"))
    return reach.reach_depth(call_graph(spark, sf_dir), starts, 2).groupBy("root", "depth").agg(F.count("*").alias("nodes"))


@query("""SELECT user_id, event_type, count(*) AS n, min(ts) AS first_at, arg_min(event_id, (ts, event_id)) AS first_event FROM events GROUP BY 1, 2""")
def first_construction(spark, sf_dir):
    """The first site of each key (by time, then id) and how many there are."""
    firsts = F.min(F.struct("ts", "event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), firsts.alias("f")).select("user_id", "event_type", "n", F.col("f.ts").alias("first_at"), F.col("f.event_id").alias("first_event"))


@query("""WITH s AS (SELECT l_suppkey AS owner, l_returnflag AS entry, min(l_orderkey) AS seq FROM lineitem GROUP BY 1, 2)
SELECT owner, string_agg(entry, ',' ORDER BY seq, entry) AS entries FROM s GROUP BY 1""")
def entry_rollup(spark, sf_dir):
    """Distinct entries of an owner in the order of their first appearance."""
    seen = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("owner"), F.col("l_returnflag").alias("entry")).agg(F.min("l_orderkey").alias("seq"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "entry"))), lambda s: s["entry"])
    return seen.groupBy("owner").agg(F.array_join(ordered, ",").alias("entries"))


@query("""SELECT n_name AS name, n AS copies FROM (SELECT p_name AS n_name, count(DISTINCT p_brand) AS n FROM part GROUP BY 1) WHERE n > 1""")
def duplicate_names(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.count_distinct("p_brand").alias("copies")).filter("copies > 1")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS following FROM orders)
SELECT o_custkey, o_orderkey, following FROM o WHERE following IS NOT NULL""")
def next_site_pair(spark, sf_dir):
    """Each site with the next one of its key (forward as-of along one order)."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lead("o_orderdate").over(w).alias("following")).filter("following IS NOT NULL")


@query("""SELECT sha1(string_agg(r_name, '|' ORDER BY r_name))[1:16] AS snapshot FROM region""")
def snapshot_key(spark, sf_dir):
    names = F.array_join(F.array_sort(F.collect_list("r_name")), "|")
    return table(spark, sf_dir, "region").agg(F.substring(F.sha1(names), 1, 16).alias("snapshot"))
