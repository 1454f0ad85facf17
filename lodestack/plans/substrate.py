"""Stand-ins built of the star-schema tables where the test data has no table of the kind, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.runtime import table


def part_names(spark, d):  # noqa: ANN001, ANN202
    """p_partkey, kind, name: five spellings of part names, so that there is something to resolve."""
    k, n = F.col("p_partkey") % 5, F.col("p_name")
    name = F.when(k == 0, n).when(k == 1, F.concat(F.upper(n), F.lit("!"))).when(k == 2, F.concat(n, F.lit(" model"))).when(k == 3, F.concat(n, F.lit(" steel grade a"))).otherwise(F.concat(n, F.lit(" steel grade b")))
    return table(spark, d, "part").select("p_partkey", F.col("p_type").alias("kind"), name.alias("name"), "p_name", "p_size", "p_retailprice")


NAMES = """names AS (SELECT p_partkey, p_type AS kind, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) || '!' WHEN 2 THEN p_name || ' model'
  WHEN 3 THEN p_name || ' steel grade a' ELSE p_name || ' steel grade b' END AS name, p_name, p_size, p_retailprice FROM part)"""


def mentions(spark, d):  # noqa: ANN001, ANN202
    """kind, name, artifact_id, confidence: a line item mentions its part in its order."""
    li = table(spark, d, "lineitem").select("l_partkey", F.concat(F.lit("doc_"), F.col("l_orderkey").cast("string")).alias("artifact_id"), F.round(F.col("l_discount") * 10, 2).alias("confidence"), F.col("l_orderkey"))
    return li.join(part_names(spark, d), F.col("l_partkey") == F.col("p_partkey")).select("kind", "name", "artifact_id", "confidence")


MENTIONS = f"""{NAMES}, m AS (SELECT kind, name, 'doc_' || l_orderkey AS artifact_id, round(l_discount * 10, 2) AS confidence FROM lineitem JOIN names ON l_partkey = p_partkey)"""


def norm_sql(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}_\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"


GENERIC = "['model', 'framework', 'process', 'approach', 'strategy', 'initiative', 'programme', 'program', 'system', 'platform', 'capability', 'team']"


def tokens_sql(n: str) -> str:
    words = f"list_distinct(list_filter(string_split({n}, ' '), lambda w: w <> ''))"
    rest = f"list_filter({words}, lambda w: NOT list_contains({GENERIC}, w))"
    return f"CASE WHEN len({rest}) > 0 THEN {rest} ELSE {words} END"


def grams_sql(n: str) -> str:
    return f"list_distinct(list_transform(generate_series(1, length({n}) + 1), lambda i: substr('  ' || {n} || ' ', i, 3)))"


def slug_sql(c: str) -> str:
    s = f"regexp_replace(regexp_replace(lower(trim(coalesce({c}, ''))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"CASE WHEN {s} = '' THEN 'unnamed' ELSE {s} END"


#: Over a pair of rows l and r with norm, tokens and grams.
SCORE = """CASE WHEN l.norm = '' OR r.norm = '' THEN 0 WHEN l.norm = r.norm THEN 1 ELSE greatest(0, least(1, CASE
  WHEN least(len(l.tokens), len(r.tokens)) >= 2 AND len(list_intersect(l.tokens, r.tokens)) = least(len(l.tokens), len(r.tokens))
  THEN greatest(0.5 * J + 0.5 * D, CAST(0.88 AS DOUBLE) + CAST(0.12 AS DOUBLE) * J) ELSE 0.5 * J + 0.5 * D END)) END""".replace(
    "J", "(len(list_intersect(l.tokens, r.tokens))::DOUBLE / greatest(1, len(l.tokens) + len(r.tokens) - len(list_intersect(l.tokens, r.tokens))))"
).replace("D +", "D +").replace("* D", "* (2.0::DOUBLE * len(list_intersect(l.grams, r.grams)) / (len(l.grams) + len(r.grams)))")


def relationships(spark, d):  # noqa: ANN001, ANN202
    """source, predicate, target, confidence, shipped: a part is supplied, returned or listed by a supplier, and suppliers stand in nations, nations in regions."""
    li = table(spark, d, "lineitem").select(
        F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("source"),
        F.when(F.col("l_returnflag") == "A", "supports").when(F.col("l_returnflag") == "N", "depends_on").otherwise("related_to").alias("predicate"),
        F.concat(F.lit("supplier/"), F.col("l_suppkey").cast("string")).alias("target"),
        F.round(F.col("l_discount") * 10, 2).alias("confidence"),
        F.col("l_shipdate").cast("timestamp").alias("shipped"),
    )
    return li


RELATIONSHIPS = """rel AS (SELECT 'part/' || l_partkey AS source, CASE l_returnflag WHEN 'A' THEN 'supports' WHEN 'N' THEN 'depends_on' ELSE 'related_to' END AS predicate,
  'supplier/' || l_suppkey AS target, round(l_discount * 10, 2) AS confidence, l_shipdate AS shipped FROM lineitem)"""


def hierarchy(spark, d):  # noqa: ANN001, ANN202
    """source, predicate, target: customers and suppliers in nations, nations in regions."""
    node = lambda kind, c: F.concat(F.lit(kind + "/"), F.col(c).cast("string"))
    c = table(spark, d, "customer").select(node("customer", "c_custkey").alias("source"), F.lit("depends_on").alias("predicate"), node("nation", "c_nationkey").alias("target"))
    s = table(spark, d, "supplier").select(node("supplier", "s_suppkey").alias("source"), F.lit("supports").alias("predicate"), node("nation", "s_nationkey").alias("target"))
    n = table(spark, d, "nation").select(node("nation", "n_nationkey").alias("source"), F.lit("owned_by").alias("predicate"), node("region", "n_regionkey").alias("target"))
    return c.unionByName(s).unionByName(n)


HIERARCHY = """h AS (SELECT 'customer/' || c_custkey AS source, 'depends_on' AS predicate, 'nation/' || c_nationkey AS target FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey, 'supports', 'nation/' || s_nationkey FROM supplier UNION ALL SELECT 'nation/' || n_nationkey, 'owned_by', 'region/' || n_regionkey FROM nation)"""


def vertices(spark, d):  # noqa: ANN001, ANN202
    """id, kind, label, confidence of the hierarchy's nodes."""
    def of(name, kind, key, label, conf):  # noqa: ANN001, ANN202
        return table(spark, d, name).select(F.concat(F.lit(kind.lower() + "/"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col(label).alias("label"), conf.alias("confidence"))

    bal = lambda c: F.round((F.col(c) + 1000) / 11000, 3)
    out = of("customer", "Customer", "c_custkey", "c_name", bal("c_acctbal"))
    out = out.unionByName(of("supplier", "Supplier", "s_suppkey", "s_name", bal("s_acctbal")))
    return out.unionByName(of("nation", "Nation", "n_nationkey", "n_name", F.lit(0.9))).unionByName(of("region", "Region", "r_regionkey", "r_name", F.lit(1.0)))


VERTICES = """v AS (SELECT 'customer/' || c_custkey AS id, 'Customer' AS kind, c_name AS label, round((c_acctbal + 1000) / 11000, 3) AS confidence FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey, 'Supplier', s_name, round((s_acctbal + 1000) / 11000, 3) FROM supplier
  UNION ALL SELECT 'nation/' || n_nationkey, 'Nation', n_name, 0.9 FROM nation UNION ALL SELECT 'region/' || r_regionkey, 'Region', r_name, 1.0 FROM region)"""
