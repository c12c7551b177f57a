"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import corpus, crowd, enrich, evaluate, fuse, match, overlap, stats
from ..sources import alignment as A
from ..sources import dumps, ntriples
from .adapter import cte, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CASES = """len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: (substr({a}, i, 1) <> lower(substr({a}, i, 1)) AND substr({b}, i, 1) <> lower(substr({b}, i, 1)))
  OR (substr({a}, i, 1) <> upper(substr({a}, i, 1)) AND substr({b}, i, 1) <> upper(substr({b}, i, 1)))))"""
INDEX = "idx AS (SELECT domain, lower(trim(label)) AS key, label, s AS resource FROM kg_labels)"
MET = f"""met AS (SELECT a.domain, a.s AS source, a.label, b.domain AS target_domain, b.resource, CAST({CASES.format(a="trim(a.label)", b="b.label")} AS BIGINT) AS score
  FROM (SELECT DISTINCT domain, s, label FROM kg_labels) a JOIN idx b ON lower(trim(a.label)) = b.key AND a.domain <> b.domain)"""
NEAR = f"""near AS (SELECT a.s AS source, a.label, b.resource, CAST({CASES.format(a="trim(a.label)", b="b.label")} AS BIGINT) AS score
  FROM kg_labels a JOIN idx b ON lower(trim(a.label)) = b.key AND b.domain = 'Brand#1' WHERE a.domain <> 'Brand#1'),
nearest AS (SELECT source, label, resource AS target, score FROM (SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY score DESC, resource) AS rn FROM near) WHERE rn = 1)"""
COSINE = "list_inner_product({a}::DOUBLE[], {b}::DOUBLE[]) / sqrt(list_inner_product({a}::DOUBLE[], {a}::DOUBLE[]) * list_inner_product({b}::DOUBLE[], {b}::DOUBLE[]))"


def labels(spark, d):
    return view(spark, d, "kg_labels")


def index(spark, d):
    return match.label_index(labels(spark, d))


def one_brand(spark, d):
    return index(spark, d).where("domain = 'Brand#1'"), labels(spark, d).where("domain <> 'Brand#1'")


# --- matching ---------------------------------------------------------------------------------------------------


@query(f"""{cte("kg_labels")}, {INDEX}, {MET}
SELECT domain, source, label, target_domain, arg_min(resource, struct_pack(s := -score, r := resource)) AS target, max(score) AS score, CAST(count(*) AS BIGINT) AS n
FROM met GROUP BY domain, source, label, target_domain""")
def interwiki_best_match(spark, d):
    return match.all_match(labels(spark, d), index(spark, d))


@query(f"""{cte("kg_labels")}, {INDEX}, {MET}, n AS (SELECT domain, key, count(*) AS n FROM idx GROUP BY ALL)
SELECT m.domain, source, m.label, target_domain, resource AS target, score, CAST(n AS BIGINT) AS n FROM met m JOIN n ON n.domain = target_domain AND n.key = lower(trim(m.label))""")
def interwiki_candidates_all(spark, d):
    return match.all_match(labels(spark, d), index(spark, d), choose_best=False)


@query(f"{cte('kg_labels')}, {INDEX} SELECT domain, key, CAST(count(*) AS BIGINT) AS n FROM idx GROUP BY domain, key")
def label_ambiguity(spark, d):
    return match.ambiguity(index(spark, d))


@query(f"{cte('kg_labels')}, {INDEX}, {NEAR} SELECT source, label, target, score FROM nearest")
def single_target_match(spark, d):
    i, probe = one_brand(spark, d)
    return match.near_match(probe, i)


@query(f"""{cte("kg_labels")}, {INDEX}, {NEAR.replace("'Brand#1'", "'Brand#3'")}, second AS (SELECT a.s AS source, a.label, b.resource, CAST({CASES.format(a="trim(a.label)", b="b.label")} AS BIGINT) AS score
  FROM kg_labels a JOIN idx b ON lower(trim(a.label)) = b.key AND b.domain = 'Brand#4' WHERE a.domain <> 'Brand#3' AND NOT EXISTS (SELECT 1 FROM near n WHERE n.source = a.s AND n.label = a.label))
SELECT source, label, target, score FROM nearest
UNION ALL SELECT source, label, resource, score FROM (SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY score DESC, resource) AS rn FROM second) WHERE rn = 1""")
def two_tier_match(spark, d):
    i = index(spark, d)
    return match.near_match_cascade(labels(spark, d).where("domain <> 'Brand#3'"), i.where("domain = 'Brand#3'"), i.where("domain = 'Brand#4'"))


@query(f"""{cte("kg_labels", "kg_vectors")}, {INDEX}, {NEAR}
SELECT source, label, target, round(coalesce({COSINE.format(a="a.vector", b="b.vector")}, 1.0), 6) AS confidence
FROM nearest LEFT JOIN kg_vectors a ON a.uri = source LEFT JOIN kg_vectors b ON b.uri = target""")
def vector_match(spark, d):
    i, probe = one_brand(spark, d)
    return match.vector_near_match(probe, i, view(spark, d, "kg_vectors")).withColumn("confidence", F.round("confidence", 6))


@query(f"""{cte("kg_labels", "kg_vectors", "kg_disambiguations")}, {INDEX}, {NEAR},
plain AS (SELECT source, label, target, round(coalesce({COSINE.format(a="a.vector", b="b.vector")}, 1.0), 6) AS confidence FROM nearest LEFT JOIN kg_vectors a ON a.uri = source LEFT JOIN kg_vectors b ON b.uri = target
  WHERE target NOT IN (SELECT s FROM kg_disambiguations)),
spread AS (SELECT source, label, g.o AS target, {COSINE.format(a="a.vector", b="b.vector")} AS c FROM nearest JOIN kg_disambiguations g ON g.s = target JOIN kg_vectors a ON a.uri = source JOIN kg_vectors b ON b.uri = g.o)
SELECT * FROM plain UNION ALL SELECT source, label, target, round(c, 6) FROM (SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY c DESC, target) AS rn FROM spread) WHERE rn = 1""")
def vector_disambiguation_match(spark, d):
    i, probe = one_brand(spark, d)
    out = match.vector_disambiguation_match(probe, i, view(spark, d, "kg_vectors"), view(spark, d, "kg_disambiguations"))
    return out.withColumn("confidence", F.round("confidence", 6))


@query(f"""{cte("kg_labels", "kg_vectors")}, {INDEX}, {MET}, n AS (SELECT domain, key, count(*) AS n FROM idx GROUP BY ALL),
c AS (SELECT m.domain, source, m.label, target_domain, resource AS target, n, {COSINE.format(a="a.vector", b="b.vector")} AS c FROM met m JOIN n ON n.domain = target_domain AND n.key = lower(trim(m.label))
  LEFT JOIN kg_vectors a ON a.uri = source LEFT JOIN kg_vectors b ON b.uri = resource)
SELECT domain, source, label, target_domain, target, round(coalesce(c, 1.0), 6) AS confidence FROM c WHERE n = 1
UNION ALL SELECT domain, source, label, target_domain, target, round(c, 6) FROM (SELECT *, row_number() OVER (PARTITION BY domain, source, label, target_domain ORDER BY c DESC, target) AS rn FROM c WHERE n > 1 AND c IS NOT NULL) WHERE rn = 1""")
def interwiki_vector_match(spark, d):
    return match.vector_all_match(labels(spark, d), index(spark, d), view(spark, d, "kg_vectors")).withColumn("confidence", F.round("confidence", 6))


@query(f"{cte('kg_facts', 'kg_redirects')} SELECT f.s, f.p, coalesce(r.o, f.o) AS o, f.o_kind, f.ext FROM kg_facts f LEFT JOIN (SELECT s, max(o) AS o FROM kg_redirects GROUP BY s) r ON f.o = r.s")
def redirected_objects(spark, d):
    return match.resolve_redirects(view(spark, d, "kg_facts"), view(spark, d, "kg_redirects"), "o").select("s", "p", "o", "o_kind", "ext")


@query(f"{cte('kg_labels', 'kg_redirects')} SELECT * FROM kg_labels WHERE s NOT IN (SELECT s FROM kg_redirects)")
def labels_without_redirects(spark, d):
    return match.drop_redirecting(labels(spark, d), view(spark, d, "kg_redirects")).select("domain", "s", "label")


@query(f"""{cte("kg_redirects")}, hop(s, o, n) AS (SELECT s, o, 1 FROM kg_redirects UNION ALL SELECT h.s, r.o, n + 1 FROM hop h JOIN kg_redirects r ON h.o = r.s WHERE n < 50)
SELECT s, arg_max(o, n) AS o, CAST(max(n) AS BIGINT) AS hops FROM hop GROUP BY s""")
def redirect_targets(spark, d):
    return match.terminal_redirects(view(spark, d, "kg_redirects"))


@query(f"""{cte("kg_labels", "kg_redirects")}, n AS (SELECT DISTINCT trim(label) AS form, coalesce(r.o, l.s) AS s FROM kg_labels l LEFT JOIN kg_redirects r ON l.s = r.s)
SELECT form, CAST(count(*) AS BIGINT) AS n, string_agg(s, '|' ORDER BY s) AS resources FROM n GROUP BY form""")
def surface_forms(spark, d):
    return match.surface_forms(labels(spark, d), view(spark, d, "kg_redirects"))


@query(f"{cte('kg_labels', 'kg_disambiguations')}, {INDEX} SELECT * FROM idx UNION ALL SELECT domain, key, label, o FROM idx JOIN (SELECT DISTINCT s, o FROM kg_disambiguations) g ON g.s = resource")
def index_with_disambiguations(spark, d):
    return match.with_disambiguations(index(spark, d), view(spark, d, "kg_disambiguations"))


@query(f"""{cte("kg_system")} SELECT source AS s, 'http://www.w3.org/2002/07/owl#sameAs' AS p, target AS o FROM kg_system WHERE confidence >= 0.416""")
def confident_links(spark, d):
    return match.link_triples(evaluate.at_least(view(spark, d, "kg_system"), 0.416))


# --- evaluation -------------------------------------------------------------------------------------------------

COUNTS = """links AS (SELECT DISTINCT pair, source, target FROM sys WHERE relation = '='),
cell AS (SELECT g.pair, g.source, g.target, (SELECT count(*) FROM links l WHERE l.pair = g.pair AND l.source = g.source AND l.target = g.target) AS hit,
  (SELECT count(*) FROM links l WHERE l.pair = g.pair AND l.source = g.source) AS ns, (SELECT count(*) FROM links l WHERE l.pair = g.pair AND l.target = g.target) AS nt FROM kg_gold g),
cnt AS (SELECT pair, CAST(count(*) FILTER (source <> 'null' AND target <> 'null' AND hit = 1) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN target = 'null' THEN ns WHEN source = 'null' THEN nt WHEN hit = 0 THEN ns + nt ELSE 0 END) AS BIGINT) AS fp,
  CAST(count(*) FILTER (source <> 'null' AND target <> 'null' AND hit = 0) AS BIGINT) AS fn FROM cell GROUP BY pair),
pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END AS r FROM cnt),
scored AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 2 * p * r / (p + r) END AS f FROM pr)"""


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def evaluated(spark, d):
    return evaluate.scores(evaluate.counts(view(spark, d, "kg_system"), view(spark, d, "kg_gold"), ["pair"]))


@query(f"{cte('kg_gold', 'kg_system')}, sys AS (SELECT * FROM kg_system), {COUNTS} SELECT pair, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f FROM scored")
def partial_gold_scores(spark, d):
    return rounded(evaluated(spark, d), "precision", "recall", "f")


@query(f"""{cte("kg_gold", "kg_system")}, sys AS (SELECT * FROM kg_system), {COUNTS},
a AS (SELECT avg(p) AS macro_p, avg(r) AS macro_r, sum(tp)::DOUBLE / sum(tp + fp) AS micro_p, sum(tp)::DOUBLE / sum(tp + fn) AS micro_r FROM scored)
SELECT round(macro_p, 6) AS macro_p, round(macro_r, 6) AS macro_r, round(2 * macro_p * macro_r / (macro_p + macro_r), 6) AS macro_f, round(micro_p, 6) AS micro_p, round(micro_r, 6) AS micro_r,
  round(2 * micro_p * micro_r / (micro_p + micro_r), 6) AS micro_f FROM a""")
def micro_macro_scores(spark, d):
    return rounded(evaluate.micro_macro(evaluated(spark, d)), "macro_p", "macro_r", "macro_f", "micro_p", "micro_r", "micro_f")


@query(f"""{cte("kg_gold", "kg_system")}, want AS (SELECT DISTINCT pair, source, target FROM kg_gold),
m AS (SELECT s.pair, count(*) AS predicted, count(w.pair) AS tp FROM kg_system s LEFT JOIN want w USING (pair, source, target) GROUP BY s.pair), g AS (SELECT pair, count(*) AS actual FROM kg_gold GROUP BY pair),
c AS (SELECT g.pair, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(predicted, 0) - coalesce(tp, 0) AS BIGINT) AS fp, CAST(actual - coalesce(tp, 0) AS BIGINT) AS fn FROM g LEFT JOIN m ON g.pair = m.pair),
pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END AS r FROM c)
SELECT pair, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f FROM pr""")
def full_gold_scores(spark, d):
    return rounded(evaluate.full_gold(view(spark, d, "kg_system"), view(spark, d, "kg_gold")), "precision", "recall", "f")


@query(f"{cte('kg_system')} SELECT DISTINCT round(confidence, 2) AS threshold FROM kg_system")
def threshold_candidates(spark, d):
    return evaluate.thresholds(view(spark, d, "kg_system"))


@query(f"""{cte("kg_gold", "kg_system")}, th AS (SELECT DISTINCT round(confidence, 2) AS t FROM kg_system),
links AS (SELECT DISTINCT pair, t, source, target FROM kg_system JOIN th ON confidence >= t WHERE relation = '='),
ns AS (SELECT pair, t, source, count(*) AS ns FROM links GROUP BY ALL), nt AS (SELECT pair, t, target, count(*) AS nt FROM links GROUP BY ALL),
cell AS (SELECT g.pair, th.t, g.source, g.target, CASE WHEN l.pair IS NULL THEN 0 ELSE 1 END AS hit, coalesce(ns, 0) AS ns, coalesce(nt, 0) AS nt FROM kg_gold g CROSS JOIN th
  LEFT JOIN links l ON l.pair = g.pair AND l.t = th.t AND l.source = g.source AND l.target = g.target LEFT JOIN ns ON ns.pair = g.pair AND ns.t = th.t AND ns.source = g.source LEFT JOIN nt ON nt.pair = g.pair AND nt.t = th.t AND nt.target = g.target),
cnt AS (SELECT pair, t, CAST(count(*) FILTER (source <> 'null' AND target <> 'null' AND hit = 1) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN target = 'null' THEN ns WHEN source = 'null' THEN nt WHEN hit = 0 THEN ns + nt ELSE 0 END) AS BIGINT) AS fp,
  CAST(count(*) FILTER (source <> 'null' AND target <> 'null' AND hit = 0) AS BIGINT) AS fn FROM cell GROUP BY pair, t),
pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END AS r FROM cnt),
train AS (SELECT a.pair, a.t, avg(b.p) AS p, avg(b.r) AS r FROM pr a JOIN pr b ON a.t = b.t AND a.pair <> b.pair
  WHERE EXISTS (SELECT 1 FROM kg_system s WHERE s.pair <> a.pair AND round(s.confidence, 2) = a.t) GROUP BY a.pair, a.t),
best AS (SELECT pair, arg_min(t, struct_pack(f := -round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 9), t := t)) AS t FROM train GROUP BY pair)
SELECT b.pair, b.t AS threshold, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f FROM best b JOIN pr ON pr.pair = b.pair AND pr.t = b.t""")
def leave_one_out_thresholds(spark, d):
    return rounded(evaluate.leave_one_out(view(spark, d, "kg_system"), view(spark, d, "kg_gold")), "precision", "recall", "f")


@query(f"""{cte("kg_gold")} SELECT pair, CASE WHEN u LIKE '%/class/%' OR u LIKE '%/ontology/%' THEN 'class' WHEN u LIKE '%/property/%' THEN 'prop' WHEN u LIKE '%/resource/%' THEN 'inst' END AS kind, relation, CAST(count(*) AS BIGINT) AS n
FROM (SELECT *, CASE WHEN source = 'null' THEN target ELSE source END AS u FROM kg_gold) GROUP BY ALL""")
def gold_by_kind(spark, d):
    return evaluate.by_kind(view(spark, d, "kg_gold")).groupBy("pair", "kind", "relation").agg(F.count("*").alias("n"))


# --- fusion -----------------------------------------------------------------------------------------------------

REACH = """edge AS (SELECT s AS a, o AS b FROM kg_links UNION SELECT o, s FROM kg_links), reach(a, b) AS (SELECT a, a FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
comp AS (SELECT a AS uri, min(b) AS component FROM reach GROUP BY a),
name AS (SELECT component, CAST(count(*) AS BIGINT) AS size, translate(base64(unhex(md5(string_agg(uri, '' ORDER BY uri)))), '+/', '-_') AS canonical FROM comp GROUP BY component)"""


@query(f"{cte('kg_links')}, {REACH} SELECT uri, component, size, canonical FROM comp JOIN name USING (component)")
def equivalence_classes(spark, d):
    return fuse.equivalence_classes(view(spark, d, "kg_links"))


@query(f"{cte('kg_links')}, {REACH} SELECT component, size FROM name ORDER BY size DESC, component LIMIT 20")
def largest_classes(spark, d):
    return fuse.class_sizes(fuse.members(view(spark, d, "kg_links")), 20)


@query(f"{cte('kg_links')}, {REACH} SELECT uri, component, size, canonical FROM comp JOIN name USING (component) WHERE size <= 8")
def classes_of_bounded_size(spark, d):
    return fuse.equivalence_classes(view(spark, d, "kg_links"), largest=8)


OWN = "translate(base64(unhex(md5({0}))), '+/', '-_')"


@query(f"""{cte("kg_links", "kg_facts")}, {REACH}, u AS (SELECT uri, canonical FROM comp JOIN name USING (component))
SELECT 'kg/' || coalesce(a.canonical, {OWN.format("s")}) AS s, 'kg/' || coalesce(b.canonical, {OWN.format("p")}) AS p,
  CASE WHEN o_kind = 'iri' THEN 'kg/' || coalesce(c.canonical, {OWN.format("o")}) ELSE o END AS o, o_kind, ext
FROM kg_facts LEFT JOIN u a ON a.uri = s LEFT JOIN u b ON b.uri = p LEFT JOIN u c ON c.uri = o AND o_kind = 'iri'""")
def rewritten_facts(spark, d):
    classes = fuse.equivalence_classes(view(spark, d, "kg_links"))
    return fuse.rewrite(view(spark, d, "kg_facts"), classes, "kg/", ("s", "p", "o"))


@query(f"{cte('kg_facts')} SELECT DISTINCT * FROM kg_facts")
def unique_facts(spark, d):
    return fuse.unique_statements(view(spark, d, "kg_facts"))


# --- enrichment -------------------------------------------------------------------------------------------------

VOTES = """ty AS (SELECT s, max(o) AS t FROM kg_all_types GROUP BY s),
sides AS (SELECT p, 'domain' AS side, coalesce(t, 'http://www.w3.org/2002/07/owl#Thing') AS type FROM kg_facts f LEFT JOIN ty ON ty.s = f.s
  UNION ALL SELECT p, 'range', CASE WHEN o_kind = 'iri' THEN coalesce(t, 'http://www.w3.org/2002/07/owl#Thing') ELSE 'http://www.w3.org/2000/01/rdf-schema#Literal' END FROM kg_facts f LEFT JOIN ty ON ty.s = f.o AND o_kind = 'iri'),
vote AS (SELECT p, side, type, count(*) AS n FROM sides GROUP BY ALL),
win AS (SELECT p, side, type, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY p, side ORDER BY n DESC, type) AS rn FROM vote) WHERE rn = 1)"""


@query(f"{cte('kg_facts', 'kg_all_types')}, {VOTES} SELECT p, side, type, n FROM win WHERE type <> 'http://www.w3.org/2002/07/owl#Thing'")
def domains_and_ranges(spark, d):
    return enrich.domains_and_ranges(view(spark, d, "kg_facts"), view(spark, d, "kg_all_types"))


OBJECTS = """inc AS (SELECT DISTINCT o, p FROM kg_facts WHERE o_kind = 'iri' AND o {0} (SELECT s FROM kg_all_types)),
told AS (SELECT o, type, count(*) AS n FROM inc JOIN win USING (p) WHERE side = 'range' AND type NOT IN ('http://www.w3.org/2002/07/owl#Thing', 'http://www.w3.org/2000/01/rdf-schema#Literal') GROUP BY ALL)
SELECT o AS s, type AS o FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY n DESC, type) AS rn FROM told) WHERE rn = 1"""


@query(f"{cte('kg_facts', 'kg_all_types')}, {VOTES}, {OBJECTS.format('IN')}")
def types_of_objects(spark, d):
    return enrich.object_types(view(spark, d, "kg_facts"), view(spark, d, "kg_all_types"))


@query(f"{cte('kg_facts', 'kg_all_types')}, {VOTES}, {OBJECTS.format('NOT IN')}")
def types_of_untyped_objects(spark, d):
    return enrich.object_types(view(spark, d, "kg_facts"), view(spark, d, "kg_all_types"), only_untyped=True)


MINED = """one AS (SELECT o, count(*) AS n FROM kg_types GROUP BY o), dis AS (SELECT DISTINCT s, o FROM kg_types), rich AS (SELECT s FROM dis GROUP BY s HAVING count(*) >= 3),
bo AS (SELECT a.o AS a, b.o AS b, count(*) AS n FROM dis a JOIN dis b ON a.s = b.s AND a.o < b.o WHERE a.s IN (SELECT s FROM rich) GROUP BY ALL),
mined AS (SELECT a AS sub, b AS super, bo.n::DOUBLE / x.n AS ratio FROM bo JOIN one x ON x.o = a WHERE bo.n::DOUBLE / x.n > 0.95 UNION ALL SELECT b, a, bo.n::DOUBLE / y.n FROM bo JOIN one y ON y.o = b WHERE bo.n::DOUBLE / y.n >= 0.95)"""


@query(f"{cte('kg_types')}, {MINED} SELECT sub, super, round(ratio, 6) AS ratio FROM mined")
def mined_subclasses(spark, d):
    return rounded(enrich.subclasses(view(spark, d, "kg_types")), "ratio")


@query(f"{cte('kg_types')}, {MINED.replace('0.95', '0.6')} SELECT DISTINCT t.s, m.super AS o FROM kg_types t JOIN mined m ON t.o = m.sub WHERE NOT EXISTS (SELECT 1 FROM kg_types x WHERE x.s = t.s AND x.o = m.super)")
def materialized_types(spark, d):
    types = view(spark, d, "kg_types")
    return enrich.materialize(types, enrich.subclasses(types, above=0.6))


@query(f"{cte('kg_types')}, {MINED}, up(sub, super) AS (SELECT sub, super FROM mined UNION SELECT u.sub, m.super FROM up u JOIN mined m ON u.super = m.sub) SELECT sub, super FROM up")
def subclass_closure(spark, d):
    return enrich.transitive_closure(enrich.subclasses(view(spark, d, "kg_types")))


# --- statistics -------------------------------------------------------------------------------------------------


@query(f"{cte('kg_facts')} SELECT p, CAST(count(*) AS BIGINT) AS statements, CAST(count(DISTINCT s) AS BIGINT) AS subjects FROM kg_facts GROUP BY p")
def statements_by_property(spark, d):
    return stats.statements_and_subjects(view(spark, d, "kg_facts"), ["p"])


DEGREES = """deg AS (SELECT node, sum(i) AS i, sum(u) AS u FROM (SELECT o AS node, 1 AS i, 0 AS u FROM kg_facts WHERE o_kind = 'iri' UNION ALL SELECT s, 0, 1 FROM kg_facts UNION ALL SELECT s, 0, 1 FROM kg_labels) GROUP BY node)"""


@query(f"{cte('kg_facts', 'kg_labels')}, {DEGREES} SELECT node, CAST(i AS BIGINT) AS in_degree, CAST(u AS BIGINT) AS out_degree FROM deg")
def node_degrees(spark, d):
    return stats.degrees(view(spark, d, "kg_facts"), labels(spark, d))


@query(f"""{cte("kg_facts", "kg_labels")}, {DEGREES} SELECT CAST(count(*) AS BIGINT) AS nodes, CAST(sum(i) AS BIGINT) AS in_total, CAST(sum(u) AS BIGINT) AS out_total,
round(sum(i)::DOUBLE / count(*), 6) AS in_average, round(sum(u)::DOUBLE / count(*), 6) AS out_average FROM deg""")
def degree_averages(spark, d):
    return stats.degree_averages(node_degrees(spark, d))


@query(f"{cte('kg_types')} SELECT CAST(count(*) AS BIGINT) AS pairs, CAST(count(DISTINCT s) AS BIGINT) AS instances, CAST(count(DISTINCT o) AS BIGINT) AS classes FROM (SELECT DISTINCT s, o FROM kg_types)")
def distinct_type_statements(spark, d):
    return stats.type_statements(view(spark, d, "kg_types"))


@query(f"""{cte("kg_types", "kg_all_types")} SELECT o AS type, CAST(count(*) AS BIGINT) AS n, CASE WHEN o LIKE 'class/size%' THEN upper(o) ELSE 'No label' END AS label
FROM (SELECT o FROM kg_types UNION ALL SELECT o FROM kg_all_types) GROUP BY o""")
def type_histogram(spark, d):
    types = view(spark, d, "kg_types")
    names = types.where("o LIKE 'class/size%'").select(F.col("o").alias("s"), F.upper("o").alias("label")).distinct()
    return stats.type_histogram([types, view(spark, d, "kg_all_types")], names)


@query("SELECT o_orderpriority AS value, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1 ORDER BY n DESC, value LIMIT 3")
def most_frequent_values(spark, d):
    return stats.frequency(table(spark, d, "orders"), "o_orderpriority", missing="Missing", top=3)


@query("""SELECT 'c_acctbal' AS name, CAST(count(c_acctbal) AS BIGINT) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev(c_acctbal), 4) AS std, min(c_acctbal) AS min, round(quantile_cont(c_acctbal, 0.25), 4) AS q25,
round(quantile_cont(c_acctbal, 0.5), 4) AS q50, round(quantile_cont(c_acctbal, 0.75), 4) AS q75, max(c_acctbal) AS max FROM customer
UNION ALL SELECT 'c_nationkey', count(c_nationkey), round(avg(c_nationkey), 4), round(stddev(c_nationkey), 4), min(c_nationkey)::DOUBLE, round(quantile_cont(c_nationkey::DOUBLE, 0.25), 4),
round(quantile_cont(c_nationkey::DOUBLE, 0.5), 4), round(quantile_cont(c_nationkey::DOUBLE, 0.75), 4), max(c_nationkey)::DOUBLE FROM customer""")
def column_profile(spark, d):
    return stats.describe(table(spark, d, "customer"), ["c_acctbal", "c_nationkey"])


@query("SELECT round(sum(l_quantity), 2) AS sum_l_quantity, round(sum(l_tax), 2) AS sum_l_tax FROM lineitem")
def column_sums(spark, d):
    return stats.sums(table(spark, d, "lineitem"), ["l_quantity", "l_tax"])


@query("""WITH c AS (SELECT last_day(o_orderdate) AS month, count(*) AS n FROM orders GROUP BY 1),
e AS (SELECT last_day(unnest(generate_series(date_trunc('month', min(month))::TIMESTAMP, date_trunc('month', max(month))::TIMESTAMP, INTERVAL 1 MONTH))) AS month FROM c)
SELECT strftime(CAST(e.month AS DATE), '%Y-%m-%d') AS month, CAST(coalesce(n, 0) AS BIGINT) AS n FROM e LEFT JOIN c ON CAST(c.month AS DATE) = CAST(e.month AS DATE)""")
def rows_by_month_all(spark, d):
    return stats.monthly(table(spark, d, "orders"), F.col("o_orderdate")).withColumn("month", F.date_format("month", "yyyy-MM-dd"))


@query("SELECT p_partkey, p_size, CAST(row_number() OVER (ORDER BY p_size DESC, p_partkey) AS BIGINT) AS rank FROM part")
def rank_by_size(spark, d):
    return stats.rank_series(table(spark, d, "part"), "p_size", "p_partkey")


@query("SELECT 'p_brand' AS side, p_brand AS value, CAST(count(DISTINCT p_type) AS BIGINT) AS others FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(DISTINCT p_brand) FROM part GROUP BY 2")
def functional_dependence(spark, d):
    return stats.functional_dependence(table(spark, d, "part"), "p_brand", "p_type")


@query("SELECT md5(text) AS digest, CAST(count(*) AS BIGINT) AS members, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_contents(spark, d):
    return stats.duplicate_contents(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT c_custkey AS id, c_name AS title, c_acctbal AS wam_score FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 40")
def top_by_score(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_acctbal").alias("wam_score"))
    return t.orderBy(F.desc("wam_score"), "id").limit(40)


# --- overlap ----------------------------------------------------------------------------------------------------

SHARED = """t AS (SELECT DISTINCT domain, title FROM kg_titles WHERE title NOT IN ('Main Page', 'Sandbox', 'Hauptseite')), sz AS (SELECT domain, count(*) AS n FROM t GROUP BY domain),
ov AS (SELECT a.domain AS src, b.domain AS dst, count(*) AS n FROM t a JOIN t b ON a.title = b.title AND a.domain < b.domain GROUP BY ALL HAVING count(*) > 1)"""


def titles_shared(spark, d):
    return overlap.shared_titles(overlap.without_stop_titles(view(spark, d, "kg_titles")), least=1)


@query(f"{cte('kg_titles')}, {SHARED} SELECT src, dst, CAST(ov.n AS BIGINT) AS n, round(ov.n::DOUBLE / (x.n + y.n - ov.n), 6) AS jaccard FROM ov JOIN sz x ON x.domain = src JOIN sz y ON y.domain = dst")
def shared_titles(spark, d):
    return titles_shared(spark, d)


@query(f"{cte('kg_titles')}, {SHARED} SELECT domain, CAST(count(*) AS BIGINT) AS degree, CAST(sum(n) AS BIGINT) AS weight FROM (SELECT src AS domain, n FROM ov UNION ALL SELECT dst, n FROM ov) GROUP BY domain")
def overlap_graph_nodes(spark, d):
    return overlap.overlap_graph(titles_shared(spark, d))[0]


@query("""WITH w AS (SELECT DISTINCT p_brand AS key, p_name AS value FROM part), n AS (SELECT a.key, b.key AS other, count(*) AS n FROM w a JOIN w b ON a.value = b.value WHERE a.key < 'Brand#2' AND b.key >= 'Brand#2' GROUP BY ALL)
SELECT key, other, CAST(n AS BIGINT) AS n FROM (SELECT *, rank() OVER (PARTITION BY key ORDER BY n DESC) AS r FROM n) WHERE r = 1""")
def best_value_overlap(spark, d):
    t = table(spark, d, "part").select(F.col("p_brand").alias("key"), F.col("p_name").alias("value"))
    return overlap.best_value_overlap(t.where("key < 'Brand#2'"), t.where("key >= 'Brand#2'"))


@query("""WITH a AS (SELECT DISTINCT 'x/' || p_name AS key FROM part), b AS (SELECT DISTINCT 'y/' || p_type AS other FROM part),
m AS (SELECT key, other, CAST(levenshtein(substr(key, 3), substr(other, 3)) AS INTEGER) AS distance FROM a, b) SELECT key, other, distance FROM (SELECT *, rank() OVER (PARTITION BY key ORDER BY distance) AS r FROM m) WHERE r = 1""")
def nearest_names_all(spark, d):
    p = table(spark, d, "part")
    return overlap.nearest_strings(p.select(F.concat(F.lit("x/"), "p_name").alias("key")), p.select(F.concat(F.lit("y/"), "p_type").alias("key")))


@query("""WITH n AS (SELECT DISTINCT s_name AS x FROM supplier) SELECT a.x AS a, b.x AS b, CAST(levenshtein(a.x, b.x) AS INTEGER) AS distance FROM n a JOIN n b ON a.x < b.x WHERE levenshtein(a.x, b.x) <= 1""")
def near_names(spark, d):
    return overlap.near_names(table(spark, d, "supplier"), "s_name")


@query("""WITH RECURSIVE n AS (SELECT DISTINCT p_name AS x FROM part), e AS (SELECT a.x AS a, b.x AS b FROM n a, n b WHERE levenshtein(a.x, b.x) <= 1),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS name, min(b) AS cluster FROM r GROUP BY a""")
def name_clusters_all(spark, d):
    return overlap.name_clusters(table(spark, d, "part"), "p_name")


# --- crowd ------------------------------------------------------------------------------------------------------

MAJ = "maj AS (SELECT hit, item, answer, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY hit, item ORDER BY n DESC, answer) AS rn FROM (SELECT hit, item, answer, count(*) AS n FROM kg_votes GROUP BY ALL)) WHERE rn = 1)"


@query(f"{cte('kg_votes')}, {MAJ} SELECT hit, item, answer, n FROM maj")
def majority_answers(spark, d):
    return crowd.majority(crowd.complete_hits(view(spark, d, "kg_votes")), ["hit", "item"])


@query(f"""{cte("kg_votes")}, two AS (SELECT hit, item, CASE WHEN worker IN ('w0', 'w1') THEN 1 ELSE 2 END AS dst, CASE WHEN answer = 'error' THEN 'no match' ELSE answer END AS answer FROM kg_votes),
m AS (SELECT hit, item, dst, answer FROM (SELECT *, row_number() OVER (PARTITION BY hit, item, dst ORDER BY n DESC, answer) AS rn FROM (SELECT hit, item, dst, answer, count(*) AS n FROM two GROUP BY ALL)) WHERE rn = 1)
SELECT a.hit, a.item, CASE WHEN a.answer = 'no match' THEN 'null' ELSE a.answer END AS source, CASE WHEN b.answer = 'no match' THEN 'null' ELSE b.answer END AS target, CASE WHEN 'no match' IN (a.answer, b.answer) THEN '%' ELSE '=' END AS relation
FROM m a JOIN m b ON a.hit = b.hit AND a.item = b.item AND a.dst = 1 AND b.dst = 2 WHERE NOT (a.answer = 'no match' AND b.answer = 'no match')""")
def transitive_answers(spark, d):
    v = view(spark, d, "kg_votes").withColumn("dst", F.when(F.col("worker").isin("w0", "w1"), 1).otherwise(2))
    v = v.withColumn("answer", F.when(F.col("answer") == "error", "no match").otherwise(F.col("answer")))
    return crowd.transitive_links(crowd.majority(v, ["hit", "item", "dst"]))


@query(f"""{cte("kg_votes")}, v AS (SELECT hit AS item, worker AS coder, answer AS label FROM kg_votes), tot AS (SELECT coder, count(*) AS n FROM v GROUP BY coder),
sh AS (SELECT v.coder, label, count(*)::DOUBLE / any_value(n) AS p FROM v JOIN tot ON tot.coder = v.coder GROUP BY ALL),
ao AS (SELECT a.coder AS c1, b.coder AS c2, avg(CASE WHEN a.label = b.label THEN 1.0::DOUBLE ELSE 0 END) AS ao FROM v a JOIN v b ON a.item = b.item AND a.coder < b.coder GROUP BY ALL),
ae AS (SELECT a.coder AS c1, b.coder AS c2, sum(a.p * b.p) AS ae FROM sh a JOIN sh b ON a.label = b.label AND a.coder < b.coder GROUP BY ALL),
m AS (SELECT avg((ao - ae) / (1 - ae)) AS kappa, avg(ao) AS o, avg(ae) AS e FROM ao JOIN ae USING (c1, c2)),
l AS (SELECT sum(k)::DOUBLE AS n, sum(k * k)::DOUBLE AS sq, sum(k * (k - 1))::DOUBLE AS pr FROM (SELECT label, count(*) AS k FROM v GROUP BY label)),
i AS (SELECT sum(agree::DOUBLE / (mm - 1)) AS agree, sum(mm)::DOUBLE AS pairable FROM (SELECT item, sum(k) AS mm, sum(k * (k - 1)) AS agree FROM (SELECT item, label, count(*) AS k FROM v GROUP BY ALL) GROUP BY item) WHERE mm > 1)
SELECT round(kappa, 6) AS kappa, round((o - e) / (1 - e), 6) AS multi_kappa, round((o - sq / (n * n)) / (1 - sq / (n * n)), 6) AS scott_pi, round(1 - (1 - agree / pairable) / (1 - pr / (n * (n - 1))), 6) AS alpha FROM m, l, i""")
def coder_agreement(spark, d):
    v = view(spark, d, "kg_votes")
    return crowd.agreement(v.select(F.col("hit").alias("item"), F.col("worker").alias("coder"), F.col("answer").alias("label")))


@query("""WITH x AS (SELECT p_brand AS da, 'Brand#' || (p_partkey % 7) AS db, p_partkey AS k FROM part WHERE p_brand <> 'Brand#' || (p_partkey % 7))
SELECT DISTINCT least(da, db) AS domain_a, greatest(da, db) AS domain_b, CASE WHEN da > db THEN 't' || k ELSE 's' || k END AS source, CASE WHEN da > db THEN 's' || k ELSE 't' || k END AS target, '=' AS relation FROM x""")
def oriented_alignments(spark, d):
    p = table(spark, d, "part").select(
        F.col("p_brand").alias("domain_a"),
        F.concat(F.lit("Brand#"), (F.col("p_partkey") % 7).cast("string")).alias("domain_b"),
        F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("source"),
        F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("target"),
        F.lit("=").alias("relation"),
    )
    return crowd.oriented(p.where("domain_a <> domain_b"))


@query("""WITH t AS (SELECT DISTINCT p_brand AS domain, p_name AS title FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY md5(domain || '|' || title), title) - 1 AS i FROM t)
SELECT domain, CAST(i // 4 AS BIGINT) AS hit, max(CASE WHEN i % 4 = 0 THEN title END) AS raw_0, max(CASE WHEN i % 4 = 1 THEN title END) AS raw_1, max(CASE WHEN i % 4 = 2 THEN title END) AS raw_2, max(CASE WHEN i % 4 = 3 THEN title END) AS raw_3
FROM n GROUP BY domain, i // 4""")
def question_rows(spark, d):
    return crowd.question_rows(table(spark, d, "part").select(F.col("p_brand").alias("domain"), F.col("p_name").alias("title")), per_hit=4)


@query("""WITH t AS (SELECT DISTINCT p_brand AS domain, CASE WHEN p_name LIKE 'red %' THEN replace(p_name, 'red ', 'blue ') ELSE p_name END AS title FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY md5(domain || '|' || title), title) AS rn FROM t WHERE title NOT LIKE '%small%') SELECT domain, title FROM n WHERE rn <= 5""")
def title_samples(spark, d):
    t = table(spark, d, "part").select(F.col("p_brand").alias("domain"), F.col("p_name").alias("title")).distinct()
    moved = t.where("title LIKE 'red %'").withColumn("target", F.replace("title", F.lit("red "), F.lit("blue ")))
    return crowd.title_sample(t, moved, 5, reject="small")


@query(f"{cte('kg_facts')} SELECT p AS key, split_part(o, '/', len(string_split(o, '/'))::INT) AS value, CAST(count(*) AS BIGINT) AS n FROM kg_facts GROUP BY ALL")
def values_by_property_all(spark, d):
    return overlap.values_by_key(view(spark, d, "kg_facts"))


@query("""WITH l AS (SELECT DISTINCT 'x/' || p_brand AS key, p_name AS value FROM part), r AS (SELECT DISTINCT 'y/' || p_type AS other, p_name AS value FROM part),
v AS (SELECT key, other, count(*) AS n FROM l JOIN r USING (value) GROUP BY ALL), n AS (SELECT DISTINCT key, other, levenshtein(substr(key, 3), substr(other, 3)) AS d FROM (SELECT DISTINCT key FROM l), (SELECT DISTINCT other FROM r))
SELECT key, other, 'value' AS how FROM (SELECT *, rank() OVER (PARTITION BY key ORDER BY n DESC) AS k FROM v) WHERE k = 1
UNION ALL SELECT key, other, 'name' FROM (SELECT *, rank() OVER (PARTITION BY key ORDER BY d) AS k FROM n) WHERE k = 1 UNION ALL SELECT DISTINCT key, 'null', 'none' FROM l""")
def schema_candidates_all(spark, d):
    p = table(spark, d, "part")
    left = p.select(F.concat(F.lit("x/"), "p_brand").alias("key"), F.col("p_name").alias("value"))
    return overlap.schema_candidates(left, p.select(F.concat(F.lit("y/"), "p_type").alias("key"), F.col("p_name").alias("value")))


# --- sources, sinks and scalar functions ------------------------------------------------------------------------


@query(f"{cte('kg_facts')} SELECT s, p, o, o_kind, ext FROM kg_facts")
def ntriples_round_trip(spark, d):
    return ntriples.parse_lines(ntriples.lines_of(view(spark, d, "kg_facts")))


@query(f"""{cte("kg_facts")} SELECT '<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 'iri' THEN '<' || o || '>' ELSE '"' || o || '"' || ext END || ' .' AS value FROM kg_facts""")
def ntriples_lines(spark, d):
    return ntriples.lines_of(view(spark, d, "kg_facts"))


@query(f"""{cte("kg_gold")}, c AS (SELECT pair, '<map><Cell><entity1 rdf:resource="' || source || '"/><entity2 rdf:resource="' || target || '"/><relation>' || relation || '</relation><measure rdf:datatype="xsd:float">1.0</measure></Cell></map>' AS cell FROM kg_gold)
SELECT pair, md5(string_agg(cell, chr(10) ORDER BY cell)) AS digest, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY pair""")
def alignment_cells(spark, d):
    found = A.cells(view(spark, d, "kg_gold")).groupBy("pair")
    return found.agg(F.md5(F.array_join(F.array_sort(F.collect_list("cell")), "\n")).alias("digest"), F.count("*").alias("n"))


@query("""SELECT p_partkey, lower(p_name) AS low, translate(base64(unhex(md5(p_name))), '+/', '-_') AS digest, CAST(levenshtein(p_name, p_type) AS INTEGER) AS distance,
replace(p_name, ' ', '_') AS underscored, regexp_extract('http://' || replace(p_name, ' ', '-') || '.wikia.com/wiki/X', '^http://(.*?)\\.wikia\\.com', 1) AS domain,
trim(replace(regexp_replace(regexp_replace(lower('The ' || p_name || ' Wiki!'), '[^a-z0-9 ]+', '', 'g'), 'wiki[a]?', '', 'g'), '  ', ' ')) AS plain,
string_split('1~en~' || p_brand || '~x.tar.gz', '~')[3] AS part3, replace(p_brand || '-b', '-', '') AS dashless FROM part""")
def scalar_functions(spark, d):
    name = F.col("p_name")
    url = F.concat(F.lit("http://"), F.replace(name, F.lit(" "), F.lit("-")), F.lit(".wikia.com/wiki/X"))
    return table(spark, d, "part").select(
        "p_partkey",
        F.lower(name).alias("low"),
        S.uri_digest(name).alias("digest"),
        S.edit_distance(name, F.col("p_type")).alias("distance"),
        S.spaces_to(name, "_").alias("underscored"),
        S.wiki_domain(url).alias("domain"),
        S.plain_title(F.concat(F.lit("The "), name, F.lit(" Wiki!"))).alias("plain"),
        S.name_part(F.concat(F.lit("1~en~"), "p_brand", F.lit("~x.tar.gz")), 2).alias("part3"),
        S.without_dashes(F.concat("p_brand", F.lit("-b"))).alias("dashless"),
    )


@query(r"SELECT doc_id AS tag, CAST(len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) AS INTEGER) AS n_tokens FROM documents")
def corpus_tokens_all(spark, d):
    t = corpus.tokenized(table(spark, d, "documents").select(F.col("doc_id").alias("tag"), "text"))
    return t.select("tag", F.size("tokens").alias("n_tokens"))


@query(f"""{cte("kg_corpus")} SELECT CASE WHEN CAST(substr(tag, 5) AS BIGINT) % 9 = 4 THEN 'doc/' || (CAST(substr(tag, 5) AS BIGINT) - 1) ELSE tag END AS tag, md5(text) AS digest FROM kg_corpus
UNION ALL SELECT 'own/' || doc_id, md5(text) FROM documents """)
def abstracts_corpus(spark, d):
    docs = view(spark, d, "kg_corpus").select(F.col("tag").alias("s"), F.col("text").alias("o"))
    k = F.substring("s", 5, 20).cast("long")
    redirects = docs.where(k % 9 == 4).select("s", F.concat(F.lit("doc/"), (k - 1).cast("string")).alias("o"))
    own = table(spark, d, "documents").select(F.concat(F.lit("own/"), F.col("doc_id").cast("string")).alias("s"), F.col("text").alias("o"))
    return corpus.abstracts_corpus(docs, redirects, own).select("tag", F.md5("text").alias("digest"))


@query("SELECT s_suppkey AS id, s_name AS title FROM supplier WHERE s_acctbal > 100 AND s_suppkey IN (SELECT DISTINCT l_suppkey FROM lineitem)")
def usable_sources(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.lit("").alias("lang"), F.col("s_acctbal").alias("stats_articles"))
    return dumps.usable(s, table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"))).select("id", "title")


@query()
def document_embeddings(spark, d):
    """Hashed TF-IDF vectors of the corpus; held against plain counts in the tests."""
    return corpus.tfidf_vectors(view(spark, d, "kg_corpus"), 64).select("uri", F.array_join(F.transform("vector", lambda x: F.round(x, 4).cast("string")), ",").alias("vector"))


from . import dump_queries  # noqa: E402, F401  registers its queries beside these
