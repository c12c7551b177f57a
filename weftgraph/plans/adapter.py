"""The driver's tables seen as knowledge graphs.

Each view is one SQL text in the dialect that Spark and DuckDB share; Spark runs it over DataFrames, the reference
queries repeat it as a common table expression.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    # labelled resources; brands stand for wikis
    "kg_labels": """SELECT p_brand AS domain, concat('part/', CAST(p_partkey AS STRING)) AS s,
  CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat(upper(substr(p_name, 1, 1)), substr(p_name, 2)) ELSE p_name END AS label FROM {part}""",
    "kg_types": """SELECT concat('part/', CAST(p_partkey AS STRING)) AS s, concat('class/', p_type) AS o FROM {part}
  UNION ALL SELECT concat('part/', CAST(p_partkey AS STRING)), concat('class/', p_brand) FROM {part}
  UNION ALL SELECT concat('part/', CAST(p_partkey AS STRING)), 'class/size10' FROM {part} WHERE p_size > 10
  UNION ALL SELECT concat('part/', CAST(p_partkey AS STRING)), 'class/size25' FROM {part} WHERE p_size > 25
  UNION ALL SELECT concat('part/', CAST(p_partkey AS STRING)), 'class/size40' FROM {part} WHERE p_size > 40""",
    "kg_all_types": """SELECT concat('part/', CAST(p_partkey AS STRING)) AS s, concat('class/', p_type) AS o FROM {part}
  UNION ALL SELECT concat('customer/', CAST(c_custkey AS STRING)), concat('class/', c_mktsegment) FROM {customer} WHERE c_custkey % 10 > 0
  UNION ALL SELECT concat('order/', CAST(o_orderkey AS STRING)), concat('class/', o_orderstatus) FROM {orders} WHERE o_orderkey % 4 > 0""",
    "kg_facts": """SELECT concat('order/', CAST(o_orderkey AS STRING)) AS s, 'prop/customer' AS p, concat('customer/', CAST(o_custkey AS STRING)) AS o, 'iri' AS o_kind, '' AS ext FROM {orders}
  UNION ALL SELECT concat('order/', CAST(l_orderkey AS STRING)), 'prop/part', concat('part/', CAST(l_partkey AS STRING)), 'iri', '' FROM {lineitem}
  UNION ALL SELECT concat('customer/', CAST(c_custkey AS STRING)), 'prop/nation', concat('nation/', CAST(c_nationkey AS STRING)), 'iri', '' FROM {customer}
  UNION ALL SELECT concat('order/', CAST(o_orderkey AS STRING)), 'prop/priority', o_orderpriority, 'literal', '@en' FROM {orders}""",
    "kg_redirects": """SELECT concat('part/', CAST(p_partkey AS STRING)) AS s, concat('part/', CAST(p_partkey - 1 AS STRING)) AS o FROM {part} WHERE p_partkey % 7 IN (5, 6)""",
    "kg_links": """SELECT s, o FROM (SELECT concat('order/', CAST(o_orderkey AS STRING)) AS s,
  concat('order/', CAST(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS STRING)) AS o,
  lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM {orders}) x WHERE nxt IS NOT NULL""",
    "kg_disambiguations": """SELECT concat('part/', CAST(p_partkey AS STRING)) AS s, concat('part/', CAST(p_partkey + k AS STRING)) AS o
  FROM {part} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) d WHERE p_partkey % 10 = 0""",
    "kg_titles": """SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS domain, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM {pages}""",
    "kg_vectors": """SELECT concat('part/', CAST(vec_id AS STRING)) AS uri, embedding AS vector FROM {embeddings}""",
    "kg_votes": """SELECT concat('hit', CAST(CAST(floor(event_id / 5) AS BIGINT) AS STRING)) AS hit, 0 AS item, concat('w', CAST(event_id % 5 AS STRING)) AS worker, event_type AS answer FROM {events}""",
    "kg_corpus": """SELECT concat('doc/', CAST(doc_id AS STRING)) AS tag, text FROM {documents}""",
    # what the dumps of all sources hold
    "kg_dump": """SELECT concat('http://kg.example.org/', replace(p_brand, '#', ''), '/resource/', CAST(p_partkey + 0 AS STRING)) AS s, 'http://www.w3.org/2000/01/rdf-schema#label' AS p, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat(upper(substr(p_name, 1, 1)), substr(p_name, 2)) ELSE concat(' ', p_name) END AS o, 'literal' AS o_kind, '@en' AS ext, CAST(substr(p_brand, 7) AS BIGINT) AS wiki_id, 'en' AS lang, replace(p_brand, '#', '') AS domain, 'labels' AS dataset FROM {part}
  UNION ALL SELECT concat('http://kg.example.org/', replace(p_brand, '#', ''), '/resource/', CAST(p_partkey + 0 AS STRING)) AS s, 'http://kg.example.org/redirects' AS p, concat('http://kg.example.org/', replace(p_brand, '#', ''), '/resource/', CAST(p_partkey - 1 AS STRING)) AS o, 'iri' AS o_kind, '' AS ext, CAST(substr(p_brand, 7) AS BIGINT) AS wiki_id, 'en' AS lang, replace(p_brand, '#', '') AS domain, 'transitive-redirects' AS dataset FROM {part} WHERE p_partkey % 7 IN (5, 6)
  UNION ALL SELECT concat('http://kg.example.org/', replace(p_brand, '#', ''), '/resource/', CAST(p_partkey + 0 AS STRING)) AS s, 'http://kg.example.org/disambiguates' AS p, concat('http://kg.example.org/', replace(p_brand, '#', ''), '/resource/', CAST(p_partkey + k AS STRING)) AS o, 'iri' AS o_kind, '' AS ext, CAST(substr(p_brand, 7) AS BIGINT) AS wiki_id, 'en' AS lang, replace(p_brand, '#', '') AS domain, 'disambiguations' AS dataset FROM {part} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) d WHERE p_partkey % 10 = 0
  UNION ALL SELECT DISTINCT concat('http://kg.example.org/', replace(p_brand, '#', ''), '/class/', replace(p_type, ' ', '_')) AS s, 'http://www.w3.org/2000/01/rdf-schema#label' AS p, p_type AS o, 'literal' AS o_kind, '@en' AS ext, CAST(substr(p_brand, 7) AS BIGINT) AS wiki_id, 'en' AS lang, replace(p_brand, '#', '') AS domain, 'template-type-definitions' AS dataset FROM {part}
  UNION ALL SELECT DISTINCT concat('http://kg.example.org/', replace(p_brand, '#', ''), '/class/', replace(p_type, ' ', '_')) AS s, 'http://www.w3.org/2000/01/rdf-schema#label' AS p, concat('Typ ', p_type) AS o, 'literal' AS o_kind, '@de' AS ext, CAST(substr(p_brand, 7) AS BIGINT) AS wiki_id, 'en' AS lang, replace(p_brand, '#', '') AS domain, 'template-type-definitions' AS dataset FROM {part}
  UNION ALL SELECT DISTINCT concat('http://kg.example.org/', replace(p_brand, '#', ''), '/class/', replace(p_type, ' ', '_')) AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, 'http://www.w3.org/2002/07/owl#Class' AS o, 'iri' AS o_kind, '' AS ext, CAST(substr(p_brand, 7) AS BIGINT) AS wiki_id, 'en' AS lang, replace(p_brand, '#', '') AS domain, 'template-type-definitions' AS dataset FROM {part}
  UNION ALL SELECT DISTINCT concat('http://kg.example.org/', replace(p_brand, '#', ''), '/property/size', CAST(p_size AS STRING)) AS s, 'http://www.w3.org/2000/01/rdf-schema#label' AS p, concat('size ', CAST(p_size AS STRING)) AS o, 'literal' AS o_kind, '@en' AS ext, CAST(substr(p_brand, 7) AS BIGINT) AS wiki_id, 'en' AS lang, replace(p_brand, '#', '') AS domain, 'infobox-property-definitions' AS dataset FROM {part}
  UNION ALL SELECT DISTINCT concat('http://kg.example.org/', replace(p_brand, '#', ''), '/property/size', CAST(p_size AS STRING)) AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#Property' AS o, 'iri' AS o_kind, '' AS ext, CAST(substr(p_brand, 7) AS BIGINT) AS wiki_id, 'en' AS lang, replace(p_brand, '#', '') AS domain, 'infobox-property-definitions' AS dataset FROM {part}
  UNION ALL SELECT concat('http://kg.example.org/', replace(p_brand, '#', ''), '/resource/', CAST(p_partkey + 0 AS STRING)) AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, concat('http://kg.example.org/', replace(p_brand, '#', ''), '/class/', replace(p_type, ' ', '_')) AS o, 'iri' AS o_kind, '' AS ext, CAST(substr(p_brand, 7) AS BIGINT) AS wiki_id, 'en' AS lang, replace(p_brand, '#', '') AS domain, 'template-type' AS dataset FROM {part}
  UNION ALL SELECT concat('http://kg.example.org/', replace(p_brand, '#', ''), '/resource/', CAST(p_partkey + 0 AS STRING)) AS s, 'http://www.w3.org/2000/01/rdf-schema#comment' AS p, concat(p_name, ' is a ', p_type) AS o, 'literal' AS o_kind, '@en' AS ext, CAST(substr(p_brand, 7) AS BIGINT) AS wiki_id, 'en' AS lang, replace(p_brand, '#', '') AS domain, 'short-abstracts' AS dataset FROM {part} WHERE p_partkey % 5 > 0""",
    # a reference ontology of size classes, and what its names redirect to
    "kg_ontology": """SELECT concat('http://kg.example.org/ontology/S', CAST(n + 0 AS STRING)) AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, 'http://www.w3.org/2002/07/owl#Class' AS o, 'iri' AS o_kind, '' AS ext FROM (SELECT DISTINCT p_size AS n FROM {part}) x
  UNION ALL SELECT concat('http://kg.example.org/ontology/S', CAST(n + 0 AS STRING)) AS s, 'http://www.w3.org/2000/01/rdf-schema#label' AS p, concat('Size ', CAST(n AS STRING)) AS o, 'literal' AS o_kind, '@en' AS ext FROM (SELECT DISTINCT p_size AS n FROM {part}) x WHERE n % 4 > 0
  UNION ALL SELECT concat('http://kg.example.org/ontology/S', CAST(n + 0 AS STRING)) AS s, 'http://www.w3.org/2000/01/rdf-schema#label' AS p, concat('Weite ', CAST(n AS STRING)) AS o, 'literal' AS o_kind, '@de' AS ext FROM (SELECT DISTINCT p_size AS n FROM {part}) x WHERE n % 4 < 2
  UNION ALL SELECT concat('http://kg.example.org/ontology/S', CAST(n + 0 AS STRING)) AS s, 'http://www.w3.org/2000/01/rdf-schema#subClassOf' AS p, concat('http://kg.example.org/ontology/S', CAST(n + 1 AS STRING)) AS o, 'iri' AS o_kind, '' AS ext FROM (SELECT DISTINCT p_size AS n FROM {part}) x WHERE n % 6 > 0
  UNION ALL SELECT concat('http://kg.example.org/ontology/S', CAST(n + 0 AS STRING)) AS s, 'http://www.w3.org/2000/01/rdf-schema#subClassOf' AS p, concat('http://other.example.org/S', CAST(n AS STRING)) AS o, 'iri' AS o_kind, '' AS ext FROM (SELECT DISTINCT p_size AS n FROM {part}) x WHERE n % 6 = 1
  UNION ALL SELECT concat('http://kg.example.org/ontology/p', CAST(n AS STRING)) AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, 'http://www.w3.org/2002/07/owl#DatatypeProperty' AS o, 'iri' AS o_kind, '' AS ext FROM (SELECT DISTINCT p_size AS n FROM {part}) x WHERE n % 2 = 0
  UNION ALL SELECT concat('http://kg.example.org/ontology/p', CAST(n AS STRING)) AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, 'http://www.w3.org/2002/07/owl#ObjectProperty' AS o, 'iri' AS o_kind, '' AS ext FROM (SELECT DISTINCT p_size AS n FROM {part}) x WHERE n % 3 = 0
  UNION ALL SELECT concat('http://kg.example.org/ontology/p', CAST(n AS STRING)) AS s, 'http://www.w3.org/2000/01/rdf-schema#label' AS p, concat(' property ', CAST(n AS STRING)) AS o, 'literal' AS o_kind, '@en' AS ext FROM (SELECT DISTINCT p_size AS n FROM {part}) x WHERE n % 5 > 0""",
    "kg_ontology_redirects": """SELECT concat('http://kg.example.org/ontology/S', CAST(n + 0 AS STRING)) AS s, concat('http://kg.example.org/ontology/S', CAST(n - 1 AS STRING)) AS o FROM (SELECT DISTINCT p_size AS n FROM {part}) x WHERE n % 9 = 0
  UNION ALL SELECT concat('http://kg.example.org/ontology/p', CAST(n AS STRING)), concat('http://kg.example.org/ontology/q', CAST(n AS STRING)) FROM (SELECT DISTINCT p_size AS n FROM {part}) x WHERE n % 8 = 0""",
    # gold: same name and type in two brands; every third without a counterpart
    "kg_gold": """SELECT concat('brand~', a.p_brand) AS pair, concat('http://kg.example.org/', a.p_brand, '/resource/', CAST(a.p_partkey AS STRING)) AS source,
  CASE WHEN a.p_partkey % 3 = 0 THEN 'null' ELSE concat('http://kg.example.org/', b.p_brand, '/resource/', CAST(b.k AS STRING)) END AS target,
  CASE WHEN a.p_partkey % 3 = 0 THEN '%' ELSE '=' END AS relation, CAST(1.0 AS DOUBLE) AS confidence
  FROM {part} a JOIN (SELECT p_name, p_brand, min(p_partkey) AS k FROM {part} WHERE p_brand = 'Brand#1' GROUP BY p_name, p_brand) b ON a.p_name = b.p_name
  WHERE a.p_brand <> 'Brand#1'
  UNION ALL SELECT concat('brand~', p_brand), 'null', concat('http://kg.example.org/Brand#1/resource/', CAST(p_partkey + 1 AS STRING)), '%', CAST(1.0 AS DOUBLE) FROM {part} WHERE p_partkey % 40 = 7 AND p_brand <> 'Brand#1'""",
    # a system: same name in Brand#1, or a neighbour, with a made-up confidence
    "kg_system": """SELECT concat('brand~', a.p_brand) AS pair, concat('http://kg.example.org/', a.p_brand, '/resource/', CAST(a.p_partkey AS STRING)) AS source,
  concat('http://kg.example.org/', b.p_brand, '/resource/', CAST(b.k + CASE WHEN a.p_partkey % 5 = 0 THEN 1 ELSE 0 END AS STRING)) AS target, '=' AS relation,
  CAST((a.p_partkey * 37 + b.k) % 100 AS DOUBLE) / 100 AS confidence
  FROM {part} a JOIN (SELECT p_name, p_brand, min(p_partkey) AS k FROM {part} WHERE p_brand = 'Brand#1' GROUP BY p_name, p_brand) b ON a.p_name = b.p_name
  WHERE a.p_brand <> 'Brand#1' AND a.p_partkey % 4 > 0""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def cte(*names: str) -> str:
    """``WITH RECURSIVE`` and the views, for DuckDB over tables of their own names."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in names)
