"""Row types of the engine, declared once; nothing is inferred."""

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    kinds = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in text.split())])


TRIPLE = _struct("s:string p:string o:string o_kind:string ext:string")
DUMP_TRIPLE = _struct("s:string p:string o:string o_kind:string ext:string wiki_id:long lang:string domain:string dataset:string")
ALIGNMENT = _struct("pair:string source:string target:string relation:string confidence:double")
SAME_AS = _struct("uri:string component:string size:long canonical:string")
TITLE = _struct("wiki_id:long domain:string title:string")
LABEL = _struct("domain:string s:string label:string")
VOTE = _struct("hit:string item:int worker:string answer:string")
VECTOR = T.StructType([T.StructField("uri", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType()))])
CORPUS = _struct("tag:string text:string")

# fixed column names of the metadata table, in file order
WIKI_META = _struct(
    "id:long title:string url:string wordmark:string topUsers:string headline:string name:string domain:string "
    "hub:string lang:string topic:string flags:string desc:string image:string wam_score:double "
    "stats_edits:long stats_articles:long stats_pages:long stats_users:long stats_activeUsers:long "
    "stats_images:long stats_videos:long stats_admins:long stats_discussions:long "
    "current_dump_url:string current_compression:string current_date:string current_time:string "
    "full_dump_url:string full_compression:string full_date:string full_time:string"
)

# vocabulary (fixed values)
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
LABEL_P, TYPE_P, SUBCLASS_P = RDFS + "label", RDF + "type", RDFS + "subClassOf"
DOMAIN_P, RANGE_P, LITERAL = RDFS + "domain", RDFS + "range", RDFS + "Literal"
SAME_AS_P, EQ_CLASS_P, EQ_PROPERTY_P, THING = OWL + "sameAs", OWL + "equivalentClass", OWL + "equivalentProperty", OWL + "Thing"
CLASS, DATATYPE_PROPERTY, OBJECT_PROPERTY = OWL + "Class", OWL + "DatatypeProperty", OWL + "ObjectProperty"
NULL = "null"  # "no counterpart" in alignments
