"""Schemas of the model's tables and the category taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

INTERACTIONS = T.StructType(
    [
        T.StructField("id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("paper_id", T.LongType()),
        T.StructField("event_type", T.StringType()), T.StructField("source", T.StringType()), T.StructField("position", T.IntegerType()),
        T.StructField("query_id", T.StringType()), T.StructField("ranker_version", T.StringType()), T.StructField("candidate_source", T.StringType()),
        T.StructField("cluster_id", T.IntegerType()), T.StructField("timestamp", T.TimestampNTZType()),
    ]
)
CLUSTERS = "user_id long, cluster_idx int, medoid_paper_id long, medoid_embedding array<double>, paper_ids array<long>, importance double"

# Category groups offered to new users, and the codes each stands for.
CATEGORY_GROUPS: dict[str, tuple[str, list[str]]] = {
    "nlp": ("Natural Language Processing", ["cs.CL", "cs.IR"]),
    "cv": ("Computer Vision", ["cs.CV"]),
    "ml": ("Machine Learning", ["cs.LG", "stat.ML"]),
    "ai": ("Artificial Intelligence", ["cs.AI"]),
    "robotics": ("Robotics", ["cs.RO"]),
    "hep": ("High Energy Physics", ["hep-ph", "hep-th", "hep-ex", "hep-lat"]),
    "astro": ("Astrophysics", ["astro-ph.GA", "astro-ph.CO", "astro-ph.SR", "astro-ph.HE"]),
    "quant_ph": ("Quantum Computing", ["quant-ph"]),
    "math": ("Mathematics", ["math.CO", "math.AG", "math.NT", "math.PR", "math.AP"]),
    "bio": ("Computational Biology", ["q-bio.BM", "q-bio.GN", "q-bio.QM"]),
    "neuro": ("Neuroscience", ["q-bio.NC"]),
    "econ": ("Economics & Game Theory", ["econ.TH", "cs.GT"]),
    "crypto": ("Cryptography & Security", ["cs.CR"]),
    "systems": ("Systems & Networking", ["cs.DC", "cs.NI"]),
    "hci": ("Human-Computer Interaction", ["cs.HC"]),
    "audio": ("Speech & Audio", ["cs.SD", "eess.AS"]),
    "pde": ("Physics — General", ["physics.flu-dyn", "physics.comp-ph", "physics.optics"]),
    "cond_mat": ("Condensed Matter", ["cond-mat.mes-hall", "cond-mat.mtrl-sci", "cond-mat.str-el"]),
    "se": ("Software Engineering", ["cs.SE", "cs.PL"]),
    "acl_acl": ("Signal Processing", ["eess.SP", "eess.IV"]),
}


def taxonomy(spark: SparkSession) -> DataFrame:
    """``group_key``, ``name``, ``codes``: a row per group, of fixed number."""
    return spark.createDataFrame([(k, n, c) for k, (n, c) in CATEGORY_GROUPS.items()], "group_key string, name string, codes array<string>")
