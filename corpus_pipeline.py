"""Documents to training shards: toxic documents go, of near copies one stays,
documents with benchmark passages go, sources are mixed to their weights, and
what is left is dealt into shards.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept; all but the last return the columns of ``documents``.
"""

from duolex.llm.decontamination import drop_contaminated
from duolex.llm.minhash import drop_near_duplicates
from duolex.llm.mixing import mix_documents
from duolex.llm.queries import table
from duolex.llm.sharding import shard_by_bytes
from duolex.llm.toxicity import ToxicityModel, drop_toxic
from duolex.session import materialise


def toxicity(spark, docs, sf_dir):
    return drop_toxic(docs, ToxicityModel(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark, docs, sf_dir):
    return drop_near_duplicates(docs)


def decontamination(spark, docs, sf_dir):
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark, docs, sf_dir):
    return mix_documents(docs)


def sharding(spark, docs, sf_dir):
    return shard_by_bytes(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The first stages have no SQL form; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
