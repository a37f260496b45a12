"""From raw documents to packed sequences: quality rules, near-dedup, secret scan, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The
result of each is written as Parquet and read again for the next.

Defined cases: documents whose text is null or empty fail the base rule and go in the first stage, whatever else they
have; very long ones are taken whole by every stage. Documents with null doc_id are judged, grouped, searched and mixed
like any other (null ids come last where order counts). Of repeated rows one is left after the second stage; rows that tie
in doc_id but not in text are documents of their own throughout. An empty table gives an empty result. Columns beside
doc_id, text and source ride along under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm.common import read, staged
from shelfwise.llm.mixing import mix_documents
from shelfwise.llm.near_dedup import drop_near_duplicates
from shelfwise.llm.packing import pack_documents
from shelfwise.llm.quality_rules import keep_good
from shelfwise.llm.secret_scan import redact

STAGES = [
    ("quality_rules", keep_good),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", redact),
    ("source_mix", mix_documents),
    ("packing", pack_documents),
]

#: A forest of random trees, minwise sketches and a tokenizer stand behind the rows: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
