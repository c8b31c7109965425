"""Corpus cleaning from documents to packed sequences; each stage is one operator and its decisions take effect.

All stages but the last return the columns of documents, also columns that are named as an operator's own. Rows are told apart by their texts, never by doc_id alone, so null and
repeated ids are kept apart; an empty table gives no rows in every stage; texts of any length are read whole.
"""

from cindergrid.llm import decontam, linededup, minhash, packing, quality, registry
from cindergrid.llm.textkit import written

LEAST = 0.7


def quality_stage(spark, docs, sf_dir):
    """Documents that the classifier rejects (score under LEAST) go. Null and empty texts share one score; equal texts are all kept or all go. Without labels all scores are one half or the labels' share."""
    net = quality.fit(registry.read(spark, sf_dir, "documents"), registry.read(spark, sf_dir, "labels"), registry.remainder(4) != 2)
    return quality.kept(docs, net, LEAST)


def line_stage(spark, docs, sf_dir):
    """Lines that match an earlier line go from the texts; the documents stay. Null texts stay null; rows equal in doc_id and text are one document; null ids come first."""
    return linededup.dedup_lines(docs).select(*docs.columns)


def minhash_stage(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays: one of least doc_id, of ids that are null only if there are no others. Null and empty texts are one group."""
    return minhash.keep_one(docs)


def decontam_stage(spark, docs, sf_dir):
    """Documents that leak a test item go, with or without ids. Null and empty texts and items match nothing."""
    return decontam.clean(docs, registry.read(spark, sf_dir, "benchmark"))


def packing_stage(spark, docs, sf_dir):
    """Pieces of the remaining documents and their places in sequences. Null and empty texts are one piece, the closing id."""
    return packing.pack(docs, ids=False)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("minhash", minhash_stage), ("decontam", decontam_stage), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark, sf_dir):
    """Each stage's rows are written and read again, so that a lost executor costs one stage at most."""
    docs = registry.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
