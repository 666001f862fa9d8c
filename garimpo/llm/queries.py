"""The queries of the operators in this subpackage, each over its whole tables."""

from __future__ import annotations

from garimpo.llm import conversations, garbled, mixing, neighbours, scan_noise, splitting, subjects, tokens
from garimpo.session import checkpoint_dir, table


def p1_found(spark, sf_dir):
    """(src, row_key) of texts with marks of a wrong decoding."""
    blocks = garbled.found_rows(table(spark, sf_dir, "pdf_blocks"), "block_key", src="pdf_blocks")
    chunks = garbled.found_rows(table(spark, sf_dir, "legal_chunks"), "chunk_key", src="legal_chunks")
    return blocks.unionByName(chunks)


def p1_restored(spark, sf_dir):
    """Affected texts with what could be restored."""
    blocks = garbled.garbled(table(spark, sf_dir, "pdf_blocks"), "block_key", src="pdf_blocks")
    chunks = garbled.garbled(table(spark, sf_dir, "legal_chunks"), "chunk_key", src="legal_chunks")
    return blocks.unionByName(chunks).distinct()


def _both(spark, sf_dir, make):
    """make over the texts of legal_nodes and legal_chunks, with the table's name as src."""
    from pyspark.sql import functions as F

    nodes = make(table(spark, sf_dir, "legal_nodes"), "node_key").withColumn("src", F.lit("legal_nodes"))
    chunks = make(table(spark, sf_dir, "legal_chunks"), "chunk_key").withColumn("src", F.lit("legal_chunks"))
    both = nodes.unionByName(chunks)
    return both.select("src", *[c for c in both.columns if c != "src"])


def p6_found(spark, sf_dir):
    """(src, row_key, cut_class) of each text over the limit."""
    return _both(spark, sf_dir, splitting.cut_classes)


def p6_pieces(spark, sf_dir):
    """All pieces of the texts of both tables."""
    return _both(spark, sf_dir, splitting.pieces)


def p6_file_pieces(spark, sf_dir):
    """The texts of legal_nodes written to giant text files in the shared folder, cut there by byte ranges."""
    from pyspark.sql import functions as F

    folder = f"{checkpoint_dir(spark)}/p6_texts"
    table(spark, sf_dir, "legal_nodes").filter("text is not null").select(F.col("text").alias("value")).write.mode("overwrite").text(folder)
    files = sorted(r[0] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("path").collect())
    return splitting.file_pieces(spark, [f.removeprefix("file:") for f in files], range_bytes=1 << 20).withColumn("path", F.element_at(F.split("path", "/"), -1))


def p7_found(spark, sf_dir):
    """(conversation_id, defect) of each dropped conversation."""
    return conversations.defects(table(spark, sf_dir, "messages"))


def p7_conversations(spark, sf_dir):
    """The good conversations, turn by turn."""
    return conversations.rebuild(table(spark, sf_dir, "messages"))


def p8_ids(spark, sf_dir):
    """Token ids of each document."""
    return tokens.encode(table(spark, sf_dir, "documents"))


def p2_found(spark, sf_dir):
    """Pairs of vectors of which at least one is among the 5 nearest of the other."""
    return neighbours.pairs(table(spark, sf_dir, "vector_items"))


def p9_mix(spark, sf_dir):
    """Every use of a document in the mix, with its shard and its place there."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))


def p9_shares(spark, sf_dir):
    """Target and actual share of each source."""
    return mixing.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))


def p10_found(spark, sf_dir):
    """(doc_id, subject) of documents of which at least a fifth of the sentences deal with the subject."""
    return subjects.subjects_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_examples"))


def p10_composition(spark, sf_dir):
    """Documents and sentences of each subject."""
    return subjects.composition(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_examples"))


def p4_found(spark, sf_dir):
    """(src, row_key, noise_kind) of the noise of scanned pages."""
    return scan_noise.Noise(table(spark, sf_dir, "pdf_blocks"), table(spark, sf_dir, "pipeline_results")).found()


def p4_repaired(spark, sf_dir):
    """The texts of both tables, repaired into continuous paragraphs."""
    return scan_noise.Noise(table(spark, sf_dir, "pdf_blocks"), table(spark, sf_dir, "pipeline_results")).repaired()


QUERIES = {f.__name__: f for f in (p1_found, p1_restored, p2_found, p4_found, p4_repaired, p6_found, p6_pieces, p6_file_pieces, p7_found, p7_conversations, p8_ids, p9_mix, p9_shares, p10_found, p10_composition)}
