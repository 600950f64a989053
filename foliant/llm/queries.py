"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import canonical, encodings, mixing, residue, scans, sentences, splitting, tokens, webspam
from foliant.session import read_table, spread


def _texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The columns named and the text of a table, over all cores."""
    return spread(read_table(spark, sf_dir, name).select(*columns, "text"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(_texts(spark, sf_dir, "documents", "doc_id"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(_texts(spark, sf_dir, "documents", "doc_id", "source"), read_table(spark, sf_dir, "mix_targets"))


def p8_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix itself, in its shuffled order."""
    return mixing.shuffled_copies(_mixed(spark, sf_dir)[1])


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached, by source."""
    return _mixed(spark, sf_dir)[0]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.wrongly_decoded(_texts(spark, sf_dir, "pages", "page_id")).select("page_id")


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with their wrongly decoded passages restored where they can be."""
    return encodings.wrongly_decoded(_texts(spark, sf_dir, "pages", "page_id"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scans.defects(_texts(spark, sf_dir, "pages", "page_id", "book", "page_index", "flags"), read_table(spark, sf_dir, "books"))
    return found.select("page_id", "line_no", "defect").distinct()


def p2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous paragraphs of the scanned pages."""
    return scans.paragraphs(_texts(spark, sf_dir, "pages", "page_id", "book", "page_index", "flags"), read_table(spark, sf_dir, "books"))


def _residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.find_residue(residue.note_fields(spread(read_table(spark, sf_dir, "note_blocks").select("block_no", "fields"))))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _residue(spark, sf_dir).select("block_no", "field_no")


def p3_clean_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of all notes without those that hold residue."""
    return residue.without_residue(read_table(spark, sf_dir, "note_blocks"), _residue(spark, sf_dir))


def _pieces(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    tasks = spread(read_table(spark, sf_dir, "tasks").select("task_id", "tier", "read"))
    items = splitting.all_items(_texts(spark, sf_dir, "pages", "page_id"), tasks)
    return splitting.split_items(items, read_table(spark, sf_dir, "size_limits"), with_text)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that had to be split: the first of several pieces stands for its item."""
    return _pieces(spark, sf_dir, False).where("piece_no = 0 AND n_pieces > 1").select("item_kind", "item_id", "read_no")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, True)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence units of the sampled pages, whose language is at hand."""
    sample = read_table(spark, sf_dir, "sentence_sample").select("page_id", "text_lang")
    pages = read_table(spark, sf_dir, "pages").select("page_id", "text").join(sample, "page_id")
    return sentences.sentences(pages, lang_col="text_lang")


def p5_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence units of every page, with their text."""
    return sentences.sentences(_texts(spark, sf_dir, "pages", "page_id"), with_text=True)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.hidden_quotes(read_table(spark, sf_dir, "quote_checks"), read_table(spark, sf_dir, "pages"))


def p6_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page text in the consistent form."""
    return read_table(spark, sf_dir, "pages").select("page_id", canonical.canonical_text(F.col("text")).alias("text"))


def p6_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quote in the consistent form."""
    return read_table(spark, sf_dir, "quote_checks").select("check_id", canonical.canonical_text(F.col("quote")).alias("quote"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webspam.find_spam(_texts(spark, sf_dir, "documents", "doc_id", "lang"), lang_col="lang").select("doc_id")


QUERIES: dict = {
    "p1_found": p1_found,
    "p1_restored": p1_restored,
    "p2_found": p2_found,
    "p2_paragraphs": p2_paragraphs,
    "p3_found": p3_found,
    "p3_clean_fields": p3_clean_fields,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p5_found": p5_found,
    "p5_sentences": p5_sentences,
    "p6_found": p6_found,
    "p6_texts": p6_texts,
    "p6_quotes": p6_quotes,
    "p7_ids": p7_ids,
    "p8_copies": p8_copies,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
}
ORACLES: dict = {
    "p4_found": """
WITH bound AS (SELECT item_kind, tier, min(max_chars) AS max_chars FROM size_limits GROUP BY ALL),
items AS (
  SELECT 'page' AS item_kind, page_id AS item_id, 0 AS read_no, 'any' AS tier, text FROM pages
  UNION ALL
  SELECT 'task', task_id, i - 1, tier, read[i].text FROM (SELECT task_id, tier, read, unnest(range(1, len(read) + 1)) AS i FROM tasks)
)
SELECT item_kind, item_id, CAST(read_no AS INTEGER) AS read_no FROM items JOIN bound USING (item_kind, tier) WHERE length(text) > max_chars
""",
}
