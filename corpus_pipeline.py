"""From raw documents to packed training sequences: drop what is poor or in no known language, keep one document
of each group of near-duplicates, take out secrets, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adjudica.llm import langid, packing, quality, secrets, simhash
from adjudica.llm.common import dealt, discard, few, scratch, staged, table
from adjudica.llm.queries import remainder, tokenizer


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts 1 for.

    Every row is judged by its whole text, so repeated rows stay or go together; null and empty texts are scored as texts without words, and
    rows with a null id as any other (they only teach nothing). Where nothing is labelled, nothing is rejected; an empty table stays
    empty. Of labels, larger ones and of texts lesser features count where an id has several. Columns stay as they are,
    whatever their names.
    """
    labels = table(spark, sf_dir, "labels").filter(remainder(4) != 2)
    model = quality.fit(docs, labels)
    if not model.tables:
        return docs
    return quality.scored(docs, model, names=("__score", "__predicted")).filter("__predicted = 1").select(docs.columns)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin that isn't narrow.

    Texts that are null, empty or without a letter have no language and go; repeated rows stay or go together; very long texts are judged
    whole; of languages that compress a text equally the margin is zero, so it goes. Rows with a null id or language are judged as others, and
    teach nothing. Where nothing is labelled, nothing is rejected; an empty table stays empty. Columns stay as they are.
    """
    dictionaries = langid.fit(docs.filter(remainder(3) != 1))
    if not dictionaries:
        return docs
    return langid.identified(docs, dictionaries, names=("__lang", "__score", "__reliable")).filter("__reliable").select(docs.columns)


#: Ids up to this many are broadcast to the documents that they drop; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _held(ids: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """Distinct ids of a table of *rows* rows, written once and marked for broadcast if they are few enough; and how many there are."""
    out, _ = staged(few(ids, rows), "ids")
    n = out.count()
    return (F.broadcast(out) if n <= BROADCAST_IDS else out), n


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates (a similarity of about 0.8 or more of shingles of five words), in one row
    even if its row is repeated.

    Rows without an id, which no group can name, stay. Null and empty texts are near-duplicates of one another. Of rows that repeat an id the
    first by text and then by the other columns stays. An empty table stays empty; columns stay as they are. Ids of what goes and
    of repeated rows are found first, from ids and fingerprints alone, so texts are shuffled only beyond BROADCAST_IDS of them.
    """
    named = docs.filter("doc_id is not null")
    found = simhash.near_duplicates(docs, simhash.SIMILAR).filter("doc_id is not null")
    by_id = found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n"))
    marks, path = staged(few(by_id.filter("doc_id <> component_id or n > 1"), docs.count()), "marked")
    rows = marks.count()
    others, _ = _held(marks.filter("doc_id <> component_id").select("doc_id"), rows)
    repeated, n = _held(marks.filter("doc_id = component_id").select("doc_id"), rows)
    kept = named.join(others, "doc_id", "left_anti").select(docs.columns)
    if n:
        copy = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns)))))
        once = kept.join(repeated, "doc_id", "left_semi").withColumn("__copy", copy).filter("__copy = 1").select(docs.columns)
        kept = kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionAll(once)
    discard(spark, path)
    return kept.unionAll(docs.filter("doc_id is null"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars (if there is such a column) counted anew.

    Null texts stay null, with a null n_chars; empty ones stay empty; repeated rows are treated each; whole texts are scanned whatever their
    length; where secrets overlap, what they cover together becomes one mark. An empty table stays empty; other columns stay as they are.
    """
    clean = secrets.redact(docs, secrets.train(secrets.samples(spark)))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens.

    Null and empty texts are the end id alone; longer ones are cut; repeated rows are packed each and null ids stay null; documents of equal
    length are placed in any order; other columns are not read; an empty table gives no pieces.
    """
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_duplicates", keep_one_of_each_group),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: The stages learn models and merge tokens, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep; each stage's rows are written and read again."""
    docs, before = dealt(table(spark, sf_dir, "documents")), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as made:
            docs, path = staged(stage(spark, docs, sf_dir), name)
            made.remove(path)  # what the stage wrote on its way goes, and so does the table that it read
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
