"""From raw documents to packed training sequences, in five stages over whole tables.

Every stage reads what its predecessor wrote. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelake.llm import langid, mixing, packing, places, quality, simhash
from mergelake.llm.common import crc32_remainder, release, scratch_path, scratch_scope
from mergelake.llm.queries import tokenizer_path

#: Cosine with the best language prototype below which a document is taken for no language.
LEAST_LANGUAGE_SCORE = 0.05

_last: list = []


def _staged(stage):
    """A stage's scratch tables go when the next stage begins: by then its result has been written."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(_last)
        with scratch_scope() as made:
            out = stage(spark, docs, sf_dir)
        _last.extend(made)
        return out

    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


@_staged
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that are like no language learned here.

    Null, empty and blank texts have no letter and go. Very long texts are looked at whole. Repeated rows share their
    fate; null ids are learned from by nobody and judged like any other. Without a language to learn, as in an empty
    table, nothing is left. Other columns, whatever their names, stay as they are.
    """
    prototypes = langid.fit_prototypes(docs.where(crc32_remainder(F.col("doc_id"), 5) != 0))
    return langid.keep_identified(docs, prototypes, LEAST_LANGUAGE_SCORE)


@_staged
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or are depleted of lines of their own.

    Null, empty and blank texts have too few words and go. Very long texts are measured whole. Repeated rows are
    documents each for itself, and so are rows with null or equal ids; null sources are a host of their own. An empty
    table stays empty. Other columns, whatever their names, stay as they are.
    """
    place = places.free_name(docs, "place")
    return places.taken(docs, quality.rate(places.placed(docs, place), id_col=place).where("kept").select(place), place)


@_staged
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five-word shingles, Jaccard similarity of 0.8 or more) the first row stays.

    The first is that with the least place: file, then row. Null, empty and blank texts are copies of each other;
    repeated rows are copies too, whatever their ids. Very long texts are compared whole. An empty table stays empty.
    Other columns, whatever their names, stay as they are.
    """
    place = places.free_name(docs, "place")
    rows = places.placed(docs, place)
    classes = simhash.similar_documents(rows, place, pick=lambda ids, function, schema: places.taken(docs, ids, place, columns=["text"], function=function, schema=schema))
    return places.taken(docs, classes.where(F.col(place) == F.col("component_id")).select(place), place)


@_staged
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, at most three times.

    Null, empty and blank texts have no words and are taken never. Very long texts are taken whole. Repeated rows, and
    rows with null or equal ids, are documents each for itself; null sources are a source, the last in order. An empty
    table stays empty. Other columns, whatever their names, stay as they are.
    """
    place = places.free_name(docs, "place")
    copies = mixing.mix(places.placed(docs, place), id_col=place).where("copies > 0").select(place, "copies")
    return places.taken(docs, copies, place, "copies")


@_staged
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences, in the columns of :func:`mergelake.llm.packing.pack`.

    Null and empty texts are documents of the end id alone; very long ones are cut into full sequences and a rest.
    Repeated rows, and rows with null or equal ids, are packed each for itself. An empty table gives no pieces. Other
    columns, whatever their names, are left out.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]

#: Models and tokenizer ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    release(_last)
    return docs
