"""Questions from a terminal or any list of lines, answered from a store."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from quillvec.operators.embed import embed
from quillvec.operators.store import VectorStore
from quillvec.operators.tokenizer import TokenizerModel


def embed_text(spark: SparkSession, text: str, model: TokenizerModel, weights: DataFrame) -> list[float]:
    """The vector of one text; empty if none of its tokens has a weight."""
    row = embed(spark.createDataFrame([(0, text)], "doc_id int, text string"), model, weights).first()
    return list(row.vector) if row.vector else []


def answers(spark: SparkSession, lines: Iterable[str], store: VectorStore, model: TokenizerModel, weights: DataFrame, k: int = 1) -> Iterator[str]:
    """For each line, without its line feeds, the first lines of the ``k`` nearest texts; an empty line ends it."""
    for line in lines:
        question = line.replace("\n", "")
        if not question:
            return
        yield store.search_text(embed_text(spark, question, model, weights), k)


def show(results: DataFrame) -> str:
    """Search results, a line each: id, similarity with three digits, path."""
    rows = results.select("id", "similarity", "file_path").collect()  # k rows
    return "".join(f"{r.id}\t{r.similarity:.3f}\t{r.file_path}\n" if r.similarity is not None else f"{r.id}\t-\t{r.file_path}\n" for r in rows)
