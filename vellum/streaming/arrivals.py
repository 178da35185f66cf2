"""New books against a standing corpus, in micro-batches.

The corpus's shingles are written once; each micro-batch of new pages is cut into windows, and its shingles are joined with the
index. A book must arrive within one batch, for windows run over its pages. A page that arrives again within the watermark is
dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.cut import cut
from vellum.functions.pages import KEY
from vellum.operators.tokens import page_lemmas
from vellum.operators.windows import shingle_array, token_windows
from vellum.params import Params


def _keys(windows: DataFrame, n: int) -> DataFrame:
    x = windows.select("book_id", "window_idx", F.explode(shingle_array(F.col("lemma_ids"), n)).alias("x"))
    return x.select("book_id", "window_idx", F.xxhash64("x").alias("h"), F.xxhash64(F.lit(17), F.reverse("x")).alias("g"))


def shingle_index(pages: DataFrame, p: Params) -> DataFrame:
    """(book_id, window_idx, h, g) of a corpus of pages with lemma_ids, written to the shared folder."""
    return cut(_keys(token_windows(pages, p, ("lemma_ids",)), p.ngram_size))


def candidates_of(new_pages: DataFrame, dim: DataFrame, index: DataFrame, p: Params) -> DataFrame:
    """(new_book, new_widx, book_id, window_idx, shared) of one batch of packed pages."""
    new = _keys(token_windows(page_lemmas(new_pages, dim), p, ("lemma_ids",)), p.ngram_size).select(F.col("book_id").alias("new_book"), F.col("window_idx").alias("new_widx"), "h", "g")
    met = new.join(index, ["h", "g"]).filter("new_book <> book_id")
    return met.groupBy("new_book", "new_widx", "book_id", "window_idx").agg(F.count("*").alias("shared")).filter(F.col("shared") >= p.min_shared_shingles)


def stream_candidates(stream: DataFrame, dim: DataFrame, index: DataFrame, p: Params, out: str, checkpoint: str, watermark: str = "1 hour", **trigger):
    """Start the query: pages with ``loaded_at`` in, Parquet of candidate windows out."""
    once = stream.withWatermark("loaded_at", watermark).dropDuplicatesWithinWatermark(KEY)
    write = lambda batch, _: candidates_of(batch.drop("loaded_at"), dim, index, p).write.mode("append").parquet(out)
    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def page_rate(stream: DataFrame, every: str = "10 minutes", watermark: str = "1 hour") -> DataFrame:
    """Pages and tokens that arrived per window of time and book; late rows beyond the watermark are left out."""
    n = F.when(F.octet_length("token_ids") % 4 == 0, F.octet_length("token_ids") / 4).otherwise(0)
    return stream.withWatermark("loaded_at", watermark).groupBy(F.window("loaded_at", every), "book_id").agg(F.count("*").alias("pages"), F.sum(n.cast("bigint")).alias("tokens"))
