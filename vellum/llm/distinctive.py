"""Problem 2: how distinctive a term is per record, by a two-Poisson mixture per term.

A term's counts over all records are taken as a mixture of a low rate (records that merely mention it) and a high rate
(records that are about it). The mixture is fitted by expectation-maximisation on the term's frequency histogram, which has
one entry per distinct count, so its size does not follow the number of records.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.cut import cut
from vellum.functions.pages import unlist
from vellum.operators.tokens import page_lemmas, token_dim

TINY = 1e-9
#: A term's fit ends when a round adds less than this to the log-likelihood of a record.
GAIN = 1e-9


def _lemma_counts(batches):
    """(book, lemma, n) of each batch of pages, counted before anything is shuffled."""
    for batch in batches:
        flat, at = unlist(batch.column("lemma_ids"))
        book = np.asarray(batch.column("book_id").fill_null(0), np.int64)
        rows = np.repeat(np.arange(len(book)), np.diff(at))
        keep = (flat != 0) & ~np.asarray(batch.column("book_id").is_null())[rows]
        books, code = np.unique(book[rows[keep]], return_inverse=True)
        lemmas, term = np.unique(flat[keep], return_inverse=True)
        pair, n = np.unique(code.astype(np.int64) * max(1, len(lemmas)) + term, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(books[pair // max(1, len(lemmas))], pa.int64()), pa.array(lemmas[pair % max(1, len(lemmas))], pa.int64()), pa.array(n.astype(np.int64))], names=["book_id", "lemma_id", "n"])


def book_terms(page_tokens: DataFrame, definitions: DataFrame) -> DataFrame:
    """(book_id, lemma_id, tf): occurrences of every lemma in every book; lemma null or 0 is no term."""
    pages = page_lemmas(page_tokens, token_dim(definitions)).select("book_id", "lemma_ids")
    return pages.mapInArrow(_lemma_counts, "book_id bigint, lemma_id bigint, n bigint").groupBy("book_id", "lemma_id").agg(F.sum("n").alias("tf"))


def fit(k: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two-Poisson mixtures of many histograms at once: counts ``k`` seen ``n`` times; histogram i is ``at[i]:at[i+1]``.

    Each histogram is fitted until its likelihood stands still, those that do leaving the rest to go on. Returns (share of the
    high component, high rate, low rate) per histogram.
    """
    out = np.zeros((3, len(at) - 1))
    which, last = np.arange(len(at) - 1), np.full(len(at) - 1, -np.inf)
    r = None
    while len(which):
        seg, size = at[:-1], np.diff(at)
        add = lambda x: np.add.reduceat(x, seg)  # noqa: E731, B023
        total, mass = add(n), add(n * k)
        if r is None:
            r = (k > np.repeat(mass / np.maximum(total, 1), size)).astype(float)
        high, heavy = add(n * r), add(n * r * k)
        share = np.clip(high / np.maximum(total, 1), TINY, 1 - TINY)
        up = np.maximum(heavy / np.maximum(high, TINY), TINY)
        low = np.minimum(np.maximum((mass - heavy) / np.maximum(total - high, TINY), TINY), up)
        x, y = (np.repeat(np.log(p), size) - np.repeat(m, size) + k * np.repeat(np.log(m), size) for p, m in ((share, up), (1 - share, low)))
        r = 1 / (1 + np.exp(-np.clip(x - y, -700, 700)))
        likely = add(n * (np.maximum(x, y) + np.log1p(np.exp(-np.abs(x - y)))))
        out[:, which] = share, up, low
        going = likely - last > GAIN * total
        keep = np.repeat(going, size)
        k, n, r, which, last = k[keep], n[keep], r[keep], which[going], likely[going]
        at = np.concatenate([[0], np.cumsum(size[going])])
    return tuple(out)


def posterior(k, share, up, low):
    """Probability that a count comes from the high component."""
    odds = (np.log(share) - up + k * np.log(up)) - (np.log(1 - share) - low + k * np.log(low))
    return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def _fitted(records: int):
    def run(batches):
        for batch in batches:
            hist = batch.column("hist").flatten()
            size = np.asarray(batch.column("hist").value_lengths(), np.int64)
            df = np.asarray(batch.column("df"), np.int64)
            term = np.asarray(batch.column("lemma_id"), np.int64)
            if not len(term):
                continue
            k0, n0 = (np.asarray(hist.field(i), float) for i in (0, 1))
            at = np.concatenate([[0], np.cumsum(size)])
            zero = at[:-1]  # records without the term open each histogram
            k, n = np.insert(k0, zero, 0.0), np.insert(n0, zero, np.maximum(records - df, 0))
            at = np.concatenate([[0], np.cumsum(size + 1)])
            share, up, low = fit(k, n, at)
            score = posterior(k0, *(np.repeat(x, size) for x in (share, up, low)))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(term, size)), pa.array(k0.astype(np.int64)), pa.array(score), pa.array(np.repeat(df, size))], names=["lemma_id", "tf", "score", "df"])

    return run


def distinctive_terms(page_tokens: DataFrame, definitions: DataFrame) -> DataFrame:
    """(book_id, lemma_id, tf, df, score) for every lemma of every book.

    ``score`` is the probability that the lemma's count in the book comes from the high-rate component of its mixture: near 1
    where the lemma is frequent here and rare or absent elsewhere, near the component's share where all books use it alike.
    Books without tokens count as records. Pages with null, empty or broken blobs hold no tokens; repeated pages count once;
    empty tables give no rows.
    """
    tf = cut(book_terms(page_tokens, definitions))
    records = page_tokens.filter("book_id is not null").select("book_id").distinct().count()
    hist = tf.groupBy("lemma_id", "tf").agg(F.count("*").alias("n")).groupBy("lemma_id").agg(F.collect_list(F.struct("tf", "n")).alias("hist"), F.sum("n").alias("df"))
    score = hist.mapInArrow(_fitted(records), "lemma_id bigint, tf bigint, score double, df bigint")
    return tf.join(score, ["lemma_id", "tf"]).select("book_id", "lemma_id", "tf", "df", "score")
