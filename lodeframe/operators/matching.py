"""Linking records by blocking keys, scored candidates and page windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quote_score, quote_words, run_hashes
from ..session import broadcast_if_small
from .relational import top_per_group


def blocked_candidates(left: DataFrame, right: DataFrame, left_id: str, right_id: str, blocks: Sequence[tuple[Column, Column]]) -> DataFrame:
    """Distinct (left_id, right_id, by) pairs that share a key in any block; ``by`` is a bit mask of the blocks.

    Each block is (array of keys of the left row, array of keys of the right row); a
    block is one equi-join, and the union is aggregated once.
    """
    parts = []
    for i, (lk, rk) in enumerate(blocks):
        a = left.select(left_id, F.explode(F.array_distinct(lk)).alias("_k")).where("_k is not null")
        b = right.select(right_id, F.explode(F.array_distinct(rk)).alias("_k")).where("_k is not null")
        parts.append(a.join(b, "_k").select(left_id, right_id, F.lit(1 << i).alias("_b")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(left_id, right_id).agg(F.bit_or("_b").alias("by"))


def scored_matches(left: DataFrame, right: DataFrame, left_id: str, right_id: str, blocks: Sequence[tuple[Column, Column]], score: Callable[[Column], Column], least: float, k: int = 3) -> DataFrame:
    """The k best candidates of each left row with a score of at least ``least``: (left_id, right_id, score, rank).

    ``score`` gets the block mask and may use the columns of both sides, whose names
    must differ. Ties go to the lesser right id.
    """
    pairs = blocked_candidates(left, right, left_id, right_id, blocks)
    full = pairs.join(left, left_id).join(right, right_id).withColumn("score", score(F.col("by"))).where(F.col("score") >= least)
    return top_per_group(full.select(left_id, right_id, "score"), [left_id], k, F.col("score").desc(), F.col(right_id))


def page_window_match(quotes: DataFrame, pages: DataFrame, source: str, page: str, slack: int, score: Callable[[], Column], every: bool = False) -> DataFrame:
    """The best page within ``slack`` pages of the cited one, the nearest page first at ties.

    ``quotes`` has id, source, page and the quote; ``pages`` source, pdf_page and text.
    The range is turned into an equi-join on each page of the window. Quotes without a
    page in the window are left out; with ``every`` all come out, by the cited page with
    score 0 where nothing is found.
    """
    q = quotes.withColumn("pdf_page", F.explode(F.sequence(F.col(page) - slack, F.col(page) + slack)))
    j = q.join(pages, [source, "pdf_page"]).withColumn("score", score())
    best = F.max_by(F.col("pdf_page"), F.struct("score", -F.abs(F.col("pdf_page") - F.col(page)), -F.col("pdf_page")))
    found = j.groupBy("id").agg(best.alias("pdf_page"), F.max("score").alias("score"))
    if not every:
        return found
    cited = quotes.groupBy("id").agg(F.min(page).alias("_p"))
    at = F.when(F.col("score") > 0, F.col("pdf_page")).otherwise(F.col("_p"))
    return cited.join(found, "id", "left").select("id", at.alias("pdf_page"), F.coalesce("score", F.lit(0.0)).alias("score"))


def printed_to_pdf(rows: DataFrame, source: str, printed: str, pdf_page: str, least: int = 4) -> DataFrame:
    """``rows`` with ``cited``: its pdf_page, else the printed page moved by the source's most common offset.

    An offset (pdf page less printed page, the lesser at ties) needs ``least`` rows and
    one for every 200 pages of the source. Without one, or where it leads outside the
    source's pages, the printed page is taken within them.
    """
    known = rows.where(F.col(pdf_page).isNotNull())
    votes = known.where(F.col(printed).isNotNull()).groupBy(source, (F.col(pdf_page) - F.col(printed)).alias("_o")).agg(F.count(F.lit(1)).alias("_n"))
    mode = votes.groupBy(source).agg(F.max(F.struct("_n", (-F.col("_o")).alias("_m"))).alias("_v"))
    last = known.groupBy(source).agg(F.max(pdf_page).alias("_last"))
    t = rows.join(last.join(mode, source, "left"), source, "left")
    moved = F.when(F.col("_v._n") >= F.greatest(F.lit(least), F.floor(F.col("_last") / 200)), F.col(printed) - F.col("_v._m"))
    within = F.least(F.greatest(F.col(printed), F.lit(1)), F.col("_last"))
    cited = F.when(F.col(pdf_page).isNotNull(), F.col(pdf_page)).when(F.col(printed).isNotNull(), F.when(moved.between(1, F.col("_last")), moved).otherwise(within))
    return t.withColumn("cited", cited.cast("int")).drop("_v", "_last")


def quotes_in_texts(quotes: DataFrame, quote_id: str, quote: str, texts: DataFrame, text_id: str, text: str, k: int = 4) -> DataFrame:
    """Quotations scored on every text that shares a run of ``k`` folded words with them: (quote_id, text_id, score).

    All runs of a quotation count, from its beginning to its end; one of fewer words
    is sought as a whole. Nothing below the shared run is left out: the score comes
    from windows over the whole text. Ids must be unique; texts are sent once for
    each text, not for each pair.
    """
    q = quotes.select(F.col(quote_id).alias("_q"), F.col(quote).alias("_x")).where(F.length("_x") > 0)
    t = texts.select(F.col(text_id).alias("_t"), F.col(text).alias("_y")).where(F.length("_y") > 0)

    @F.pandas_udf("int")
    def words(s: pd.Series) -> pd.Series:
        return s.map(lambda v: len(quote_words(v)))

    lengths = sorted(r[0] for r in q.select(F.least(words("_x"), F.lit(k)).alias("k")).where("k > 0").distinct().collect())  # k at most
    runs = q.select("_q", F.explode(run_hashes(F.col("_x"), lengths, longest=True)).alias("_h"))
    hits = t.select("_t", F.explode(run_hashes(F.col("_y"), lengths)).alias("_h")).join(broadcast_if_small(runs, runs.count(), 40), "_h")
    pairs = hits.groupBy("_t").agg(F.collect_set("_q").alias("_qs"))
    full = t.join(pairs, "_t").select("_t", "_y", F.explode("_qs").alias("_q")).join(broadcast_if_small(q), "_q")
    return full.select(F.col("_q").alias(quote_id), F.col("_t").alias(text_id), quote_score(F.col("_x"), F.col("_y")).alias("score"))
