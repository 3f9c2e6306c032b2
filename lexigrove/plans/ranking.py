"""The whole ranking: stage 1, candidates, rerank, constraint adjustment, top k."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import store
from ..functions.text import lemma_rows
from ..operators import fusion, retrieval
from ..operators.constraints import interval_rows, lemmatised, quantity_rows, signal
from ..operators.products import Leg
from ..operators.scorers import Device, Scorer


@dataclass(frozen=True)
class Config:
    """Knobs of a run. ``weights`` names the legs of stage 1: char, word, bm25. Models are named as the lock file has them."""

    name: str = "lexical"
    weights: dict[str, float] = field(default_factory=lambda: {"char": 3.0, "word": 1.0})
    n_candidates: int = 16
    ce_weight: float = 1.0
    dense_weight: float = 0.5
    constraint_weight: float = 0.0
    ce_field: str = "fine_text"
    top_k: int = 10
    cross_encoder: str | None = None
    bi_encoder: str | None = None
    batch_ce: int = 16
    batch_bi: int = 32
    max_len_ce: int = 256
    max_len_bi: int = 192
    device: Device = Device()


LEXICAL = Config()
CPU = Config("cpu", n_candidates=12, ce_weight=1.0, constraint_weight=0.02, cross_encoder="BAAI/bge-reranker-v2-m3", batch_ce=24, max_len_ce=192, device=Device(int8=True))
GPU = Config("gpu", n_candidates=32, ce_weight=2.0, constraint_weight=0.05, cross_encoder="Qwen/Qwen3-Reranker-4B", batch_ce=8, max_len_ce=512, device=Device(gpu=True, half=True))


def legs(queries: DataFrame, docs: DataFrame, names: list[str], text: str = "coarse_text", lemmas: DataFrame | None = None, apart: bool = False) -> dict[str, Leg]:
    """Legs by name; ``queries``: (query_id, text), ``docs``: (doc_id, coarse_text); ``lemmas``: (token, lemma) for the legs of words.

    ``apart``: ``docs`` is a written table of many parts in which no two rows have the same id, so that its texts need no shuffle.
    """
    size = retrieval.corpus_size(docs)
    of_texts = {name: ("char" if name == "char" else "word", name == "bm25") for name in names if name == "char" or lemmas is None}
    found = retrieval.text_legs(queries, docs, text, size, of_texts, apart) if of_texts else {}
    for name in names:
        if name in found:
            continue
        d, q = (retrieval.counted(lemma_rows(side, key, column, lemmas), key) for side, key, column in ((docs, "doc_id", text), (queries, "query_id", "text")))
        found[name] = (retrieval.bm25_leg if name == "bm25" else retrieval.tfidf_leg)(q, d, size)
    return found


def stage1(queries: DataFrame, docs: DataFrame, config: Config = LEXICAL, dense: DataFrame | None = None, lemmas: DataFrame | None = None, apart: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``n_candidates`` best of each query by weighted reciprocal rank fusion of the legs.

    Every pair has a rank in every leg, the pairs without a common term included. With ``dense``, which has every pair of a
    bounded catalogue, all pairs are rows. ``apart``: as for ``legs``.
    """
    made = legs(queries, docs, [n for n, w in config.weights.items() if w], lemmas=lemmas, apart=apart)
    if dense is None:
        return fusion.best_fused(made, config.weights, queries, docs.select("doc_id"), config.n_candidates, depth=fusion.FAR)
    # No task and no window holds a query's documents, and what a task holds does not grow with the pairs.
    size = queries.count() * docs.count()
    parts = store.wide_parts(queries.sparkSession, size)
    deal = lambda pairs: pairs.repartition(parts, "query_id", "doc_id")
    place = lambda pairs, digits=9: retrieval.ranked_wide(pairs, size, digits=digits)
    every = docs.select("doc_id").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id").crossJoin(queries.select("query_id"))
    scored = {name: retrieval.complete(retrieval.pair_scores(leg), every, deal) for name, leg in made.items()}
    placed = [(place(s), config.weights[name]) for name, s in scored.items()]
    # The order by 1 / (k + rank) of a single leg is that leg's.
    first = placed[0][0] if len(placed) == 1 and placed[0][1] > 0 else place(fusion.rrf(placed, deal=deal), 15)
    fused = fusion.rrf([(first, 1.0), (place(dense), config.dense_weight)], deal=deal)
    return retrieval.ranked(fused, digits=15)


def rank(queries: DataFrame, docs: DataFrame, config: Config = LEXICAL, scorer: Scorer | None = None, dense: DataFrame | None = None, lemmas: DataFrame | None = None, apart: bool = False) -> DataFrame:
    """(query_id, rank, doc_id, score): the final ranking.

    ``queries``: (query_id, text); ``docs``: (doc_id, coarse_text, fine_text, disc_text). The scorer
    sees only the candidates, which are written, as its scores are, so that it runs once for each pair.
    ``lemmas``: (token, lemma), for the legs of words and the subjects of quantities. ``apart``: as for ``legs``.
    """
    spark = queries.sparkSession
    with store.scratch(spark):
        found = stage1(queries, docs, config, dense, lemmas, apart).where(F.col("rank") <= config.n_candidates)
        candidates = store.materialise(found.select("query_id", "doc_id", (F.col("rank") - 1).alias("cand_pos")), "candidates")
        scored = None
        if scorer is not None:
            pairs = candidates.join(queries.select("query_id", F.col("text").alias("query_text")), "query_id").join(docs.select("doc_id", F.col(config.ce_field).alias("doc_text")), "doc_id")
            scored = store.materialise(scorer.score(pairs), "candidate-scores")
        final = fusion.rerank(candidates, scored, config.ce_weight)
        if config.constraint_weight:
            near = docs.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
            intervals, quantities = interval_rows(near, "doc_id", "disc_text"), quantity_rows(queries, "query_id", "text")
            adjusted = signal(final, lemmatised(intervals, "doc_id", lemmas), lemmatised(quantities, "query_id", lemmas))
            final = adjusted.withColumn("score", F.col("score") + config.constraint_weight * F.col("signal"))
        best = fusion.top_stable(final, config.top_k)
        return store.kept(fusion.clamp(best).select("query_id", "rank", "doc_id", "score"), "ranking")
