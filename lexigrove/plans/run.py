"""A run from input files to a checked CSV."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..operators import evaluate, tree, views
from ..operators import lemmas as endings
from ..operators.retrieval import dense_scores
from ..operators.artifacts import ship
from ..operators.scorers import Scorer, embed, encoder, model_folder, scorer_for
from ..sources import files
from .ranking import CPU, GPU, LEXICAL, Config, rank

#: Names of the inputs in a data folder, and of the output.
REGULATIONS, DECLARATIONS, DUMP, PREDICTIONS = "regulations.jsonl", "declarations.jsonl", "tnved_knowledge.txt", "predictions.csv"
#: Violations that are shown, and seconds that a run should take at most.
SHOWN, BUDGET = 20, 1800


def choose(pipeline: str = "auto", gpu: bool = False, n_candidates: int | None = None) -> Config:
    """The configuration of a name; ``auto`` takes gpu where there is one, else cpu. ``gpu`` without one is an error."""
    if pipeline == "gpu" and not gpu:
        raise ValueError("no GPU is visible")
    config = {"lexical": LEXICAL, "cpu": CPU, "gpu": GPU, "auto": GPU if gpu else CPU}[pipeline]
    return replace(config, n_candidates=n_candidates) if n_candidates else config


def scorer_of(config: Config, lock_file: str, models: str) -> Scorer | None:
    """The reranker that a configuration names, from its locked snapshot, which is sent to the workers; None if it names none."""
    if config.cross_encoder is None:
        return None
    folder, spark = model_folder(config.cross_encoder, lock_file, models), SparkSession.getActiveSession()
    return scorer_for(config.cross_encoder, ship(spark, folder) if spark else folder, config.batch_ce, config.max_len_ce, config.device)


def dense_of(config: Config, queries: DataFrame, docs: DataFrame, lock_file: str, models: str) -> DataFrame | None:
    """Cosines of every pair by the configuration's bi-encoder; None if it names none."""
    if config.bi_encoder is None:
        return None
    name, length, device = config.bi_encoder, config.max_len_bi, config.device
    folder = ship(queries.sparkSession, model_folder(name, lock_file, models))
    make = lambda query: lambda where: encoder(where, name, query, length, device)
    vectors = lambda side, key, text, query: store.materialise(embed(side.select(F.col(key).alias("id"), F.col(text).alias("text")), make(query), folder, config.batch_bi, device.gpu), "vectors")
    return dense_scores(vectors(queries, "query_id", "text", True), vectors(docs, "doc_id", "coarse_text", False))


def prepare(spark: SparkSession, regulations: str, dump: str) -> DataFrame:
    """The catalogue with its text views as (doc_id, coarse_text, fine_text, disc_text), written."""
    with store.scratch(spark):
        # Each step is used several times by the next, so it is written once before that is planned.
        parsed = store.materialise(tree.parsed(tree.sections(files.dump(spark, dump))), "nodes")
        nodes = store.materialise(tree.linked(parsed), "nodes")
        codes = store.materialise(tree.by_code(store.materialise(tree.with_labels(nodes), "nodes")), "codes")
        seen = Observation()
        rows = views.catalogue(files.regulations(spark, regulations), codes).observe(seen, *views.statistics(median=False))
        made = store.kept(rows.select(F.col("regulation_id").alias("doc_id"), *views.VIEWS), "catalogue")
        print("[catalogue] " + "  ".join(f"{k}={v}" for k, v in seen.get.items()))
        return made


@contextmanager
def _timed(timings: dict[str, float], name: str) -> Iterator[None]:
    began = time.time()
    yield
    timings[name] = time.time() - began


def run(
    spark: SparkSession, regulations: str, declarations: str, dump: str, out: str, config: Config = LEXICAL, scorer: Scorer | None = None,
    lemmas: str | None = None, lock_file: str = "model_lock.json", models: str = "models",
) -> list[tuple[str, str, str]]:
    """Write the ranking to ``out`` and return what the gate has against it (nothing, if it is valid), the first ``SHOWN`` in order.

    ``scorer``: in place of the configuration's own. ``lemmas``: a CSV (token, lemma).
    """
    files.require(spark, regulations, declarations, dump, *([lemmas] if lemmas else []))
    if scorer is None:
        scorer = scorer_of(config, lock_file, models)
    timings: dict[str, float] = {}
    with store.scratch(spark):
        with _timed(timings, "catalogue"):
            docs = prepare(spark, regulations, dump)
            given = store.materialise(files.declarations(spark, declarations), "declarations")
        queries = given.select(F.col("declaration_id").alias("query_id"), "text")
        with _timed(timings, "dense"):
            dense = dense_of(config, queries, docs, lock_file, models)
        with _timed(timings, "ranking"):
            known = None
            if lemmas:  # forms that the dictionary lacks follow its endings
                texts = [(docs, "coarse_text"), (docs, "disc_text"), (queries, "text")]
                known = endings.extended(files.lemmas(spark, lemmas), endings.tokens_of(texts))
            found = rank(queries, docs, config, scorer, dense, known)
            found = found.select(F.col("query_id").alias("declaration_id"), "rank", F.col("doc_id").alias("regulation_id"), "score")
            files.write_predictions(found.join(given.select("declaration_id", "input_ord"), "declaration_id"), out)
        with _timed(timings, "gate"):
            written = files.predictions(spark, out)
            wrong = evaluate.violations(written, given.select("declaration_id"), docs.select(F.col("doc_id").alias("regulation_id")), config.top_k)
            wrong = store.materialise(wrong, "violations")
            shown, n = wrong.orderBy("rule", "declaration_id", "detail").limit(SHOWN).collect(), wrong.count()
        rows = written.count()
    total = sum(timings.values())
    print(f"[{config.name}] " + "  ".join(f"{k}={v:.1f}s" for k, v in timings.items()) + f"  total={total:.1f}s  {rows} rows, {n} violations" + ("  over the budget" if total > BUDGET else ""))
    return [tuple(r) for r in shown]
