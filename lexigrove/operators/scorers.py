"""Scorers of candidate pairs behind one interface.

A scorer takes (query_id, doc_id, query_text, doc_text) and returns (query_id, doc_id, score). Model-backed
ones load their model once a Python worker and run over Arrow batches; they need packages that are
imported only in the tasks that use them.
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PROMPT_BEGIN, PROMPT_BODY, PROMPT_END, TASK, tokenise
from .artifacts import Shipped, local, profile_for
from .retrieval import corpus_size, pair_scores, postings, tfidf_leg

# What runs in tasks travels with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Scorer(Protocol):
    def score(self, pairs: DataFrame) -> DataFrame: ...


class TableScorer:
    """Scores that were computed elsewhere, as a table (query_id, doc_id, score)."""

    def __init__(self, scores: DataFrame):
        self.scores = scores

    def score(self, pairs: DataFrame) -> DataFrame:
        return pairs.select("query_id", "doc_id").join(self.scores, ["query_id", "doc_id"]).select("query_id", "doc_id", "score")


class LexicalScorer:
    """Cosine of word TF-IDF vectors of the pair's texts, with the candidate documents as corpus."""

    def score(self, pairs: DataFrame) -> DataFrame:
        docs = pairs.select(F.col("doc_id").alias("id"), F.col("doc_text").alias("text")).dropDuplicates(["id"])
        queries = pairs.select(F.col("query_id").alias("id"), F.col("query_text").alias("text")).dropDuplicates(["id"])
        d, q = (postings(x, "id", tokenise(F.col("text"))) for x in (docs, queries))
        found = pair_scores(tfidf_leg(q, d, corpus_size(docs)))
        return pairs.select("query_id", "doc_id").join(found, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


class ModelScorer:
    """A model behind ``load(folder)``, which returns a function from two lists of texts to scores.

    The model lives as long as the task that loaded it: what the function's ``close`` releases, if it has
    one, is released at the task's end, so that two models are never held at once.
    """

    def __init__(self, load: Callable[[str], Callable[[list[str], list[str]], list[float]]], folder: str | Shipped, batch: int = 24, gpu: bool = False):
        self.load, self.folder, self.batch, self.gpu = load, folder, batch, gpu

    def score(self, pairs: DataFrame) -> DataFrame:
        load, folder, batch = self.load, self.folder, self.batch

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load(local(folder))
            try:
                for frame in frames:
                    scores: list[float] = []
                    for i in range(0, len(frame), batch):
                        some = frame.iloc[i : i + batch]
                        scores += [float(s) for s in model(some["query_text"].tolist(), some["doc_text"].tolist())]
                    yield frame[["query_id", "doc_id"]].assign(score=scores)
            finally:
                getattr(model, "close", lambda: None)()

        kinds = dict(pairs.dtypes)
        scored = pairs.select("query_id", "doc_id", "query_text", "doc_text").mapInPandas(
            run, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double", profile=profile_for(pairs, self.gpu)
        )
        return scored.withColumn("score", finite(F.col("score"), "a score is not finite"))


def finite(x: Column, said: str) -> Column:
    """The number, or an error that says so if it is none."""
    good = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(good, x).otherwise(F.raise_error(F.lit(said)).cast("double"))


def gpu_visible() -> bool:
    """Whether this process has a CUDA device; without torch there is none."""
    try:
        import torch
    except ImportError:
        return False
    return torch.cuda.is_available()


@dataclass(frozen=True)
class Device:
    """Where and how exactly a model runs: ``half`` counts on a GPU only, ``int8`` and ``threads`` on a CPU only."""

    gpu: bool = False
    half: bool = False
    int8: bool = False
    threads: int | None = None

    def place(self, load):
        """(model, device name) from ``load(dtype)``."""
        import torch

        name = "cuda" if self.gpu and torch.cuda.is_available() else "cpu"
        if name == "cpu" and self.threads:
            torch.set_num_threads(self.threads)
        model = load(torch.float16 if self.half and name == "cuda" else torch.float32).to(name).eval()
        if self.int8 and name == "cpu":
            # Weights of linear layers only; it needs no calibration.
            model = torch.quantization.quantize_dynamic(model, {torch.nn.Linear}, dtype=torch.qint8)
        return model, name


class _Held:
    """A callable over a loaded model that can let go of it."""

    def __init__(self, call: Callable, held: dict):
        self._call, self._held = call, held

    def __call__(self, *given):
        return self._call(*given)

    def close(self) -> None:
        import gc

        import torch

        self._held.clear()
        gc.collect()
        if torch.cuda.is_available():
            torch.cuda.empty_cache()


def cross_encoder(folder: str, max_length: int = 192, device: Device = Device()) -> Callable[[list[str], list[str]], list[float]]:
    """First logit of a sequence classification model for each pair."""
    import torch
    from transformers import AutoModelForSequenceClassification, AutoTokenizer

    tokenizer = AutoTokenizer.from_pretrained(folder)
    model, name = device.place(lambda dtype: AutoModelForSequenceClassification.from_pretrained(folder, dtype=dtype))
    held = {"model": model}
    del model

    def score(queries: list[str], docs: list[str]) -> list[float]:
        with torch.inference_mode():
            given = tokenizer(queries, docs, padding=True, truncation=True, max_length=max_length, return_tensors="pt").to(name)
            return held["model"](**given).logits[:, 0].float().tolist()

    return _Held(score, held)


def question_ids(tokenizer, task: str, query: str, doc: str, max_length: int) -> list[int]:
    """Ids of a causal reranker's whole prompt: only the question's own text is cut to what the template leaves of ``max_length``."""
    ids = lambda text: list(tokenizer.encode(text, add_special_tokens=False))
    begin, end = ids(PROMPT_BEGIN), ids(PROMPT_END)
    return begin + ids(PROMPT_BODY % (task, query, doc))[: max_length - len(begin) - len(end)] + end


def yes_no_reranker(folder: str, task: str = TASK, max_length: int = 512, device: Device = Device(gpu=True, half=True)) -> Callable[[list[str], list[str]], list[float]]:
    """Probability of "yes" against "no" as a causal model's next token after the chat template of each pair."""
    import torch
    from transformers import AutoModelForCausalLM, AutoTokenizer

    if not torch.cuda.is_available():
        raise RuntimeError("this scorer needs a GPU")
    tokenizer = AutoTokenizer.from_pretrained(folder, padding_side="left")
    model, name = device.place(lambda dtype: AutoModelForCausalLM.from_pretrained(folder, dtype=dtype))
    held = {"model": model}
    del model
    words = [tokenizer.convert_tokens_to_ids(w) for w in ("no", "yes")]

    def score(queries: list[str], docs: list[str]) -> list[float]:
        whole = [question_ids(tokenizer, task, q, d, max_length) for q, d in zip(queries, docs, strict=True)]
        with torch.inference_mode():
            # The mask is made by the padding, from the ids as they are with the template.
            given = tokenizer.pad({"input_ids": whole}, padding=True, return_tensors="pt").to(name)
            last = held["model"](**given).logits[:, -1, words].float()
        return torch.softmax(last, dim=-1)[:, 1].tolist()

    return _Held(score, held)


def is_causal(name: str) -> bool:
    return "qwen3-reranker" in name.lower()


def scorer_for(name: str, folder: str | Shipped, batch: int = 16, max_length: int = 256, device: Device = Device()) -> ModelScorer:
    """Causal rerankers by their name, sequence classifiers otherwise."""
    make = yes_no_reranker if is_causal(name) else cross_encoder
    return ModelScorer(lambda where: make(where, max_length=max_length, device=device), folder, batch, device.gpu)


def encoder(folder: str, name: str = "", query: bool = False, max_length: int = 192, device: Device = Device()) -> Callable[[list[str]], list[list[float]]]:
    """Unit vectors by the mean over the tokens that the attention mask leaves; E5 models get their prefix."""
    import torch
    from transformers import AutoModel, AutoTokenizer

    tokenizer = AutoTokenizer.from_pretrained(folder)
    model, where = device.place(lambda dtype: AutoModel.from_pretrained(folder, dtype=dtype))
    held = {"model": model}
    del model
    tag = ("query: " if query else "passage: ") if "e5" in name.lower() else ""

    def encode(texts: list[str]) -> list[list[float]]:
        with torch.inference_mode():
            given = tokenizer([tag + t for t in texts], padding=True, truncation=True, max_length=max_length, return_tensors="pt").to(where)
            hidden, mask = held["model"](**given).last_hidden_state, given["attention_mask"].unsqueeze(-1)
            mean = (hidden * mask).sum(1) / mask.sum(1).clamp(min=1)
            return torch.nn.functional.normalize(mean, dim=-1).float().tolist()

    return _Held(encode, held)


def mean_pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit vectors from token vectors (texts x tokens x width): the mean over the tokens that the mask leaves."""
    kept = mask[:, :, None].astype(np.float64)
    mean = (hidden * kept).sum(1) / np.maximum(kept.sum(1), 1e-9)
    norm = np.linalg.norm(mean, axis=1, keepdims=True)
    return mean / np.where(norm > 0, norm, 1.0)


def embed(texts: DataFrame, load: Callable[[str], Callable[[list[str]], list[list[float]]]], folder: str | Shipped, batch: int = 32, gpu: bool = False) -> DataFrame:
    """(id, vector) of (id, text) by a model that ``load(folder)`` returns; a component that is not finite is an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(local(folder))
        try:
            for frame in frames:
                texts = frame["text"].tolist()
                vectors = [v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])]
                if not all(np.isfinite(v).all() for v in vectors):
                    raise FloatingPointError("a vector is not finite")
                yield pd.DataFrame({"id": frame["id"], "vector": vectors})
        finally:
            getattr(model, "close", lambda: None)()

    return texts.select("id", "text").mapInPandas(run, f"id {dict(texts.dtypes)['id']}, vector array<float>", profile=profile_for(texts, gpu))


def model_folder(name: str, lock_file: str, models: str) -> str:
    """The folder of a model's locked snapshot; a missing lock file, name or folder is an error of its own."""
    if not os.path.exists(lock_file):
        raise FileNotFoundError(f"no lock file {lock_file}")
    with open(lock_file, encoding="utf-8") as f:
        locked = json.load(f)
    if name not in locked:
        raise KeyError(f"{name} is not locked in {lock_file}")
    folder = os.path.join(models, name.replace("/", "--"), locked[name])
    if not os.path.isdir(folder):
        raise FileNotFoundError(f"no snapshot {folder}")
    return folder


def write_lock(locked: dict[str, str], lock_file: str) -> None:
    with open(lock_file, "w", encoding="utf-8") as f:
        json.dump(locked, f, indent=2, sort_keys=True)
