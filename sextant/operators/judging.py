"""Models as judges: relevance of passages, faithfulness and correctness of answers, entailment of sentences."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.operators.retrieval import top
from sextant.operators.steps import json_in
from sextant.plans.storage import cut

Model = Callable[[str], str]


def judged(model: Model, instruction: str, **parts: str) -> tuple[float | None, str | None]:
    """(score from 0 to 10, reasoning) of what a model says about the parts; (None, None) if it fails or can't be read."""
    prompt = "\n\n".join([instruction, 'Say {"score": 0 to 10, "reasoning": ...}.', *(f"{k}: {v}" for k, v in parts.items())])
    try:
        said = json_in(model(prompt))
    except Exception:  # noqa: BLE001  no judgement
        return None, None
    score = said.get("score") if isinstance(said, dict) else None
    if isinstance(score, bool) or not isinstance(score, (int, float)):
        return None, None
    return float(min(10, max(0, score))), said.get("reasoning")


def judge_answers(answers: DataFrame, model: Model) -> DataFrame:
    """Answers (case_id, question, passages, answer, reference) with faithfulness, and correctness where there is a reference;
    null where the judge gave nothing."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for case, question, passages, answer, reference in frame[["case_id", "question", "passages", "answer", "reference"]].itertuples(index=False):
                faithful, _ = judged(model, "How far does the answer rest on the passages alone?", question=question, passages="\n".join(passages), answer=answer)
                correct = judged(model, "How far does the answer agree with the reference?", question=question, reference=reference, answer=answer)[0] if reference else None
                rows.append((case, faithful, correct))
            yield pd.DataFrame(rows, columns=["case_id", "faithfulness", "correctness"])

    kind = dict(answers.dtypes)["case_id"]
    return answers.mapInPandas(run, f"case_id {kind}, faithfulness double, correctness double")


def rated(question: str, rows: Sequence[dict[str, Any]], model: Model, threshold: float = 7.0) -> list[dict[str, Any]]:
    """Passages (text, ...) that a model rates at the threshold or above, best first, with rerank_score.

    A passage that it leaves out counts 0. If it can't be asked, or its answer isn't an object, all passages stay as they are.
    """
    if not rows:
        return []
    listing = "\n".join(f"[{i}] {r['text']}" for i, r in enumerate(rows, 1))
    try:
        said = json_in(model(f"Rate each passage from 0 to 10 for the question. Say an object from number to rating.\nQuestion: {question}\n{listing}"))
    except Exception:  # noqa: BLE001
        said = None
    if not isinstance(said, dict):
        return list(rows)
    scores = [said.get(str(i), 0) for i in range(1, len(rows) + 1)]
    good = [(s, r) for s, r in zip(scores, rows, strict=True) if isinstance(s, (int, float)) and not isinstance(s, bool) and s >= threshold]
    return [{**r, "rerank_score": float(s)} for s, r in sorted(good, key=lambda x: -x[0])]


def reranked_or_first(fetched: DataFrame, reranker: Callable[[DataFrame], DataFrame] | None, limit: int, on_failure: Callable[[Exception], None] = lambda e: None) -> DataFrame:
    """The reranker's order of what was fetched, cut to limit; without one, or if it fails, the first by score."""
    if reranker is None:
        return top(fetched, limit)
    try:
        return cut(reranker(fetched).limit(limit))  # what fails, fails here
    except Exception as e:  # noqa: BLE001
        on_failure(e)
        return top(fetched, limit)


def entailed(pairs: DataFrame, model: Callable[[list[tuple[str, str]]], list[float]], batch: int = 8) -> DataFrame:
    """Pairs (id, premise, hypothesis) with score, the model's probability that the premise carries the hypothesis; the model
    gets `batch` pairs at a time, which bounds its memory."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores: list[float] = []
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                scores += list(model(list(zip(part["premise"], part["hypothesis"], strict=True))))
            yield pd.DataFrame({"id": frame["id"], "score": scores})

    return pairs.select("id", "premise", "hypothesis").mapInPandas(run, f"id {dict(pairs.dtypes)['id']}, score double")


def grounded(sentences: DataFrame, chunks: DataFrame, model: Callable[[list[tuple[str, str]]], list[float]], threshold: float = 0.5, batch: int = 8) -> DataFrame:
    """sentence_id, score, verdict: each sentence (sentence_id, answer_id, text) against the premise of its answer's chunks
    (answer_id, position, text)."""
    from sextant.operators.grounding import premise, split_spans

    pairs = sentences.join(premise(chunks, ["answer_id"]), "answer_id").select(F.col("sentence_id").alias("id"), "premise", F.col("text").alias("hypothesis"))
    return split_spans(entailed(pairs, model, batch).withColumnRenamed("id", "sentence_id"), threshold)
