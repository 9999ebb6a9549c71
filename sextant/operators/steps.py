"""Questions to answers in steps: a one-shot ask, a pipeline over an immutable context, and a loop of tool calls.

Control flow runs on the driver; retrieval is DataFrame plans. Language models are callables from prompt to text; what
they say is parsed leniently, and a failure falls back as each step states.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.operators.retrieval import accumulate, first_of, top_per

Search = Callable[[str, str | None], DataFrame]  # question, collection -> id, text, score, best first
Model = Callable[[str], str]


def json_in(text: str) -> Any:
    """The first JSON object or array in a model's answer, code fences and talk aside; None if there is none."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[{\[]", text or ""):
        try:
            return decoder.raw_decode(text[m.start() :])[0]
        except ValueError:
            continue
    return None


@dataclass(frozen=True)
class Context:
    question: str
    collections: tuple[str, ...] = ()
    limit: int = 5
    threshold: float = 0.5
    rewritten: str | None = None
    expanded: str | None = None
    parts: tuple[str, ...] = ()
    retrieve: bool = True
    results: tuple[tuple[str, str | None, DataFrame], ...] = ()
    chunks: DataFrame | None = None
    answer: str | None = None
    grounding: DataFrame | None = None
    corrections: int = 0
    error: str | None = None

    @property
    def effective(self) -> str:
        return self.rewritten or self.question


def step(f: Callable[..., Context]) -> Callable[..., Context]:
    """A step that leaves a context with an error as it is, and turns its own failure into one."""

    def run(ctx: Context, *args: Any, **options: Any) -> Context:
        if ctx.error:
            return ctx
        try:
            return f(ctx, *args, **options)
        except Exception as e:  # noqa: BLE001  the context carries it to the end
            return replace(ctx, error=f"{f.__name__}: {e}")

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


@step
def gate(ctx: Context, model: Model) -> Context:
    """Whether the question needs retrieval at all; an answer that can't be read means yes."""
    said = json_in(model(f"Does answering need a search? Say {{\"needs_retrieval\": true or false}}.\n{ctx.question}"))
    return replace(ctx, retrieve=said.get("needs_retrieval", True) is not False if isinstance(said, dict) else True)


@step
def rewrite(ctx: Context, model: Model) -> Context:
    return replace(ctx, rewritten=model(f"Say this as a search query.\n{ctx.question}").strip() or None)


@step
def select(ctx: Context, model: Model, available: Sequence[str]) -> Context:
    """Collections to search, of those available; all of them if the choice can't be read."""
    try:
        said = json_in(model(f"Which of {json.dumps(list(available))} hold the answer? Say a list.\n{ctx.effective}"))
    except Exception:  # noqa: BLE001
        said = None
    chosen = tuple(c for c in said if c in available) if isinstance(said, list) else ()
    return replace(ctx, collections=chosen or tuple(available))


@step
def expand(ctx: Context, model: Model) -> Context:
    return replace(ctx, expanded=model(f"Add synonyms to this query.\n{ctx.effective}").strip() or None)


@step
def decompose(ctx: Context, model: Model) -> Context:
    said = json_in(model(f"Split into simpler questions. Say {{\"sub_questions\": [...]}}.\n{ctx.effective}"))
    if isinstance(said, dict):
        said = next((said[k] for k in ("sub_questions", "subquestions", "questions") if isinstance(said.get(k), list)), None)
    return replace(ctx, parts=tuple(q for q in said or () if isinstance(q, str) and q.strip()))


@step
def retrieve(ctx: Context, search: Search) -> Context:
    """Every question (the parts, else the expanded query, else the question itself) in every collection."""
    if not ctx.retrieve:
        return replace(ctx, results=(), chunks=None)
    questions = ctx.parts or (ctx.expanded or ctx.question,)
    results = tuple((q, c, search(q, c)) for q in questions for c in ctx.collections or (None,))
    return replace(ctx, results=results, chunks=merged_results([r for *_, r in results]))


def merged_results(results: Sequence[DataFrame]) -> DataFrame | None:
    """All results' chunks, each id once, where it came first."""
    out = None
    for i, r in enumerate(results):
        named = r.withColumn("result", F.lit(i))
        out = named if out is None else out.unionByName(named)
    return None if out is None else first_of(out, ["id"], ["result", F.desc("score")])


@step
def reason(ctx: Context, model: Model, search: Search, rounds: int = 2) -> Context:
    """Search again while the model asks for more, at most `rounds` times and never for the same query twice."""
    asked = {q for q, *_ in ctx.results}
    for _ in range(rounds):
        said = json_in(model(f"Is this enough? Say {{\"sufficient\": true}} or {{\"query\": ...}}.\n{ctx.question}"))
        query = said.get("query") if isinstance(said, dict) and said.get("sufficient") is not True else None
        if not query or query in asked:
            break
        asked.add(query)
        more = tuple((query, c, search(query, c)) for c in ctx.collections or (None,))
        ctx = replace(ctx, results=ctx.results + more)
    return replace(ctx, chunks=merged_results([r for *_, r in ctx.results]))


@step
def rerank(ctx: Context, reranker: Callable[[str, DataFrame], DataFrame]) -> Context:
    return ctx if ctx.chunks is None else replace(ctx, chunks=reranker(ctx.effective, ctx.chunks))


def prompt_for(question: str, chunks: DataFrame | None, limit: int, extra: str = "") -> str:
    rows = [] if chunks is None else chunks.orderBy(F.desc("score"), "id").limit(limit).select("text").collect()
    return "\n\n".join(["Answer from the passages.", *(r["text"] for r in rows), *([extra] if extra else []), f"Question: {question}"])


@step
def answer(ctx: Context, model: Model, corrections: int = 0) -> Context:
    """An answer; up to `corrections` times the model may find it wanting and answer again."""
    prompt = prompt_for(ctx.question, ctx.chunks, ctx.limit)
    text, n = model(prompt), 0
    while n < corrections:
        said = json_in(model(f"Is the answer grounded? Say {{\"grounded\": true}} or {{\"feedback\": ...}}.\n{text}"))
        if not isinstance(said, dict) or said.get("grounded", "feedback" not in said):
            break
        text, n = model(f"{prompt}\n\nMend this: {said.get('feedback', '')}"), n + 1
    return replace(ctx, answer=text, corrections=n)


@step
def ground(ctx: Context, grounder: Callable[[str, DataFrame], DataFrame]) -> Context:
    return ctx if ctx.chunks is None or not ctx.answer else replace(ctx, grounding=grounder(ctx.answer, ctx.chunks))


def ask(question: str, search: Search, model: Model, *, limit: int = 5, graph_context: str = "") -> str:
    """Search once, put what was found into a prompt, ask."""
    return model(prompt_for(question, search(question, None), limit, graph_context))


@dataclass
class LoopState:
    question: str
    collections: tuple[str, ...] = ()
    chunks: DataFrame | None = None
    history: list[dict[str, Any]] = field(default_factory=list)
    iterations: int = 0
    answer: str | None = None
    terminated_by: str | None = None
    error: str | None = None


def run_loop(question: str, controller: Callable[[LoopState], dict[str, Any]], search: Search, *, collections: Sequence[str] = (), tools: dict[str, Callable] | None = None, max_iterations: int = 10, chunk_cap: int = 30, fallback: Callable[[LoopState], str] | None = None) -> LoopState:
    """The controller names a tool a turn: search, answer, give_up or one of tools. A search outside the collections is
    refused. Found chunks gather, each id once, best first, at most chunk_cap. At the end of its turns, fallback answers."""
    state = LoopState(question, tuple(collections))
    found = None
    while state.iterations < max_iterations and not state.terminated_by:
        state.iterations += 1
        try:
            call = controller(state)
            name, args = call.get("tool"), call.get("args", {})
            state.history.append({"iteration": state.iterations, "tool": name, **args})
            if name == "search":
                collection = args.get("collection")
                if state.collections and collection not in (None, *state.collections):
                    state.history[-1]["refused"] = True
                    continue
                hits = search(args.get("query", question), collection).select("id", "text", "score")
                hits = hits.withColumn("iteration", F.lit(state.iterations)).withColumn("position", -F.col("score"))
                found = hits if found is None else found.unionByName(hits)
                state.chunks = accumulate(found, chunk_cap)
            elif name == "answer":
                state.answer, state.terminated_by = args.get("text", ""), "answered"
            elif name == "give_up":
                state.terminated_by = "gave_up"
            elif tools and name in tools:
                state.history[-1]["result"] = tools[name](state, **args)
            else:
                state.history[-1]["refused"] = True
        except Exception as e:  # noqa: BLE001
            state.error, state.terminated_by = str(e), "error"
    if not state.terminated_by:
        state.terminated_by = "max_iterations"
        state.answer = fallback(state) if fallback else None
    return state


def evaluate(cases: DataFrame, retriever: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """case_id, id, rank of all cases (case_id, question) from one plan: the retriever takes the cases and gives hits
    (case_id, id, score). A case without hits is a miss; so are all if the retriever fails."""
    try:
        hits = retriever(cases)
        hits.schema  # a plan that can't be resolved fails here
    except Exception:  # noqa: BLE001
        return cases.sparkSession.createDataFrame([], f"case_id {dict(cases.dtypes)['case_id']}, id long, rank int")
    return top_per(hits, 2**31 - 1, "case_id").select("case_id", "id", "rank")
