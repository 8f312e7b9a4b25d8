"""Questions in words: a tool registry, a loop around any chat function, and a check that its numbers were seen.

A model chooses operators; it never writes a query, and an answer with numbers that no operator gave is sent back.
"""

from __future__ import annotations

import inspect
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from ..store import Store
from . import analytics, concepts, retrieval

MAX_STEPS, MAX_OBSERVATION = 6, 6000


def _tool(f, scoped: bool):
    def run(store: Store, **args):
        note = None
        if scoped and args.get("concept_id"):
            scope = concepts.interpret(store, args["concept_id"])
            if scope.error:
                return {"error": scope.error}
            args["concept_id"], note = scope.concept_id, scope.note
        out = f(store, **args)
        body = out.collect() if isinstance(out, analytics.Result) else {"results": [r.asDict(recursive=True) for r in out.collect()]}
        return body | ({"note": note} if note else {})

    run.parameters = [p for p in inspect.signature(f).parameters if p != "store"]
    run.__doc__ = (f.__doc__ or "").split("\n")[0]
    return run


REGISTRY: dict[str, Callable] = {
    name: _tool(getattr(analytics, name), True)
    for name in ("list_journals", "list_drugs", "rank_authors", "list_papers", "trend_by_year", "list_countries", "list_institutions", "top_cited", "list_study_types", "find_trials")
} | {
    "resolve_concept": _tool(concepts.resolve, False),
    "spot_concepts": _tool(concepts.spot, False),
    "article_record": _tool(analytics.article_record, False),
    "corpus_stats": _tool(analytics.corpus_stats, False),
    "articles_by_id": _tool(analytics.articles_by_id, False),
    "compare_concepts": _tool(analytics.compare_concepts, False),
    "concept_scope": _tool(concepts.scope_summary, False),
}


def register(name: str, f: Callable) -> None:
    """Adds a tool: a function of a store and named arguments that gives a dictionary."""
    REGISTRY[name] = f


def register_search(index, sizes=None, vectors=None, encode=None, stemmed: bool = False) -> None:
    """Adds ``search_literature`` over an index, and over vectors if an encoder is given; its rows are a sample."""

    def search_literature(store: Store, query: str, k: int = 8, since_year: int | None = None) -> dict:
        """The papers that best fit a text, which are a sample and never a total."""
        found = retrieval.search(store, index, query, k, since_year, vectors, encode, stemmed=stemmed, sizes=sizes)
        return {"results": [r.asDict(recursive=True) for r in found["rows"].collect()], "retrievers": found["retrievers"], "exact": found["exact"]}

    search_literature.parameters = ["query", "k", "since_year"]
    register("search_literature", search_literature)


def call(store: Store, name: str, args: dict) -> dict:
    """The tool's answer; an unknown tool or a wrong argument is an error that says so."""
    if name not in REGISTRY:
        return {"error": f"There is no tool {name}.", "available": sorted(REGISTRY)}
    known = getattr(REGISTRY[name], "parameters", None)
    if known is not None and (wrong := sorted(set(args) - set(known))):
        return {"error": f"{name} takes no {', '.join(wrong)}; it takes {', '.join(known)}."}
    try:
        return REGISTRY[name](store, **args)
    except TypeError as e:
        return {"error": str(e)}


def tool_schemas() -> list[dict]:
    """Name, purpose and arguments of each tool, for a chat model."""
    return [{"name": n, "description": (f.__doc__ or "").strip(), "parameters": list(getattr(f, "parameters", []))} for n, f in REGISTRY.items()]


def unseen_numbers(answer: str, seen: list[str], strict: bool = True) -> list[str]:
    """Numbers of an answer that no observation holds. Strictly, whole numbers are compared, thousands separators and
    single digits included; otherwise any two digits that occur anywhere in an observation will do."""
    if not strict:
        text = " ".join(seen)
        return sorted({n for n in re.findall(r"\b\d{2,}\b", answer) if n not in text})
    numbers = lambda s: {n.replace(",", "") for n in re.findall(r"(?<![\w.])\d{1,3}(?:,\d{3})+(?:\.\d+)?|(?<![\w.])\d+(?:\.\d+)?", s)}
    known = set().union(*map(numbers, seen)) if seen else set()
    return sorted(numbers(answer) - known)


@dataclass
class Answer:
    text: str
    refused: bool = False
    calls: list[dict] = field(default_factory=list)
    unseen: list[str] = field(default_factory=list)
    steps: int = 0


def ask(store: Store, question: str, chat: Callable[[list[dict], list[dict]], dict], strict: bool = True) -> Answer:
    """Runs a conversation with a chat function that gives either {"tool", "args"} or {"answer"}.

    The answer is refused if no tool gave rows; remarks of the tools that it leaves out are added."""
    messages, seen, calls, remarks, rows = [{"role": "user", "content": question}], [question], [], [], False
    for step in range(1, MAX_STEPS + 1):
        reply = chat(messages, tool_schemas())
        if "tool" in reply:
            out = call(store, reply["tool"], reply.get("args") or {})
            calls.append({"tool": reply["tool"], "args": reply.get("args") or {}, "error": out.get("error")})
            rows = rows or bool(out.get("results"))
            remarks += [out[k] for k in ("note", "caveat") if out.get(k)]
            content = json.dumps(out, default=str, ensure_ascii=False)[:MAX_OBSERVATION]
            seen.append(content)
            messages.append({"role": "tool", "name": reply["tool"], "content": content})
            continue
        text = reply.get("answer") or ""
        if not rows:
            return Answer("No operator returned rows for this, so it can't be answered from the corpus.", True, calls, [], step)
        wrong = unseen_numbers(text, seen, strict)
        if wrong and step < MAX_STEPS:
            messages.append({"role": "user", "content": f"These numbers are in no result: {', '.join(wrong)}. Answer with the results' numbers only."})
            continue
        if wrong:
            return Answer("The answer held numbers that no result has.", True, calls, wrong, step)
        missing = [r for r in dict.fromkeys(remarks) if r[:40] not in text]
        return Answer("\n".join([text, *missing]), False, calls, [], step)
    return Answer("No answer within the steps allowed.", True, calls, [], MAX_STEPS)


def dry_run(store: Store, question: str) -> dict:
    """Without a model: the concept that a question names, with its journals, people and trend."""
    topic = re.sub(r"(?i)^\s*(which|what|who|how many|list|show|find)\b\s*", "", question).strip(" ?")
    scope = concepts.interpret(store, topic)
    if scope.error:
        return {"error": scope.error}
    out = {"note": scope.note}
    for name in ("list_journals", "rank_authors", "trend_by_year"):
        out[name] = call(store, name, {"concept_id": scope.concept_id})
    return out
