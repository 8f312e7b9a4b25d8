"""Answers by path and parameters, in the shape of a web service: rows, totals, ``ms`` and whether they are exact."""

from __future__ import annotations

import time
from collections.abc import Callable

from ..operators import analytics, assistant, concepts
from ..store import Store

_INTS = {"since_year", "limit", "k", "recent_since"}


def _rows(df) -> dict:
    return {"results": [r.asDict(recursive=True) for r in df.collect()]}


def _record(store: Store, pmid: str) -> dict:
    row = analytics.article_record(store, pmid).first()
    return row.asDict(recursive=True) if row else {"error": f"No article has the id {pmid}."}


def _scoped(name: str) -> Callable:
    return lambda store, **args: assistant.call(store, name, args)


def _compare(store: Store, a: str, b: str, since_year: int | None = None) -> dict:
    sides = [concepts.interpret(store, x) for x in (a, b)]
    if error := next((s.error for s in sides if s.error), None):
        return {"error": error}
    return analytics.compare_concepts(store, sides[0].concept_id, sides[1].concept_id, since_year).first().asDict() | {"note": " ".join(s.note for s in sides)}


def routes(search: Callable | None = None, chat: Callable | None = None) -> dict[str, Callable]:
    """Path to handler. search(store, query, k, since_year) and chat are given by the host, which has the index and model."""
    out = {
        "stats": lambda store: analytics.corpus_stats(store).first().asDict(),
        "resolve": lambda store, q, limit=8: _rows(concepts.resolve_all(store, q, limit)),
        "journals": _scoped("list_journals"),
        "drugs": _scoped("list_drugs"),
        "kols": _scoped("rank_authors"),
        "trend": _scoped("trend_by_year"),
        "countries": _scoped("list_countries"),
        "institutions": _scoped("list_institutions"),
        "cited": _scoped("top_cited"),
        "study_types": _scoped("list_study_types"),
        "trials": _scoped("find_trials"),
        "papers": _scoped("list_papers"),
        "compare": _compare,
        "article": _record,
        "health": lambda store: {"ok": True, "tables": store.names()},
    }
    if search is not None:

        def found(store, q, k=8, since_year=None):
            answer = search(store, q, k, since_year)
            return _rows(answer["rows"]) | {"retrievers": answer["retrievers"]}

        out["search"] = found
    if chat is not None:
        out["ask"] = lambda store, q: vars(assistant.ask(store, q, chat))
    return out


def handle(store: Store, path: str, params: dict | None = None, table: dict[str, Callable] | None = None) -> dict:
    """The answer to a request; search is a sample, everything else is exact. Unknown paths and parameters are errors."""
    table, start, params = table or routes(), time.perf_counter(), dict(params or {})
    name, _, rest = path.strip("/").removeprefix("api/").partition("/")
    if rest:
        params["pmid"] = rest
    if name not in table:
        return {"error": f"There is no path {path}.", "available": sorted(table)}
    try:
        args = {k: int(v) if k in _INTS and v not in (None, "") else v for k, v in params.items()}
        out = table[name](store, **args)
    except (TypeError, ValueError) as e:
        out = {"error": str(e)}
    return out | {"ms": round(1000 * (time.perf_counter() - start)), "exact": name not in ("search", "ask")}
