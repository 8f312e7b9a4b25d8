from quillspark.plans.routes import handle, routes

from .test_operators import store  # noqa: F401


def test_requests(store):  # noqa: F811
    out = handle(store, "/api/journals", {"concept_id": "P", "limit": "1"})
    assert out["total_papers"] == 3 and out["exact"] and out["ms"] >= 0 and len(out["results"]) == 1
    assert handle(store, "/api/article/2")["title"] == "Article 2" and "error" in handle(store, "/api/article/99")
    assert "available" in handle(store, "/api/nothing") and "error" in handle(store, "/api/journals", {"limit": "x"}) and "error" in handle(store, "/api/stats", {"x": 1})
    assert handle(store, "/api/compare", {"a": "D000000001", "b": "kw:gene x"})["both"] == 0
    table = routes(search=lambda s, q, k, y: {"rows": s["journals"].select("medline_ta"), "retrievers": ["bm25"]}, chat=lambda m, t: {"answer": "x"})
    assert not handle(store, "search", {"q": "cat", "k": "3"}, table)["exact"] and handle(store, "ask", {"q": "cat"}, table)["refused"]
