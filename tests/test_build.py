import os

import pytest

from quillspark.operators import build, retrieval
from quillspark.operators.refine import read_csv_shards, refine
from quillspark.store import Store

from .test_ingest import FIRST, SECOND

ONE = retrieval.hashed_encoder(8)


def encode(texts):
    assert len(texts) <= build.BATCH
    return [ONE(t) for t in texts]


@pytest.fixture
def source(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.xml").write_text(FIRST)
    return tmp_path


def test_files_to_a_searchable_store(spark, source):
    out = str(source / "out")
    report = {r.table: (r.n_rows, r.n_keys) for r in build.add_files(spark, str(source / "in"), out, encode=encode, model="hashes").collect()}
    assert report["articles"] == (3, 3) and report["authorships"][0] == report["authorships"][1]
    store, index = Store.read(spark, f"{out}/store"), build.Index(spark, f"{out}/index")
    assert index.marker["model"] == "hashes" and index.marker["docs"] == 1
    assert index.table("docmeta").columns == ["pmid", "title", "pub_year", "medline_ta"]
    found = index.search(store, "seeing", encode=encode)
    assert [r.pmid for r in found["rows"].collect()] == ["1"] and found["retrievers"] == ["bm25", "vector"]
    assert build.progress(store, f"{out}/index", 4.3) == {"complete": True, "done": 1, "total": 1, "percent": 100.0, "hours_left": 0.0}
    # again with another file: everything is made anew, vectors only where there are none
    (source / "in/b.xml").write_text(SECOND)
    again = {r.table: r.n_rows for r in build.add_files(spark, str(source / "in"), out, encode=encode, model="hashes").collect()}
    assert again["articles"] == 2
    assert build.Index(spark, f"{out}/index").table("vectors").count() == 1


def test_an_index_without_its_marker_searches_by_words(spark, source):
    out = str(source / "out")
    build.add_files(spark, str(source / "in"), out)
    store, index = Store.read(spark, f"{out}/store"), build.Index(spark, f"{out}/index")
    assert index.marker is None and index.search(store, "see", encode=encode)["retrievers"] == ["bm25"]
    assert build.progress(store, f"{out}/index") == {"complete": False, "done": 0, "total": 1, "percent": 0.0}


def test_rate_and_restarts(spark):
    docs = spark.createDataFrame([(str(i), f"text {i}") for i in range(130)], "pmid string, text string")
    rate = build.encoder_rate(docs, encode, n=100)
    assert rate["docs"] == 100 and rate["docs_a_second"] > 0
    tries, said = [], []

    def step():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("gone")
        return "done"

    assert build.restarting(step, 5, 0.0, said.append) == "done" and len(said) == 2
    with pytest.raises(OSError):
        build.restarting(lambda: (_ for _ in ()).throw(OSError("gone")), 2, 0.0, said.append)


def test_environment_files(tmp_path, monkeypatch):
    monkeypatch.setenv("SET_ALREADY", "1")
    monkeypatch.delenv("NOT_SET", raising=False)
    (tmp_path / "env").write_text("# SKIPPED=1\nSET_ALREADY=2\n NOT_SET = 'x=y' \nno sign\n=3\n")
    assert build.read_env(str(tmp_path / "env")) == {"SET_ALREADY": "2", "NOT_SET": "x=y"}
    assert os.environ["SET_ALREADY"] == "1" and os.environ["NOT_SET"] == "x=y"
    monkeypatch.delenv("NOT_SET")
    assert build.read_env(str(tmp_path / "none")) == {}


def test_shards_round_trip(spark, tmp_path):
    store = Store.of(spark, {"keywords": spark.createDataFrame([("1", ' a "b"\nc', True), ("2", "d,e", False)], "pmid string, term string, is_major boolean")})
    build.write_shards(store, "keywords", str(tmp_path / "k"))
    articles = spark.createDataFrame([("1", 1), ("2", 1)], "pmid string, date_revised int")
    back = refine({"articles": articles, "keywords": read_csv_shards(spark, str(tmp_path / "k"), "keywords")}, spark)["keywords"]
    assert sorted(map(tuple, back.collect())) == [("1", ' a "b"\nc', True), ("2", "d,e", False)]
