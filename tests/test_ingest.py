import gzip

import pytest

from quillspark.operators.refine import read_csv_shards, refine
from quillspark.plans import catalogue
from quillspark.sources.records import read_records, read_taxonomy, tables_of
from quillspark.streaming import incremental


def person(last=None, fore=None, initials=None, orcid=None, collective=None, affiliation=None):
    parts = [f"<{t}>{v}</{t}>" for t, v in (("LastName", last), ("ForeName", fore), ("Initials", initials), ("CollectiveName", collective)) if v]
    parts += [f'<Identifier Source="ORCID">{orcid}</Identifier>'] * bool(orcid) + [f"<AffiliationInfo><Affiliation>{affiliation}</Affiliation></AffiliationInfo>"] * bool(affiliation)
    return f"<Author>{''.join(parts)}</Author>"


def article(pmid, revised="2020", title="T", date="<Year>2019</Year><Month>Jan</Month>", people="", abstract="", extra="", data=""):
    return f"""<PubmedArticle><MedlineCitation Status="MEDLINE"><PMID>{pmid}</PMID><DateRevised><Year>{revised}</Year></DateRevised>
    <Article><Journal><JournalIssue><Volume>1</Volume><PubDate>{date}</PubDate></JournalIssue><Title>Journal One</Title><ISOAbbreviation>J1</ISOAbbreviation></Journal>
    <ArticleTitle>{title}</ArticleTitle><Abstract>{abstract}</Abstract><AuthorList>{people}</AuthorList><Language>eng</Language>
    <PublicationTypeList><PublicationType UI="D1">Review</PublicationType></PublicationTypeList></Article>
    <MedlineJournalInfo><Country>Chile</Country><MedlineTA>J One</MedlineTA><NlmUniqueID>N1</NlmUniqueID></MedlineJournalInfo>{extra}</MedlineCitation>
    <PubmedData>{data}</PubmedData></PubmedArticle>"""


FIRST = "<PubmedArticleSet>" + article(
    "1",
    title="Role of <i>TP53</i> &lt; 5",
    people=person("Yun", "Ann", "A", "https://orcid.org/0000-0001-2345-678x/", affiliation="Dept, Univ, 12345 Chile. Electronic address: a@b.c") + person("Yun", initials="B") + person() + person(collective="The Group"),
    abstract='<AbstractText Label="AIM">to <b>see</b></AbstractText><AbstractText></AbstractText><AbstractText>more</AbstractText>',
    extra='<MeshHeadingList><MeshHeading><DescriptorName UI="D000000001" MajorTopicYN="Y">Heart</DescriptorName><QualifierName UI="Q1"/><QualifierName UI="Q2"/></MeshHeading></MeshHeadingList><ChemicalList><Chemical><RegistryNumber>0</RegistryNumber><NameOfSubstance UI="C1">Water</NameOfSubstance></Chemical></ChemicalList><KeywordList><Keyword MajorTopicYN="N"> Gene X </Keyword><Keyword></Keyword></KeywordList>',
    data='<ArticleIdList><ArticleId IdType="doi">own/1</ArticleId></ArticleIdList><ReferenceList><Reference><ArticleIdList><ArticleId IdType="pubmed">7</ArticleId><ArticleId IdType="doi">cited/7</ArticleId></ArticleIdList></Reference></ReferenceList>',
) + article("2", date="<MedlineDate>2018 Nov-Dec</MedlineDate>", people=person("Solo", "S")) + article("", title="no id") + article("3", revised="2019", people=person("A", "A") + person("B", "B")) + "</PubmedArticleSet>"
SECOND = "<PubmedArticleSet>" + article("3", revised="2021", title="newer", people=person("A", "A")) + "<DeleteCitation><PMID>2</PMID></DeleteCitation></PubmedArticleSet>"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.xml").write_text(FIRST)
    with gzip.open(tmp_path / "in/b.xml.gz", "wb") as f:
        f.write(SECOND.encode())
    return tmp_path


def check(store):
    articles = {r.pmid: r for r in store["articles"].collect()}
    assert set(articles) == {"1", "3"}
    one = articles["1"]
    assert one.title == "Role of TP53 < 5" and one.abstract == "AIM: to see more" and one.doi == "own/1" and (one.pub_year, one.pub_month) == (2019, 1)
    assert articles["3"].title == "newer"
    rows = {(r.pmid, r.position): r for r in store["authorships"].collect()}
    assert set(rows) == {("1", 1), ("1", 2), ("1", 4), ("3", 1)}
    assert rows["1", 1].author_key == "orcid:0000-0001-2345-678X" and rows["1", 1].country == "Chile" and rows["1", 1].is_first
    assert rows["1", 2].author_key == "name:yun|b" and rows["1", 4].author_key == "group:the group" and rows["1", 4].is_last
    assert rows["3", 1].is_first and not rows["3", 1].is_last
    assert [tuple(r) for r in store["mesh_headings"].collect()] == [("1", "D000000001", "Heart", True, "Q1|Q2")]
    assert [tuple(r) for r in store["citations"].collect()] == [("1", "7")]
    assert [r.term for r in store["keywords"].collect()] == ["Gene X"]
    assert store["journals"].count() == 1
    names = {r.author_key: r.display_name for r in store["authors"].collect()}
    assert names["orcid:0000-0001-2345-678X"] == "Ann Yun" and names["group:the group"] == "The Group"


def test_files_become_a_store(spark, folder):
    rows = read_records(spark, str(folder / "in"))
    check(refine(tables_of(rows), spark))
    kept = refine(tables_of(rows), spark, apply_deletes=False, version_consistent=False)
    assert {r.pmid for r in kept["articles"].collect()} == {"1", "2", "3"}
    assert {(r.pmid, r.position) for r in kept["authorships"].where("pmid = '3'").collect()} == {("3", 1), ("3", 2)}
    assert kept["articles"].where("pmid = '2'").first().pub_year == 2018


def test_new_files_are_merged(spark, folder):
    where = [str(folder / n) for n in ("in", "landed", "checkpoint")]
    held = (folder / "in/b.xml.gz").rename(folder / "later.gz")
    incremental.start(spark, *where).awaitTermination()
    assert {r.pmid for r in incremental.store_of(spark, where[1])["articles"].collect()} == {"1", "2", "3"}
    held.rename(folder / "in/b.xml.gz")
    incremental.start(spark, *where).awaitTermination()
    check(incremental.store_of(spark, where[1]))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_winning_versions_are_joined_by_key(spark, folder):
    """The list of all articles is sent to no task whole, however small the files are estimated."""
    store = refine(tables_of(read_records(spark, str(folder / "in"))), spark)
    for name in ("articles", "authorships", "citations", "keywords"):
        assert "BroadcastExchange" not in plan_of(store[name]) and "SortMergeJoin" in plan_of(store[name])


def test_files_are_parsed_once_for_all_tables(spark):
    for name in ("xml_articles", "xml_authorships", "xml_journals"):
        plan = plan_of(catalogue.queries()[name](spark, "/root/testdata/sf0.001"))
        assert "binaryFile" not in plan and "MapIn" not in plan


def test_rows_of_records_as_arrow_give_what_the_schema_says(spark, folder):
    rows = read_records(spark, str(folder / "in")).orderBy("source_file", "ordinal").collect()
    assert [(r.kind, r.pmid, r.ordinal) for r in rows] == [("article", "1", 1), ("article", "2", 2), ("article", "3", 3), ("article", "3", 1), ("delete", "2", 2)]
    assert [(a.last, a.position) for a in rows[0].authors] == [("Yun", "1"), ("Yun", "2"), (None, "3"), (None, "4")]
    assert rows[4].authors == [] and rows[4].title is None and rows[0].cites[0].pmid == "7" and rows[0].month == "Jan"


def test_taxonomy(spark, tmp_path):
    (tmp_path / "d.xml").write_text("<S><DescriptorRecord><DescriptorUI>D1</DescriptorUI><DescriptorName><String>Heart</String></DescriptorName><TreeNumberList><TreeNumber>A1</TreeNumber><TreeNumber>B1.2</TreeNumber></TreeNumberList><ConceptList><Term><String>Heart</String></Term><Term><String>heart</String></Term><Term><String>Cor</String></Term></ConceptList></DescriptorRecord></S>")
    out = read_taxonomy(spark, str(tmp_path / "d.xml"))
    assert sorted(map(tuple, out["synonyms"].collect())) == [("cor", "D1", "Heart"), ("heart", "D1", "Heart")]
    assert sorted(map(tuple, out["mesh_tree"].collect())) == [("D1", "A1", "Heart"), ("D1", "B1.2", "Heart")]


def test_csv_shards(spark, tmp_path):
    (tmp_path / "keywords__x.csv").write_text('1,"a ""b""\nc",1,extra\n2,short\n2,short\n')
    (tmp_path / "articles__x.csv").write_text("1,N,T,A,x,1\n2,N,T,A,2020,1\n")
    store = refine({t: read_csv_shards(spark, str(tmp_path / f"{t}__*.csv"), t) for t in ("articles", "keywords")}, spark)
    assert sorted(map(tuple, store["keywords"].collect())) == [("1", 'a "b"\nc', True), ("2", "short", None)]
    assert {r.pmid: r.pub_year for r in store["articles"].collect()} == {"1": None, "2": 2020}
