"""The taxon list builder, typed triples, names to match, and citations by type of entry."""

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import taxon_list, taxonomy
from fieldloom.sources import program as prog
from fieldloom.sources import triples as tri

AUTHORS = "Ann Doe and B. C. Roe and Jo A.M. Poe"


@pytest.mark.parametrize("entry, want", [
    ({"bibtype": "Article", "author": AUTHORS, "year": "1991", "title": "On leaves", "journal": "Trees", "volume": "88", "number": "4", "pages": "504--510", "doi": "10.1/bf001"},
     'A. Doe, B. C. Roe, and J. A. Poe. "On leaves".   _Trees_ 88.4 (1991), pp. 504-510.  doi:  [10.1/bf001](https://doi.org/10.1%2Fbf001).'),
    ({"bibtype": "Article", "author": "Ann Doe, Bo Roe", "year": 2005, "title": "T", "journal": "J", "volume": 93, "pages": 20}, 'A. Doe and B. Roe. "T".   _J_ 93 (2005), p. 20.'),
    ({"bibtype": "Unpublished", "author": "Ann Doe and Ian J. Roe", "year": "2009", "title": "Unpublished data"}, 'A. Doe and I. J. Roe. "Unpublished data". 2009.'),
    ({"bibtype": "Unpublished", "author": "Doe", "year": "unknown", "title": "Study"}, 'Doe. "Study".'),
    ({"bibtype": "Conference", "author": "Doe", "year": "1985", "title": "Needs", "booktitle": "Workshop 9", "volume": None}, 'Doe. "Needs". In: _Workshop 9_. 1985.'),
    ({"bibtype": "TechReport", "author": "D. I. Doe", "year": "1978", "title": "Biomass", "institution": "Forestry", "volume": 6, "pages": 20}, "D. I. Doe. _Biomass_. Tech. rep. Forestry, 1978, p. 20."),
    ({"bibtype": "Thesis", "author": "M. J. Doe", "year": "1979", "title": "Sulphur", "type": "Masters", "institution": "University, Town"}, 'M. J. Doe. "Sulphur". Masters. University, Town, 1979.'),
    ({"bibtype": "PhdThesis", "author": "M. Doe", "year": "1979", "title": "S", "school": "U"}, 'M. Doe. "S". PhD thesis. U, 1979.'),
    ({"bibtype": "Book", "author": "M. Doe", "year": "1979", "title": "S", "publisher": "P", "url": "https://x.y"}, "M. Doe. _S_. P, 1979.  url:  [https://x.y](https://x.y)."),
    ({"title": "Only"}, "_Only_."),
])
def test_citations(entry, want):
    assert prog.citation(entry) == want


def test_several_citations():
    one, two = {"bibtype": "Conference", "author": "A", "year": 1, "title": "t", "booktitle": "b"}, {"bibtype": "Misc", "author": "B", "title": "u"}
    assert prog.citations([one, two]) == 'A. "t". In: _b_. 1; B. _u_.' and prog.citations([]) is None


def test_names_to_match(spark):
    rows = [("Acacia sp. [Doe_1]", "genus", "Acacia"), ("x Agropogon sp. [Doe_1]", "genus", "x Agropogon"), ("Poaceae sp.", "family", "Poaceae"), ("Acacia aneura [Doe_1]", "species", "Acacia aneura"), ("Acacia aneura var. major [x]", "variety", "Acacia aneura var."),
            ("Acacia aneura var. major", "variety", "Acacia aneura var. major"), ("Acacia aneura", "species", "Acacia aneura"), ("Acacia", None, "Acacia"), ("x", "genus", "x")]
    got = spark.createDataFrame([r[:2] for r in rows], "n string, r string").select("n", "r", taxonomy.match_name(F.col("n"), F.col("r")).alias("m")).collect()
    assert [tuple(r) for r in got] == rows


FIRST = [
    ("Acacia aneura", "species", "Acacia aneura", "a1", "accepted", "Fabaceae", "NSW, Qld (naturalised)", "Acacia aneura F.", "s1"), ("Acacia old", "species", "Acacia aneura", "a2", "synonym", "Fabaceae", None, "Acacia old X.", "s2"),
    ("Acacia", "genus", "Acacia", "a3", "accepted", "Fabaceae", None, "Acacia M.", "s3"), ("Acacia aneura", "species", "other", "a9", "synonym", "x", None, None, None), ("Poa b var. c", "variety", "Poa b var. c", "a4", "accepted", "Poaceae", "WA", "Poa b c", "s4"),
]
SECOND = [("Acacia aneura", "species", "wrong", "b1"), ("Vriesea d", "species", "Vriesea d [alternative possible names: Vriesea e]", "b2"), ("Poaceae", "family", "Poaceae", "b3")]


def build(spark, updates, excluded=None, existing=None):
    lists = [("one", spark.createDataFrame([(*r, k) for k, r in enumerate(FIRST)], ", ".join(f"{c} string" for c in taxon_list.REFERENCE) + ", place int")), ("two", spark.createDataFrame([(*r, k) for k, r in enumerate(SECOND)], "canonical_name string, taxon_rank string, accepted_name string, taxon_id string, place int"))]
    genera = spark.createDataFrame([("Acacia", "g1"), ("Poa", "g2")], "genus string, taxon_id string")
    families = spark.createDataFrame([("Fabaceae", "f1"), ("Poaceae", "f2")], "family string, taxon_id string")
    used = spark.createDataFrame(updates, "original_name string, aligned_name string, taxonomic_resolution string, n int")
    ranks = spark.createDataFrame([("Ranked r", "species"), ("Ranked r", "subspecies")], "taxon_name string, taxon_rank string")
    return taxon_list.build_taxon_list(used, ranks, lists, genera, families, excluded, existing, order="place")


def test_taxon_list(spark):
    updates = [("a", "Acacia old", None, 1), ("b", "Acacia sp. [Doe]", "genus", 1), ("c", "Vriesea d", "species", 1), ("d", "Poa b var. c", "variety", 1), ("e", "Nobody knows", None, 1), ("f", "Ranked r", None, 1), ("g", "Poaceae sp. [Doe]", "family", 1), ("h", "Acacia old", "species", 2), (None, None, None, 3), ("i", "Acacia aneura", None, 1)]
    got = {r.aligned_name: r for r in build(spark, updates).collect()}
    assert set(got) == {"Acacia old", "Acacia sp. [Doe]", "Vriesea d", "Poa b var. c", "Ranked r", "Poaceae sp. [Doe]", "Acacia aneura"}
    pick = lambda n, *c: tuple(got[n][x] for x in c)
    assert pick("Acacia old", "taxon_name", "taxon_rank", "taxonomic_status", "taxonomic_dataset", "taxon_id", "scientific_name_id", "aligned_name_taxon_id", "aligned_name_taxonomic_status", "binomial", "genus", "taxon_id_genus", "family", "taxon_id_family", "establishment_means") == ("Acacia aneura", "species", "synonym", "one", "a1", "s1", "a2", "synonym", "Acacia aneura", "Acacia", "g1", "Fabaceae", "f1", "native and naturalised")
    assert pick("Acacia aneura", "taxon_name", "taxon_id", "taxonomic_dataset") == ("Acacia aneura", "a1", "one")
    assert pick("Acacia sp. [Doe]", "taxon_name", "taxon_rank", "taxon_id", "genus", "taxon_id_genus", "family", "binomial", "aligned_name_taxon_id") == ("Acacia sp. [Doe]", "genus", None, "Acacia", "g1", "Fabaceae", None, None)
    assert pick("Vriesea d", "taxon_name", "taxon_name_alternatives", "taxonomic_dataset", "taxon_id") == ("Vriesea d", " Vriesea e", "two", "b2")
    assert pick("Poa b var. c", "trinomial", "binomial", "establishment_means", "taxon_distribution", "taxon_id_family") == ("Poa b var. c", "Poa b", "native", "WA", "f2")
    assert pick("Ranked r", "taxon_rank", "taxonomic_status", "taxonomic_dataset", "genus") == ("species", "unknown", None, "Ranked")
    assert pick("Poaceae sp. [Doe]", "taxon_rank", "taxonomic_dataset", "genus", "family") == ("family", "two", None, "Poaceae sp. [Doe]")
    # names that datasets exclude, and lists built before
    excluded = spark.createDataFrame([("e",), ("a",)], "original_name string")
    assert len(build(spark, updates, excluded).collect()) == 7
    before = spark.createDataFrame([("Acacia old", "Kept")], "aligned_name string, taxon_name string")
    again = {r.aligned_name: r.taxon_name for r in build(spark, updates, None, before).collect()}
    assert again["Acacia old"] == "Kept" and len(again) == 7
    assert build(spark, []).count() == 0


def test_typed_triples(spark):
    rows = [("leaf", "http://p#prefLabel", "A leaf; a blade"), ("leaf", "http://p#broader", "organ"), ("leaf", "http://p#exactMatch", "po:1;  po:9"), ("leaf", "http://p#datatype", "xsd:double"), ("leaf", "http://p#inScheme", "any"), ("top", "http://p#created", "2020-01-02"), ("leaf", "http://p#comment", None), ("leaf", "http://p#seeAlso", "po:1")]
    known = spark.createDataFrame([("po:1", "http://po/1")], "identifier string, entity string")
    got = {tuple(r) for r in tri.typed_triples(spark.createDataFrame(rows, "subject string, predicate string, value string"), known, "http://v", "top").collect()}
    s = "<http://v#leaf>"
    assert got == {(s, "<http://p#prefLabel>", '"A leaf"@en'), (s, "<http://p#prefLabel>", '"a blade"@en'), (s, "<http://p#broader>", "<http://v#organ>"), (s, "<http://p#exactMatch>", "<http://po/1>"), (s, "<http://p#exactMatch>", "<NA>"), (s, "<http://p#datatype>", "<xsd:double>"), (s, "<http://p#inScheme>", "<http://v>"), ("<http://v>", "<http://p#created>", '"2020-01-02"^^<xsd:date>'), (s, "<http://p#seeAlso>", "<http://po/1>")}
