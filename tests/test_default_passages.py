"""Passages of the first document stand for a list of ids."""

from witloom.sources import editions

FIRST = '<TEI><text><lg xml:id="b"><l xml:id="b1">x</l></lg><p xml:id="a"/><p>none</p><p xml:id="b1">y</p><div xml:id="d">z</div></text></TEI>'
OTHER = '<TEI><text><p xml:id="a">one</p><p xml:id="c">two</p></text></TEI>'


def docs(spark, *files):
    return spark.createDataFrame(list(files), "path string, value string")


def test_default_passages(spark):
    files = docs(spark, ("2", OTHER), ("1", FIRST), ("3", "<TEI>"), (None, OTHER), ("4", None))
    ids = lambda **k: [tuple(r) for r in editions.default_passages(files, **k).orderBy("passage_ord").collect()]
    assert ids() == [(0, "b"), (1, "b1"), (2, "a")]
    assert ids(first="2") == [(0, "a"), (1, "c")] and ids(first="3") == ids(first="4") == ids(first="no") == []
    kept = editions.passage_select(editions.segments(files.where("path = '2'")), editions.default_passages(files))
    assert [(r["passage_id"], r["text"]) for r in kept.collect()] == [("a", "one")]
    assert editions.default_passages(docs(spark).limit(0)).count() == 0
