"""NEXUS texts and lines come from one table of coded readings and one of columns' states."""

from witloom.operators import coding
from witloom.sources import line_files, writers
from witloom.storage import stored


def test_readings_are_coded_once(spark, monkeypatch):
    """NEXUS texts and lines take the cells from one coded table; columns of more states than symbols keep their order."""
    calls = []
    monkeypatch.setattr(writers, "stored", lambda df, what: calls.append(what) or stored(df, what))
    monkeypatch.setattr(line_files, "stored", lambda df, what: calls.append(what) or stored(df, what))
    many = [("p", f"W{k:02}", k, 0, f"r{k % 58:02}") for k in range(60)] + [("p", f"W{k:02}", k, 1, "[]" if k else "") for k in range(60)]
    cells = spark.createDataFrame(many, "passage_id string, siglum string, wit_ord int, n int, reading string")
    text = writers.nexus(cells).first()["value"]
    lines = line_files.numbered(line_files.nexus_lines(cells)).orderBy("line_no").collect()
    assert calls == ["coded", "states", "coded", "states", "rows"]
    assert "\n".join(r["line"] for r in lines) == text
    symbols = coding.SYMBOLS + "???"
    assert [x.split(" ")[1][0] for x in text.split("MATRIX\n")[1].split("\n")[:60]] == [*symbols[:58], *symbols[:2]]
