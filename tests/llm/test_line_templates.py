import duckdb
import pandas as pd

from hearthline.llm import line_templates as L

OWN = [" ".join(c + x for x in ("a", "b", "c", "d")) for c in "klmnopqr"]
ROWS = [(k, f"{OWN[k]}\nLicensed since {1990 + k} by us\nAll rights reserved.\nThe.") for k in range(8)]
ROWS += [(20, None), (21, ""), (22, "Licensed since 5 by us"), (None, "nothing shared here at all"), (0, ROWS[0][1]), (23, "w " * 30_000)]


def test_equals_sql_and_keeps_other_lines(spark, documents):
    found = L.drop_recurring(documents(ROWS).select("doc_id", "text")).toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(ROWS, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    expected = con.execute(L.ORACLE).fetchall()
    key = lambda rows: sorted(map(str, rows))
    got = [(None if pd.isna(r.doc_id) else int(r.doc_id), r.text if isinstance(r.text, str) else None, r.n_lines, r.n_dropped) for r in found.itertuples()]
    assert key(got) == key([(None if r[0] is None else int(r[0]), r[1], r[2], r[3]) for r in expected])
    texts = {r[0]: r[1] for r in got}
    assert texts[3] == OWN[3] + "\nThe." and texts[22] == "" and texts[20] is None


def test_clashing_columns_and_no_rows(documents):
    docs = documents(ROWS).withColumnRenamed("source", "tid").withColumnRenamed("lang", "n_lines")
    assert L.drop_recurring(docs).columns == ["doc_id", "text", "tid", "n_chars", "n_lines", "n_dropped"]
    assert L.drop_recurring(documents([])).count() == 0
