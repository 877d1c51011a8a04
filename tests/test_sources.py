"""Sources: the comment CSV keeps quoted multi-line text and turns NaN
identity scores into NULL; word2vec text drops its header line."""

import tempfile

from equitext.constants import GROUPS
from equitext.operators import embed as E
from equitext.sources import tables as T


def test_comment_csv_multiline_and_nan(spark):
    path = tempfile.mkdtemp(prefix="equitext-csv-") + "/c.csv"
    header = "id,target,comment_text," + ",".join(GROUPS)
    rows = [
        '1,0.7,"line one\nline ""two""",' + ",".join(["NaN"] + ["0.9"] * 8),
        "2,0.1,plain," + ",".join([""] * 9),
    ]
    with open(path, "w") as f:
        f.write(header + "\n" + "\n".join(rows) + "\n")
    got = {r["id"]: r for r in T.read_comments(spark, path).collect()}
    assert got[1]["comment_text"] == 'line one\nline "two"'
    assert got[1]["black"] is None and got[1]["white"] == 0.9
    assert got[2]["black"] is None and got[2]["target"] == 0.1


def test_word2vec_text_header_dropped(spark):
    path = tempfile.mkdtemp(prefix="equitext-w2v-") + "/v.txt"
    with open(path, "w") as f:
        f.write("2 3\naa 0.1 0.2 0.3\nbb -1 0 1\n")
    got = {r["token"]: r["vec"] for r in E.read_word2vec_text(spark, path).collect()}
    assert got == {"aa": [0.1, 0.2, 0.3], "bb": [-1.0, 0.0, 1.0]}
