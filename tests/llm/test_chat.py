import duckdb
import pyarrow as pa
import pytest

from glyphmill.llm.chat import ORACLE, linked_conversations

SCHEMA = "conv_id long, turn long, role string, text string, depth string"
ROWS = [
    (1, 0, "user", "How do I sort a list?\nIt has  many rows.\nThanks", "x"),
    (1, 1, "assistant", "> How do I sort a list?\n\nUse sorted().\nThanks", "x"),
    (1, 2, "user", "On Monday, A wrote:\n> Use sorted().\n>> how do i SORT a list?\nAnd in place?", "x"),
    (1, 3, "user", "> it has many rows.\n>\n>  Thanks\nBe quick", "x"),
    (1, 4, "assistant", "> > And in place?\n> not anywhere\nlist.sort()", "x"),
    (1, 5, "user", "> list.sort()", "x"),
    (1, 5, "user", "> Be quick\nagain", "x"),
    (2, 0, "user", "> Use sorted().\nother conversation", "x"),
    (2, 1, None, None, "x"),
    (2, None, "user", "> other conversation\nno turn", "x"),
    (None, 3, "user", "> other conversation\nno conversation", "x"),
    (3, 0, "user", "", "x"),
    (3, 1, "user", "a > b is no quote\nShe wrote:\nno quote below", "x"),
    (3, 2, "user", "Elle a écrit :\n>a > b is no quote\n  >  > x", "x"),
    (4, 7, "user", "> later text", "x"),
    (4, 8, "user", "later text", "x"),
    (4, 9, "user", "later text\n" + "> later text\n" * 3000, "x"),
    (6, 0, "user", "A passage of\nseveral lines that is\nquoted whole.\n\nThanks", "x"),
    (6, 1, "assistant", "Another one.\n\nThanks", "x"),
    (6, 2, "user", "> A passage of several\n> lines   that is quoted whole.\n>\n> Thanks\nwrapped anew", "x"),
    (6, 3, "user", "> several lines that is\n> not a line of it\npart of it", "x"),
    (6, 4, "user", "x" * 700 + " wrote:\n> wrapped anew\na long line of addressees", "x"),
    (6, 5, "user", "> WRAPPED\n> anew\n> > several lines that is\n> Thanks\n\x01\n>\x02 part\tof it", "x"),
] + [(5, i, "user", (f"> line {i - 1} of the chain\n" if i else "") + f"line {i} of the chain", "x") for i in range(40)]
NAMES = ["conv_id", "turn", "role", "text", "parent_turn", "thread_turn", "depth", "n_quoted", "n_linked", "chat"]


def test_links_and_texts(spark):
    got = {(r.conv_id, r.turn): r for r in linked_conversations(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got[1, 1].text == "Use sorted().\nThanks" and got[1, 1].parent_turn == 0
    assert got[1, 2].text == "And in place?" and (got[1, 2].parent_turn, got[1, 2].depth, got[1, 2].thread_turn) == (1, 2, 0)
    assert (got[1, 3].parent_turn, got[1, 3].n_quoted, got[1, 3].n_linked) == (0, 2, 2)
    assert (got[1, 4].parent_turn, got[1, 4].depth, got[1, 4].n_linked) == (2, 3, 1)
    assert got[2, 0].parent_turn is None and got[2, 0].text == "other conversation"
    assert got[4, 7].parent_turn is None and got[4, 9].n_linked == 3000 and got[4, 9].parent_turn == 8
    assert (got[5, 39].depth, got[5, 39].thread_turn) == (39, 0)
    assert (got[6, 2].parent_turn, got[6, 2].n_quoted, got[6, 2].n_linked) == (0, 3, 3)
    assert (got[6, 3].parent_turn, got[6, 3].n_linked) == (0, 1)
    assert (got[6, 4].parent_turn, got[6, 4].text) == (2, "a long line of addressees")
    assert (got[6, 5].parent_turn, got[6, 5].n_quoted, got[6, 5].n_linked) == (2, 5, 5)
    assert got[3, 1].text.startswith("a > b") and got[3, 2].text == ""


@pytest.mark.parametrize("rows", [ROWS, ROWS[:0]])
def test_equals_sql(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.register("conversations", pa.table({n: pa.array([r[i] for r in rows], pa.string() if n in ("role", "text") else pa.int64()) for i, n in enumerate(("conv_id", "turn", "role", "text"))}))
    want = sorted(map(str, con.execute(f"SELECT {', '.join(NAMES)} FROM ({ORACLE})").fetchall()))
    got = sorted(str(tuple(r)) for r in linked_conversations(df).select(NAMES).collect())
    assert got == want
