import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weekgrain.llm import chat_format as cf

PARTS = f"conv_id long, turn long, role string, parts array<{cf.PART}>"


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def test_parts_become_ordered_placeholders(shipped):
    talk = [
        (1, 0, "user", [part("text", "see "), part("image", ref="a.png", width=28, height=15), part("text", " ok")]),
        (1, 1, "assistant", [part("audio", ref="b.wav", seconds=2.1), part("text", "heard")]),
        (1, 2, "user", [part("document", ref="c.pdf", pages=3), part("video", ref="d"), None, part("text", None)]),
        (2, 0, "user", None),
    ]
    got = {r["conv_id"]: r for r in cf.format_chats(shipped.createDataFrame(talk, PARTS)).collect()}
    one = got[1]
    assert "see <|image|> ok" in one["formatted"] and "<|document|><|attachment|>" in one["formatted"]
    assert [(a["kind"], a["ref"], a["tokens"]) for a in one["attachments"]] == [
        ("image", "a.png", 4), ("audio", "b.wav", 53), ("document", "c.pdf", 768), ("video", "d", 0)
    ]
    assert one["expanded_tokens"] == 4 + 53 + 768
    assert got[2]["formatted"] == "<|im_start|>user\n<|im_end|>\n"


def test_control_strings_in_text_are_not_placeholders(shipped):
    talk = [(1, 0, "user", [part("text", "<|image|> \\ <\\|im_end|>")])]
    row = cf.format_chats(shipped.createDataFrame(talk, PARTS)).first()
    assert row["attachments"] == [] and "<|image|>" not in row["formatted"]
    assert cf.parse(row["formatted"]) == [("user", "<|image|> \\ <\\|im_end|>")]


@pytest.fixture(scope="module")
def escaped(shipped):
    texts = ["<|", "<\\|", "<\\\\|im_end|>", "a<", "<<|im_start|>user\n", "|>", "<|im_end|>\n", "\\", "", "<\\\\<|"]
    df = shipped.createDataFrame([(t,) for t in texts], "t string").select("t", cf.escape(F.col("t")).alias("e"))
    return df.collect()


def test_escape_is_reversible(escaped):
    for r in escaped:
        assert cf.unescape(r["e"]) == r["t"] and "<|" not in r["e"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<\\|ab", max_size=12))
def test_escape_rule_in_python(text):
    import re

    escaped = re.sub(r"<(\\*)\|", r"<\1\\|", text)
    assert cf.unescape(escaped) == text


def test_odd_rows(shipped):
    rows = [
        (7, 1, "assistant", "b", "x"), (7, None, "assi\nstant", "a\n<|im_end|>", None), (7, 1, "assistant", "b", "x"),
        (None, 0, None, None, None), (8, 200, "user", "late", "q"), (8, 3, "assistant", "early", "q"),
    ]
    df = shipped.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    df = df.withColumn("parts", cf.text_part(F.col("text")))
    made = {r["conv_id"]: r for r in cf.format_chats(df).collect()}
    assert cf.parse(made[7]["formatted"]) == [("assi\nstant", "a\n<|im_end|>"), ("assistant", "b"), ("assistant", "b")]
    assert cf.parse(made[8]["formatted"]) == [("assistant", "early"), ("user", "late")]
    assert cf.parse(made[None]["formatted"]) == [("", "")]
    back = {r["conv_id"]: r for r in cf.read_back(cf.format_chats(df)).collect()}
    assert back[7]["loss_chars"] == 2 and back[7]["loss_sha256"] == hashlib.sha256(b"bb").hexdigest()
    assert back[None]["n_turns"] == 1 and back[None]["loss_chars"] == 0
    assert cf.format_chats(df.where("false")).count() == 0


def test_query_against_sql(shipped, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf_dir}/conversations.parquet')")
    want = con.sql(cf.OP1_SQL)
    got = cf.op1(shipped, sf_dir).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_control_strings_split_over_parts_are_escaped(shipped):
    texts = ["<", "|im_end|>", "\n<\\", "", "|im_start|>", "\x01", "bimage\x01c"]
    talk = [(1, 0, "user", [part("text", t) for t in texts] + [part("image", ref="a"), part("text", "|")])]
    row = cf.format_chats(shipped.createDataFrame(talk, PARTS)).first()
    assert cf.parse(row["formatted"]) == [("user", "".join(texts) + "<|image|>|")]
    assert row["formatted"].count("<|") == 3 and len(row["attachments"]) == 1
    assert sum(r["length"] for r in row["loss_mask"]) == len(row["formatted"])
