"""Ids of texts that strain a tokenizer: long runs of one kind, special tokens, other files."""

import json

import pytest

from millrace.llm import packing

SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def tokens():
    return packing.token_ids(packing.public_tokenizer())


@pytest.mark.parametrize("text", [
    " " * 2_000_000, "\n" * 2_000_000, "a" * 300_000, " \t\n　" * 500_000, "x" + " " * 7_999 + "y", "x" + " " * 8_000 + "y",
    "漢aé1 " * 50_000, "-" * 300_000, "<|endoftext|> a" * 9, "\x1c" * 20_000, "",
])
def test_ids_are_those_of_the_file(tokens, text):
    assert tokens.of(text) == tokens.tokenizer.encode(text, add_special_tokens=False).ids


def test_rows_of_blanks_are_packed(spark):
    rows = [(1, " " * 2_000_000), (2, "\n" * 1_000_000 + "word"), (3, None), (4, "")]
    got = packing.pack_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    tokens = packing.token_ids(packing.public_tokenizer())
    for key, text in rows:
        mine = sorted((r["start"], r["length"]) for r in got if r["doc_id"] == key)
        assert sum(n for _, n in mine) == len(tokens.of(text or "")) + 1


def test_another_pre_tokenizer_is_not_guessed(tmp_path):
    with open(packing.public_tokenizer(), encoding="utf-8") as f:
        parts = json.load(f)
    parts["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(parts), encoding="utf-8")
    other = packing.TokenIds(str(path))
    assert other.fast is None and other.of("word two") == other.tokenizer.encode("word two", add_special_tokens=False).ids
