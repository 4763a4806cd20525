"""Registered queries: SQL where there is one, whole tables, and the driver's contract."""

import os

import pytest

import __spark_entry__ as registered
from tests.check_oracle import compare, connect
from vicinal.llm import queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert compare(spark, con, name, sf_dir) == ""


def test_one_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(registered.queries())


@pytest.mark.parametrize(
    "name, columns",
    [
        ("op1_decontamination", ["doc_id", "item_id", "n_windows", "n_matched", "n_changed"]),
        ("op2_mix", ["doc_id", "size", "source_size", "target", "taken"]),
        ("op3_jaccard", ["doc_id", "class_id", "n_links"]),
        ("op4_lines", ["doc_id", "n_lines", "n_dropped", "kept_sha256"]),
        ("op5_language", ["doc_id", "held_out", "lang_pred", "score"]),
        ("op6_chat", ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]),
        ("op10_substrings", ["doc_id", "n_words", "n_removed", "kept_sha256"]),
        ("op13_packing", ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]),
    ],
)
def test_columns_and_rows(spark, sf_dir, name, columns):
    df = queries.QUERIES[name](spark, sf_dir)
    assert df.columns[: len(columns)] == columns
    table = "conversations" if name == "op6_chat" else "documents"
    whole = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if name == "op6_chat":
        assert df.count() == whole.select("conv_id").distinct().count() + 1
    elif name == "op13_packing":
        assert df.filter("piece = 0").count() == whole.count()
    elif name != "op1_decontamination":
        assert df.count() == whole.count()


def test_the_rest_does_not_import_this_part():
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(top, "vicinal")):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert "vicinal.llm" not in f.read()
