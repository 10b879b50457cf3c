"""The numbered queries on the smallest tables: contract columns, one row per input row, SQL where there is some."""

import pytest

import __spark_entry__ as entry
from scoreframe.llm.queries import QUERIES, SQL
from tests.oracle import DATA, connect, differences, duck_rows, spark_rows

SF = f"{DATA}/sf0.001"
COLUMNS = {
    2: "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean",
    3: "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    4: "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long",
    6: "page_id long, host string, path string, rule string, verdict string",
    7: "doc_id long, fingerprint string, component_id long",
    8: "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
    9: "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string",
    11: "vec_id long, code string, error long, label_error long, codebooks_sha256 string",
    12: "lang string, source string, part string, item string, value long, rank int",
    13: "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    10: "doc_id long, held_out boolean, lang_pred string, score double",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    n = int(name[2:].split("_")[0])
    for column in COLUMNS.get(n, "").split(", "):
        if column:
            c, kind = column.split()
            assert df.schema[c].dataType.simpleString() == {"long": "bigint"}.get(kind, kind)
    table, key = {4: ("pages", "page_id"), 6: ("pages", "page_id"), 11: ("embeddings", "vec_id")}.get(n, ("documents", "doc_id"))
    if n < 12:
        whole = spark.read.parquet(f"{SF}/{table}.parquet").select(key)
        assert df.select(key).distinct().count() == whole.distinct().count()
        if n not in (1, 3):
            assert df.count() == whole.count()
    if name in SQL:
        assert differences(spark_rows(df), duck_rows(connect(SF), SQL[name])) == ""


def test_entry_lists_them():
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
