"""Texts and languages that are null, empty or white space."""

from test_agreement import agree, folder


def test_profiles_of_blank_texts(spark, tmp_path):
    texts = "[NULL, '', ' ', chr(10) || chr(9), 'a', 'one. two']"
    pick = f"SELECT * REPLACE (({texts})[1 + doc_id % 6] AS text, ([NULL, '', ' ', 'en'])[1 + doc_id % 4] AS lang) FROM t"
    con = folder(tmp_path, documents=pick)
    agree(spark, con, tmp_path, "M3_semantic_profiles")
