"""Account numbers that capitals or digits follow."""
import pytest

from tabwarden.llm import pii


@pytest.mark.parametrize("text, found", [
    ("DE89370400440532013000 Bank", ["DE89370400440532013000"]),
    ("DE89370400440532013000 12 May", ["DE89370400440532013000"]),
    ("GB82WEST12345698765432 Please", ["GB82WEST12345698765432"]),
    ("DE89 3704 0044 0532 0130 00 BIC COBADEFF", ["DE89 3704 0044 0532 0130 00"]),
    ("GB82WEST12345698765432 OR", ["GB82WEST12345698765432"]),
    ("GB82WEST12345698765432 DE89370400440532013000", ["GB82WEST12345698765432", "DE89370400440532013000"]),
    ("NO9386011117947 A", ["NO9386011117947"]),
    ("DE89370400440532013000X", []),
])
def test_account_number_ends_where_it_does(spark, text, found):
    spans = pii.find_personal_data(spark.createDataFrame([(text,)], "text string")).first()["spans"]
    assert [text[s["start"]:s["end"]] for s in spans if s["kind"] == "iban"] == found
