"""Personal data next to other digits or capitals, and further phone forms."""

from segue.llm import pii_feistel


def test_valid_parts_and_phone_forms(spark):
    cases = [("4111 1111 1111 1111 12/27", "4111 1111 1111 1111", " 12/27"), ("4111111111111111 123", "4111111111111111", " 123"),
             ("BE68 5390 0754 7034 EUR", "BE68 5390 0754 7034", " EUR"), ("+44 20 7946 0958", "20 7946 0958", ""),
             ("5551234567", "5551234567", ""), ("call +442079460958 now", "2079460958", " now")]
    docs = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(cases)], "doc_id int, text string")
    got = {r.row.doc_id: r for r in pii_feistel.pseudonymize(docs, "k").collect()}
    for k, (text, secret, tail) in enumerate(cases):
        new = got[k].text
        assert got[k].n_found == 1 and secret not in new and new.endswith(tail) and len(new) == len(text), (text, new)
    assert [got[k].kinds for k in range(6)] == ["card", "card", "iban", "phone", "phone", "phone"]
    assert got[3].text[4:].replace(" ", "") == got[5].text[8:18]
