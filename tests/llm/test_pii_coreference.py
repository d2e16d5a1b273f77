"""One thing, however it is written, has one surrogate; names keep their script."""

import re

import pytest

pytest.importorskip("tallyforge.llm")

from tallyforge.llm import pii  # noqa: E402


def test_mentions_of_one_entity(spark):
    said = [
        "Mr Hall; Mr. Hall; Dr John Hall; Mr John Hall; Mrs Peter-Hall; Mr Peter Hall",
        "4111 1111 1111 1111; 4111111111111111; 4111-1111-1111-1111",
        "Ann.Lee@Mail.example.com; ann.lee@mail.example.com; ANN.LEE@MAIL.EXAMPLE.COM",
        "+49 171 1234567; +491711234567; 0049 171 1234567; (555) 234-5678; +1 555 234 5678; 555-234-5678",
        "Dr Иванов; Herr Παπαδόπουλος; Mr Իսահակյան; Dr Иван Иванов",
    ]
    df = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace_pii(df, "key").collect()}
    names, cards, mails, phones, scripts = (got[i].text.split("; ") for i in range(5))
    surname = names[0].split()[1]
    assert surname != "Hall" and [x.replace("-", " ").split()[-1] for x in names] == [surname] * 6
    assert [x.split()[0] for x in names] == ["Mr", "Mr.", "Dr", "Mr", "Mrs", "Mr"]
    assert names[2].split()[1] == names[3].split()[1] != names[5].split()[1] and not re.search("John|Peter", got[0].text)
    assert cards[0] == " ".join(re.findall("....", cards[1])) and cards[2] == cards[0].replace(" ", "-") and cards[1] != "4111111111111111"
    assert mails[0] == mails[1] == mails[2].lower() and mails[2].isupper() and "ann" not in mails[1]
    digits = [re.sub(r"\D", "", x) for x in phones]
    assert digits[0] == digits[1] == digits[2][2:] and phones[2].startswith("0049 ") and digits[0] != "491711234567"
    assert digits[3] == digits[4][1:] == digits[5] != "5552345678" and re.fullmatch(r"\(\d{3}\) \d{3}-\d{4}", phones[3])
    assert re.fullmatch("Dr [А-Я][а-я]+", scripts[0]) and re.fullmatch("Herr [Α-Ω][α-ω]+", scripts[1]) and re.fullmatch("Mr [Ա-Ֆ][ա-և]+", scripts[2])
    assert scripts[3].split()[-1] == scripts[0].split()[-1] and re.fullmatch("[А-Я][а-я]+", scripts[3].split()[1])
    assert [got[i].n_entities for i in range(5)] == [6, 3, 3, 6, 4]
