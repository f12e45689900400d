import pytest

from casemill.llm import pii


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("account number: 123456789012", "123456789012"),
        ("account no: 12345678", "12345678"),
        ("Passport No. X1234567 was", "X1234567"),
        ('{"password": "hunter2xyz9"}', "hunter2xyz9"),
        ("iban: DE89 3704 0044 0532 0130 00 is mine", "DE89 3704 0044 0532 0130 00"),
        ("IBAN GB29 NWBK 6016 1331 9268 19.", "GB29 NWBK 6016 1331 9268 19"),
        ("account: 1234 5678 9012 and", "1234 5678 9012"),
        ("password: P@ss1word99, then", "P@ss1word99"),
        ("ssn: 123-45-6789", "123-45-6789"),
    ],
)
def test_account_forms(text, value):
    assert [text[a:b] for a, k, b in pii.spans(text) if pii.KINDS[k] == "account"] == [value]


def test_no_account():
    for text in ("account nothing much", "token ring", "account number", "password: secretive"):
        assert [s for s in pii.spans(text) if pii.KINDS[s[1]] == "account"] == []
