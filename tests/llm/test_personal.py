import pytest

from lodeglass.llm.personal import personal_spans, redact_personal, redacted, spans

FOUND = {
    "email": ["Mail it to a.b+c@kelp-mail.co.example, please", "<Mira.Elm@HARBOR.INVALID> said", "reach oria at dune-mail dot co dot example now", "x-y(at)pebble[dot]test", "a.b [at] fjord.invalid."],
    "phone": ["Call +1 602 555 0146 now", "Text 555-0135 if", "tel 030 23125 321", "number is +33.1.99.00.37.54 this", "Call (555) 013-0137", "On-call number is 1-202-555-0175 ext. 360 this", "Phone: 01 99 00 55 31", "unter +49-30-23125738."],
    "id_number": ["my SSN 908-42-3703.", "Row 3 shows QQ 94 96 65 B in the national insurance no. column", "tax id: 00006677T", "Steuer-ID=04308395186", "passport no. X00526624"],
    "address": ["Address: Flat 8, 336 Nabrbrook Close, Harrowmere", "at 84 Thornhollow Street, Drevenau 95169 Please", "to 79 rue des Ashbrooks, 24882 Valmorin.", "Oskwallstraße 93b, 78362 Villaroja", "Calle del Marrbrook 77, 39459 Quillbury", "Am Gravbrook 50, 94790 Quillbury", "652 Zimbrook St Apt 39, Saint-Orbec"],
    "name": ["Thanks to Velya Dreuinez for", "I talked to ORIA NABRMERE about", "Haldaro Thornovic wrote on Monday:", "Reported by Saelor Thorninez-Thornmere.", "Regards, O. Ashek", "Grüße, Pelléau, Tamika", "My colleague Haldia E. Gravek sees", "Signed-off-by: Zoraro Valthaven Expected: the"],
}
NOT_FOUND = ["git@git.nimbus.invalid:cobalt/delta.git", "pinned @tundra/harbor-gateway@817.460.0 by hand", "Set notify@channel in the template", "Use the @param and @returns tags, not @author.", "The ticket number is 699-732-110 and the run id ended in 368958272.", "Offset 20 7946 0 1 is printed", "Build 900-12-4410b was tagged at 1735689600.", "Lane 9 of Queue Street Fighter mode stays disabled", "The range 555 to 9120 is reserved", "Version 693.719.938 still", "logo@2x.png", "Thanks to the nightly run", "Call `resolveState` only when", "https://user:pw@host.invalid/x"]


@pytest.mark.parametrize("kind,text", [(k, t) for k, v in FOUND.items() for t in v])
def test_found(kind, text):
    assert [k for _, _, k in spans(text)] == [kind], spans(text)


@pytest.mark.parametrize("text", NOT_FOUND)
def test_not_found(text):
    assert spans(text) == []


def test_bounds_and_placeholders():
    text = "Signed-off-by: Zoraro Valthaven Expected. Mail a.b@c.test; call +44 20 7946 0408."
    assert redacted(text, spans(text)) == "Signed-off-by: [NAME] Expected. Mail [EMAIL]; call [PHONE]."


def test_long_text():
    text = "word " * 200_000 + "Call 555-0135 now " + "@" * 1000
    assert [k for _, _, k in spans(text)] == ["phone"]


def test_operator(spark):
    docs = spark.createDataFrame([(1, "a\nCall 555-0135 now\r\nSSN 908-42-3703", 9), (1, "a\nCall 555-0135 now\r\nSSN 908-42-3703", 9), (2, "", 9), (3, None, 9)], "doc_id long, text string, pii_found int")
    assert sorted((r.doc_id, r.pii_kind, r.line_no) for r in personal_spans(docs).collect()) == [(1, "id_number", 3), (1, "id_number", 3), (1, "phone", 2), (1, "phone", 2)]
    out = {r.doc_id: (r.text, r.pii_found) for r in redact_personal(docs).collect()}
    assert out == {1: ("a\nCall [PHONE] now\r\nSSN [ID_NUMBER]", 2), 2: ("", 0), 3: (None, None)}
    assert personal_spans(docs.limit(0)).count() == 0 and redact_personal(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text, kind, value", [
    ("Contact John Smith today", "name", "John Smith"), ("My name is Anna Kowalska.", "name", "Anna Kowalska"), ("as Maria Garcia pointed out", "name", "Maria Garcia"), ("from: José Nuñez", "name", "José Nuñez"), ("Please ask Li Wei", "name", "Li Wei"),
    ("at 12 High Street, London NW1 6XE today", "address", "12 High Street, London NW1 6XE"), ("I left a message at 2025550141 yesterday", "phone", "2025550141"), ("Row 3 shows 00008022M in the national id column", "id_number", "00008022M"),
])
def test_context_and_shape(text, kind, value):
    assert [(k, text[a:b]) for a, b, k in spans(text)] == [(kind, value)]


def test_numbers_of_one_digit_are_none():
    assert spans("SSN 000-00-0000 and passport no. X00000000") == []


def test_many_finds_in_one_text():
    text = "Call 555-0135 now, mail a.b@c.test. " * 4000
    assert len(spans(text)) == 8000
