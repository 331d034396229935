import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeglass.llm.leakage import folded, leaked_passages, leaks_by_item, passages, run_length, stream, tokens_at, without_openings, words_at

rng = random.Random(5)
VOCABULARY = [f"{a}{b}" for a in ("ka", "mi", "tor", "sel", "ran", "dul") for b in ("ber", "lin", "mok", "tas", "wer")]
ITEM = [rng.choice(VOCABULARY) for _ in range(60)]


def item(words, i=1):
    return without_openings([(i, " ".join(words))])


def own(words):
    return tuple((i, tuple(w), f) for i, w, f in item(words))


def brute(doc, words, passage=20, replaced=3):
    return any(sum(a != b for a, b in zip(doc[i : i + passage], words[j : j + passage])) <= replaced for i in range(len(doc) - passage + 1) for j in range(len(words) - passage + 1))


def test_run_length():
    assert run_length(20, 3) == 5 and run_length(20, 0) == 20


@pytest.mark.parametrize("seed", range(60))
def test_agrees_with_brute_force(seed):
    r = random.Random(seed)
    n = r.randint(14, 40)
    j = r.randint(0, 60 - n)
    part = ITEM[j : j + n]
    for k in r.sample(range(n), r.randint(0, 6)):
        part[k] = "zzz"
    doc = [r.choice(VOCABULARY) for _ in range(r.randint(0, 30))] + part + [r.choice(VOCABULARY) for _ in range(r.randint(0, 30))]
    assert bool(passages(" ".join(doc), own(ITEM), 20, 3)) == brute(doc, ITEM)


@pytest.mark.parametrize("change", [str.upper, lambda t: "> " + t.replace(" ", "\n> "), lambda t: "<p>" + t.replace(" ", " <b>", 1).replace(" ", "</b>&nbsp;", 3) + "</p>", lambda t: t.replace("a", "\u0430"), lambda t: t.replace(" ", "\u00a0"), lambda t: '{"prompt": "' + t.replace(" ", "\\n", 2) + '"}', lambda t: " ".join(f"`{w}`," for w in t.split()), lambda t: t.replace("k", "\u200bk")])
def test_forms_make_no_difference(change):
    text = "Before it. " + change(" ".join(ITEM[5:35])) + " After it."
    (found,) = passages(text, own(ITEM), 20, 3)
    assert found[1] >= 29 and words_at(text[found[2] : found[3]])[0][0] == ITEM[5]
    assert folded(text).split() == [w for w, _, _ in words_at(text)]


def test_shared_openings_do_not_count():
    opening = "You are given one repository and a question about it and you answer in one short paragraph without any code at all."
    known = without_openings([(1, opening + " " + " ".join(ITEM)), (2, opening + " " + " ".join(reversed(ITEM))), (3, " ".join(ITEM[:30])), (4, " ".join(ITEM[:30]))])
    assert [f for _, _, f in known] == [22, 22, 0, 0]
    assert passages(opening, tuple((i, tuple(w), f) for i, w, f in known), 20, 3) == []


def test_operator(spark):
    docs = spark.createDataFrame([(1, " ".join(ITEM), 0), (1, " ".join(ITEM), 0), (2, " ".join(ITEM[:19]), 0), (3, "", 0), (4, None, 0), (5, "x " * 50_000 + " ".join(ITEM[10:40]), 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, " ".join(ITEM), 0), (8, "too short", 0), (9, None, 0), (7, " ".join(ITEM), 0)], "item_id long, text string, doc_id int")
    for block in (1, 10):
        found = leaked_passages(docs, items, block=block)
        assert sorted((r.doc_id, r.item_id, r.item_words) for r in found.collect()) == [(1, 7, 60), (1, 7, 60), (5, 7, 30)]
    assert leaks_by_item(found).collect()[0].asDict() == {"item_id": 7, "documents": 2, "longest": 60}
    assert leaked_passages(docs, items.limit(0)).count() == 0 and leaked_passages(docs.limit(0), items).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["<br>", "</p>", "<", ">", "&", "&#10;", "&Tab;", "&eacute;", "&fjlig;", "&NotEqualTilde;", "&#0;", "&#x110000;", "\\n", "\\u00e9", "\\ud83d", "\\", "\u00b4", "\u00bd", "\u0130", "\ufb03", "e\u0301", "\u200b", "\u00ad", "\u3000"])), max_size=12))
def test_one_normaliser(parts):
    text = "".join(parts)
    tokens, starts, ends, blank = tokens_at(text)
    assert "".join(tokens) == stream(text) and len(tokens) == len(starts) == len(ends) == len(blank)
    assert all(0 <= a < b <= len(text) for a, b in zip(starts, ends)) and all(e <= s for e, s in zip(ends, starts[1:]))
    assert "".join(w for w, _, _ in words_at(text)) == stream(text) and all(tokens)
    passages(text + " " + " ".join(ITEM), own(ITEM), 20, 3)


THIRTY = ITEM[5:35]


def with_marks(mark):
    words = list(THIRTY)
    for k in (4, 12, 21):
        words[k : k + 2] = [words[k] + mark + words[k + 1], None]
    return " ".join(w for w in words if w)


@pytest.mark.parametrize("mark", ["<br>", "<br/>", "</p><p>", "\u2014", "\u2013", ",", "/", '<a href="' + "x" * 300 + '">', "&#10;", "&Tab;", "&mdash;", "\\n"])
def test_marks_without_blanks_are_no_words(mark):
    ((_, n, start, end),) = passages("don\u00b4t it\u00b4s l\u00b4a " + with_marks(mark) + " l\u00b4a", own(ITEM), 20, 3)
    assert n == 30 and words_at("don\u00b4t it\u00b4s l\u00b4a " + with_marks(mark))[3][1] == start and end > start


def test_hyphens_at_line_ends():
    words = list(THIRTY)
    for k in range(3, 30, 5):
        words[k] = words[k][:3] + "-\n" + words[k][3:]
    assert passages(" ".join(words), own(ITEM), 20, 3)[0][1] == 30


def test_exchanged_words_with_marks_stand_for_one_word():
    words = list(THIRTY[:20])
    words[5], words[11] = "snake-case", "and/or/but"
    assert passages(" ".join(words), own(ITEM), 20, 3)[0][1] == 20
    words[14] = words[17] = "zzz"
    assert passages(" ".join(words), own(ITEM), 20, 3) == []


def test_short_items_do_not_leak_by_their_opening():
    opening = "You are given one repository and a question about it and you answer in one short paragraph without any code at all."
    known = without_openings([(1, opening + " What is it?"), (2, opening + " Who calls it?"), (3, opening)])
    assert [f for _, _, f in known] == [22, 22, 0]
    assert passages(opening + " What is it?", tuple((i, tuple(w), f) for i, w, f in known[:2]), 20, 3) == []


def test_common_phrases_in_linear_time():
    text, began = " ".join(ITEM[:5] * 40_000), time.process_time()
    assert passages(text, own(ITEM), 20, 3) == []
    assert time.process_time() - began < 20


def test_openings_by_groups(spark):
    opening = " ".join(ITEM[:25]) + "."
    items = spark.createDataFrame([("a", opening + " " + " ".join(ITEM[25:50])), ("b", opening + " " + " ".join(ITEM[:1:-1])), ("c", " ".join(ITEM[30:60])), ("d", " ".join(ITEM[30:60]))], "item_id string, text string")
    docs = spark.createDataFrame([(1, opening), (2, " ".join(ITEM[20:50])), (3, " ".join(ITEM[30:60]))], "doc_id long, text string")
    want = [(2, "a", 25), (2, "c", 20), (2, "d", 20), (3, "a", 20), (3, "c", 30), (3, "d", 30)]
    for block in (1, 3, 100):
        assert sorted((r.doc_id, r.item_id, r.item_words) for r in leaked_passages(docs, items, block=block).collect()) == want
