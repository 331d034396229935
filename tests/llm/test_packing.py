from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from lodeglass.llm.packing import fill, load_encoding, pack_documents, pack_items, plan_containers, public_vocabulary


def best_fit_decreasing(lengths, capacity):
    free = []
    for x in sorted(lengths, reverse=True):
        fits = [k for k, f in enumerate(free) if f >= x]
        if fits:
            k = min(fits, key=lambda k: free[k])
            free[k] -= x
        else:
            free.append(capacity - x)
    return len(free)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=200))))
def test_plan_is_best_fit_decreasing(case):
    capacity, lengths = case
    slots, n = plan_containers(Counter(lengths), capacity)
    used, placed = Counter(), Counter()
    for s in slots:
        placed[s.length] += s.count * s.each
        for i in range(s.count):
            used[s.container + i] += s.each * s.length
    assert placed == Counter(lengths) and len(used) == n and all(v <= capacity for v in used.values())
    assert n == best_fit_decreasing(lengths, capacity)


def test_slots_are_taken_once(spark):
    lengths = [7] * 500 + [3] * 77 + [10] * 3 + list(range(1, 11)) * 5
    items = spark.createDataFrame([(i, x, -1) for i, x in enumerate(lengths)], "id long, size int, container int")
    rows = pack_items(items, 10, key=("id",), size="size", group_rows=20).collect()
    assert len(rows) == len(lengths)
    by = {}
    for r in rows:
        by.setdefault(r.container, []).append(r)
    for content in by.values():
        content.sort(key=lambda r: r.position)
        assert [r.position for r in content] == list(range(len(content))) and sum(r["size"] for r in content) <= 10
        assert all(r.offset == sum(x["size"] for x in content[:k]) for k, r in enumerate(content))
    assert len(by) == best_fit_decreasing(lengths, 10)


def test_documents(spark):
    long = "größere Prüfung 😀 word " * 2000
    docs = spark.createDataFrame([(1, "a few words", 0), (1, "a few words", 0), (2, "", 0), (3, None, 0), (4, long, 0), (5, "x " * 100, 0)], "doc_id long, text string, tokens int")
    rows = pack_documents(docs, capacity=256).collect()
    encoding = load_encoding(*public_vocabulary())
    assert sorted({r.doc_id for r in rows}) == [1, 4, 5] and sum(r.doc_id == 1 for r in rows) == 2
    pieces = sorted((r for r in rows if r.doc_id == 4), key=lambda r: r.piece_no)
    data = long.encode()
    assert b"".join(data[p.start_byte : p.end_byte] for p in pieces) == data and all(p.tokens <= 256 for p in pieces)
    assert all(data[p.start_byte : p.end_byte].decode() for p in pieces) and sum(p.tokens for p in pieces) == len(encoding.encode_ordinary(long))
    assert all(v <= 256 for v in Counter({c: sum(r.tokens for r in rows if r.container == c) for c in {r.container for r in rows}}).values())
    one = fill(pack_documents(docs, capacity=256), 256).first()
    assert one.containers >= one.least
    assert pack_documents(docs.limit(0)).count() == 0
