from hypothesis import given, settings
from hypothesis import strategies as st

from lodeglass.llm.pieces import blind_pieces, cut_pieces, split_oversized


def covers(data, pieces, limit, overlap):
    end = 0
    for k, (a, own, b) in enumerate(pieces):
        assert own == end and b - a <= limit and own - a <= overlap and b > own and (k or a == 0)
        data[a:b].decode("utf-8")
        end = b
    assert end == len(data)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab {}\n\t(é€😀#;", max_size=600), st.integers(8, 80), st.integers(0, 4), st.booleans())
def test_covered_without_cut_characters(text, limit, overlap, headings):
    data = text.encode()
    covers(data, cut_pieces(data, limit, overlap, headings), limit, overlap)


def test_between_declarations():
    data = "".join(f"// about {i}\nfunction f{i}() {{\n  a();\n\n  b();\n}}\n\n" for i in range(40)).encode()
    pieces = cut_pieces(data, 300, 60)
    covers(data, pieces, 300, 60)
    assert all(data[own : own + 8] == b"// about" for _, own, _ in pieces)


def test_headings():
    data = b"".join(b"# Part %d\n\ntext\n\n## Sub\n\n- item\n  more\n" % i for i in range(30))
    assert all(data[own : own + 6] == b"# Part" for _, own, _ in cut_pieces(data, 200, 0, True))


def test_one_long_line():
    data = b"function a(){return 1};" * 500
    pieces = cut_pieces(data, 1000, 100)
    covers(data, pieces, 1000, 100)
    assert all(data[own - 1 : own] in (b"}", b";") for _, own, _ in pieces[1:])


def test_blind():
    assert blind_pieces(25, 10, 2) == [(0, 0, 8), (6, 8, 16), (14, 16, 24), (22, 24, 25)]


def test_operator(spark):
    big = "x = 1\n" * 5000
    contents = spark.createDataFrame([(1, "a.py", big, 0), (1, "a.py", big, 0), (2, "b.py", "x", 0), (3, "c.py", None, 0), (None, "d.py", big, 0), (4, "e.py", "é" * 12_000, 0), (5, "f.py", "é" * 12_001, 0)], "file_id long, path string, content string, piece_no int")
    symbols = spark.createDataFrame([("s", 1, 6, 29_000, 0), ("s", 1, 6, 29_000, 0), ("t", 1, 0, 24_000, 0), ("u", 3, 0, 30_000, 0), ("v", 1, 10_000, 60_000, 0), ("w", None, 0, 25_000, 0), ("x", 1, None, 5, 0)], "id string, file_id long, start_byte int, end_byte int, text int")
    rows = split_oversized(contents, symbols).collect()
    by = {}
    for r in rows:
        by.setdefault((r.item_kind, r.item_key), []).append(r)
    assert set(by) == {("file", "1"), ("file", "5"), ("symbol", "s"), ("symbol", "u"), ("symbol", "v"), ("symbol", "w")}
    for (kind, key), pieces in by.items():
        pieces.sort(key=lambda r: r.piece_no)
        start, end = {"1": (0, 30_000), "5": (0, 24_002), "s": (6, 29_000), "u": (0, 30_000), "v": (10_000, 60_000), "w": (0, 25_000)}[key]
        assert pieces[0].start_byte == start and pieces[-1].end_byte == end and all(a.end_byte == b.own_start_byte for a, b in zip(pieces, pieces[1:]))
        assert all((p.text is None) == (key in "uvw") and p.end_byte - p.start_byte <= 24_000 and p.own_start_byte - p.start_byte <= 8_000 for p in pieces)
    assert split_oversized(contents.limit(0), symbols.limit(0)).count() == 0


def test_siblings_merge_and_opened_subtrees_stay_apart():
    small = "".join(f"def s{i}():\n    return {i}\n" for i in range(3))
    large = "class L:\n" + "".join(f"    def m{i}(self):\n        return {i}\n" for i in range(30))
    data = (small + large + small).encode()
    pieces = cut_pieces(data, 200, 0)
    covers(data, pieces, 200, 0)
    at = data.find(b"class L"), data.rfind(b"def s0")
    assert {own for _, own, _ in pieces} >= set(at)  # the head of the class goes with its first methods, its end with none of the functions behind it
    assert all(data[own:].lstrip().startswith((b"def ", b"class ")) for _, own, _ in pieces)


def test_elements_and_underlined_headings():
    html = ("<ul>\n" + "<li>\n<b>x</b>\n<br>\n</li>\n" * 40 + "</ul>\n").encode()
    pieces = cut_pieces(html, 120, 0, False, True)
    covers(html, pieces, 120, 0)
    assert all(html[own : own + 4] == b"<li>" for _, own, _ in pieces[1:])
    text = b"".join(b"Part %02d\n=======\n\nSome words here.\n\n" % i for i in range(30))
    assert all(text[own : own + 4] == b"Part" for _, own, _ in cut_pieces(text, 150, 0, True))
