import random
import re

import pytest

from siftwood.llm import splitting as S


def brute_boundary(text, limit=512):
    if (len(text.encode()) + 3) // 4 <= limit:
        return None
    size = lambda t: (len(t.encode()) + 3) // 4
    lines, runs, run = text.split("\n"), [], []
    for x in lines:
        if x.strip(" \t\r"):
            run.append(x)
        else:
            runs.append(run)
            run = []
    runs.append(run)
    if all(size("\n".join(r)) <= limit for r in runs):
        return "blank"
    return "line" if all(size(x) <= limit for x in lines) else "inside"


def make(rng, n):
    out = []
    while sum(map(len, out)) < n:
        kind = rng.random()
        if kind < 0.12:
            out.append(rng.choice(["\n", "  \n", "\r\n", "\t\r\n"]))
        elif kind < 0.16:
            out.append("x" * rng.randint(1, 2600))
        elif kind < 0.2:
            out.append("日本語のテキスト。" * rng.randint(1, 120))
        else:
            out.append(" ".join("word" * rng.randint(1, 3) for _ in range(rng.randint(1, 14))) + rng.choice(["\n", "\r\n", ". ", "\n"]))
    return "".join(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    rows = [(i, make(rng, rng.choice([300, 2040, 2100, 5000, 40000])), 10) for i in range(40)]
    rows += [(100, None, 1), (101, "", 1), (102, "y" * 2048, 1), (103, "y" * 2049, 1), (104, "\n" * 3000, 1), (105, "é" * 30000, None)]
    rows += [(106, ("a" * 100 + "\n") * 30, 1), (106, ("a" * 100 + "\n") * 30, 1)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "other") for r in rows], "chunk_id long, text string, start_line int, boundary string")


@pytest.mark.parametrize("range_bytes", [S.RANGE_BYTES, 700, 1 << 20])
def test_boundaries_against_brute_force(spark, texts, range_bytes):
    got = {r.chunk_id: r.boundary for r in S.boundaries(frame(spark, texts), range_bytes=range_bytes).collect()}
    want = {k: b for k, t, _ in texts if t and (b := brute_boundary(t))}
    assert got == want


def pieces(spark, rows, **options):
    out = {}
    for r in S.split_oversized(frame(spark, rows), **options).collect():
        out.setdefault(r.chunk_id, []).append(r)
    return {k: sorted(v, key=lambda r: r.piece_no) for k, v in out.items()}


@pytest.mark.parametrize("overlap", [0, 32])
def test_pieces_cover_the_text_and_do_not_depend_on_ranges(spark, texts, overlap):
    one = pieces(spark, texts, overlap_tokens=overlap, range_bytes=1 << 20)
    many = pieces(spark, texts, overlap_tokens=overlap)
    assert one == many
    whole = {k: (t, s) for k, t, s in texts}
    for k, rows in one.items():
        raw = whole[k][0].encode()
        assert [r.piece_no for r in rows] == list(range(len(rows)))
        assert rows[0].start_byte == 0 and rows[-1].end_byte == len(raw)
        for a, b in zip(rows, rows[1:], strict=False):
            assert b.start_byte <= a.end_byte < b.end_byte
            assert a.end_byte - b.start_byte <= overlap * 4
        for r in rows:
            assert (r.end_byte - r.start_byte + 3) // 4 <= 512
            assert r.text.encode() == raw[r.start_byte : r.end_byte]
            assert r.start_line == (whole[k][1] or 1) + raw[: r.start_byte].count(b"\n")
    assert set(one) == {k for k, t, _ in texts if t and len(t.encode()) > 2048}


def test_cuts_at_blank_lines_where_there_are_any(spark):
    text = "\n\n".join("line of text\n" * 40 for _ in range(12))
    rows = pieces(spark, [(1, text, 1)], overlap_tokens=0)[1]
    assert all(re.search(r"\n\n$", r.text) for r in rows[:-1])


def test_files_by_range(spark, tmp_path):
    rng = random.Random(2)
    text = make(rng, 90000)
    path = tmp_path / "big.txt"
    path.write_bytes(text.encode())
    got = S.split_files(spark, [(str(path), len(text.encode()))], range_bytes=16384).orderBy("piece_no").collect()
    want = pieces(spark, [(1, text, 1)])[1]
    assert [(r.start_byte, r.end_byte, r.text, r.start_line) for r in got] == [(r.start_byte, r.end_byte, r.text, r.start_line) for r in want]


def test_empty_table(spark):
    assert S.boundaries(frame(spark, [])).count() == 0
    assert S.split_oversized(frame(spark, [])).count() == 0


def test_summaries_join_wherever_a_text_is_cut():
    rng = random.Random(8)
    for _ in range(400):
        text = "".join(rng.choice(["\n", " \n", "\t", "ab", " ", "\r\n", "x" * 9]) for _ in range(rng.randint(1, 40))).encode()
        cuts = sorted({0, len(text), *(rng.randint(0, len(text)) for _ in range(5))})
        whole = None
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = S.summary(text[a:b])
            whole = part if whole is None else S.stitched(whole, part)
        for limit in (1, 2, 3, 5):
            got = S._kind(whole, limit)
            size = lambda t: (len(t) + 3) // 4
            runs = [r.strip(b"\0") for r in re.split(rb"\0+", b"\n".join(x if x.strip(b" \t\r") else b"\0" for x in text.split(b"\n")))]
            runs = [r.removeprefix(b"\n").removesuffix(b"\n") for r in runs]
            want = "blank" if all(size(r) <= limit for r in runs) else "line" if all(size(x) <= limit for x in text.split(b"\n")) else "inside"
            assert got == want, (text, limit)


def test_maps_compose():
    rng = random.Random(9)
    text = make(rng, 60000) + "z" * 30000 + "日本" * 6000
    raw, size, n = text.encode(), 8192, 2048
    maps = []
    for a in range(0, len(raw), size):
        at = max(0, a - n - 8)
        b = min(a + size, len(raw))
        maps.append(S.Cutter(raw[at : b + n + 8], at, a, b, len(raw), n, 128).table())
    assert max(map(len, maps)) < 700
    whole = maps[0]
    first, count = S._at(maps[0], 0)
    for m in maps[1:]:
        whole = S.composed(whole, m)
        first, more = S._at(m, first)
        count += more
        assert S._at(whole, 0) == (first, count)
    for i in range(1, len(maps) - 1):
        both = S.composed(maps[i], maps[i + 1])
        for s in range(i * size, i * size + n):
            if (raw[s] & 0xC0) != 0x80:
                mid, one = S._at(maps[i], s)
                end, two = S._at(maps[i + 1], mid)
                assert S._at(both, s) == (end, one + two)


def test_null_and_repeated_keys(spark):
    a, b = "a" * 3000, "b\n" * 2000
    rows = [(None, a, 1), (None, a, 1), (None, b, 1), (7, a, 1), (7, a, 5), (7, a, 1)]
    told = S.boundaries(frame(spark, rows)).collect()
    assert sorted((r.chunk_id or 0) for r in told) == [0, 7]
    got = pieces(spark, rows)
    assert set(got) == {None, 7}
    assert [r.piece_no for r in got[7]] == list(range(len(got[7]))) and got[7][0].start_line == 1
    assert [r.piece_no for r in got[None]] == list(range(len(got[None])))
