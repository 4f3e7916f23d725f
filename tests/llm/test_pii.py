from siftwood.llm import pii as I


def spans(finder, text):
    return [I.squeezed(text[a:b]) for a, b in finder(text)]


def test_emails():
    for text, want in (
        ("Reach me at a.b+c@mail.example.net, please.", "a.b+c@mail.example.net"), ("mailto:ann AT x-labs (dot) test", "ann AT x-labs (dot) test"), ("owner=k.m at cobalt dot example;", "k.m at cobalt dot example"),
        ("(ask ann_1 [at] example[.]com)", "ann_1 [at] example[.]com"), ("<ANN@EXAMPLE.COM>", "ANN@EXAMPLE.COM"),
    ):
        assert spans(I.emails, text) == [want]
    for text in ("Clone with git@slate.example:lattice/config.git", "Pinned to pkg@3.22.8", "`@cached` goes above", "look at utils.py", "https://user:pw@host.example/x", "meet at noon"):
        assert spans(I.emails, text) == [], text


def test_phones():
    for number in (
        "415-555-0108", "(415) 555-0138", "212.555.0177", "+1 212 555 0151", "1-808-555-0124 x383", "+13035550185", "+44 1632 960509", "+44 (0)7700 900 564", "07700 900361", "030 23125 342", "(040) 66969 987",
        "+49 (0)30 23125-719", "0171 3920070", "0049 89 99998 641", "01 99 00 88 83", "06.39.98.20.98", "+33 (0)6 39 98 75 76", "0034 925 553495", "(+34) 667-555-842",
    ):
        assert spans(I.phones, f"Call {number} after nine.") == [number], number
    assert spans(I.phones, "mobil 0199001021") == ["0199001021"]
    for text in ("Build 331-4992-6604 is green", "checksum 0937837931 / 22", "ticket 016-71/6360", "10.82.92.18 answered", "Row 44699939-4 of x holds 265537", "2024-10-12T12:50:20Z", "trace 78b38b40-0191-4616-9f00-55522905f8b9"):
        assert spans(I.phones, text) == [], text


def test_id_numbers_and_addresses():
    for text, want in (
        ("SSN: 747-46-4864", "747-46-4864"), ("my social security number (743-98-1601) is", "743-98-1601"), ("Passport=LH4233316", "LH4233316"), ('"ID card": "XN5054628"', "XN5054628"), ("Meine Steuer-ID 42 502 428 060 steht", "42 502 428 060"),
        ("Mon NIR (1 95 01 72 356 241 03) est", "1 95 01 72 356 241 03"), ("Mi D.N.I. (66819208E) sale", "66819208E"), ("DNI: 26913618-F", "26913618-F"), ("n° de sécurité sociale : 199110863152350", "199110863152350"),
    ):
        assert spans(I.id_numbers, text) == [want], text
    assert spans(I.id_numbers, "Row 85901026-0 of the passport table") == []
    for text, want in (
        ("at 198 Tannery Street, Wexcombe QX10 9BE again", "198 Tannery Street, Wexcombe QX10 9BE"), ("6 Cobbler's Avenue, Apt 9, Port Sallow, OR 34639 and", "6 Cobbler's Avenue, Apt 9, Port Sallow, OR 34639"),
        ("131 Alderwick Rd #5\nNorbury Falls, VT 11648", "131 Alderwick Rd #5 Norbury Falls, VT 11648"), ("an Lindenstr. 90, D-87622 Bad Grönau schicken", "Lindenstr. 90, D-87622 Bad Grönau"),
        ("au 93 bis, avenue du Vieux Moulin, 86877 Castelnoux jeudi", "93 bis, avenue du Vieux Moulin, 86877 Castelnoux"), ("a C/ de la Fuente, 112, 3.º B, 36340 San Ibarzo.", "C/ de la Fuente, 112, 3.º B, 36340 San Ibarzo"),
    ):
        assert spans(I.addresses, text) == [want], text
    assert spans(I.addresses, "Markers 29 Lane, 36 Street and 39 Court are table headings. Path 64, 40734 lines") == []


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kind string")


PEOPLE = ["Reviewed-by: Edwin Kestrow", "Signed-off-by: KESTROW, Edwin <ek@x.example>", "I paired with Ivy M. Vensk Jr. on it.", "Hi Ivy Kestrow, any news?", "As E. Vensk noted, the cache is cold.", "Hi Edwin Vensk, hi", "by Ivy Vensk"]


def test_names_come_from_the_corpus(spark):
    rows = [(i, t) for i, t in enumerate(PEOPLE)] + [(100 + i, "Blast Radius counts. A Context Packet cites. Port Orange is new.") for i in range(30)]
    rows += [(200, "Edwin Kestrow-Vensk\nfor the trace"), (201, None), (202, ""), (203, " \n"), (204, "Ivy\tVensk and Ivy Vensk"), (204, "Ivy\tVensk and Ivy Vensk"), (205, "raven31: Kestrow is away")]
    got = {(r.doc_id, r.kind, r.found) for r in I.found(frame(spark, rows)).collect()}
    assert got == {
        (0, "name", "Edwin Kestrow"), (1, "name", "KESTROW, Edwin"), (1, "email", "ek@x.example"), (2, "name", "Ivy M. Vensk Jr."), (3, "name", "Ivy Kestrow"), (4, "name", "E. Vensk"),
        (5, "name", "Edwin Vensk"), (6, "name", "Ivy Vensk"), (200, "name", "Edwin Kestrow-Vensk"), (204, "name", "Ivy Vensk"),
    }
    assert I.found(frame(spark, rows)).count() == len(got)
    done = {r.doc_id: (r.text, r.n_replaced) for r in I.sanitized(frame(spark, rows)).collect()}
    assert done[1] == ("Signed-off-by: [NAME] <[EMAIL]>", 2) and done[204] == ("[NAME] and [NAME]", 2) and done[201] == (None, 0) and done[100][1] == 0


def test_empty(spark):
    assert I.found(frame(spark, [])).count() == 0
    assert I.sanitized(frame(spark, [])).count() == 0


def test_sanitized_by_offset(spark):
    rows = [(i, t) for i, t in enumerate(PEOPLE)] + [(100 + i, "Blast Radius counts. A Context Packet cites.") for i in range(30)]
    rows += [(None, "Contact: Edwin Kestrow <anna.keller@x.example>"), (None, "Contact: Edwin Kestrow <anna.keller@x.example>"), (300, "write to a@b.example, not ba@b.example, or a@b.example"), (None, None), (None, "")]
    got = I.sanitized(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert [r.text for r in got if r.doc_id is None and r.text] == ["Contact: [NAME] <[EMAIL]>"] * 2
    one = next(r for r in got if r.doc_id == 300)
    assert one.text == "write to [EMAIL], not [EMAIL], or [EMAIL]" and one.n_replaced == 3
    assert [(s.kind, rows[[r[0] for r in rows].index(300)][1][s.start : s.stop]) for s in one.spans] == [("email", "a@b.example"), ("email", "ba@b.example"), ("email", "a@b.example")]
    # a second pass finds nothing, and what lies outside the spans is as it was
    again = frame(spark, [(r.doc_id, r.text) for r in got])
    assert sum(r.n_replaced for r in I.sanitized(again).collect()) == 0
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(t)
    for r in got:
        if r.n_replaced:
            assert any(r.text == I.masked(t, [(s.start, s.stop, s.kind) for s in r.spans]) for t in texts[r.doc_id] if t)


def test_long_local_parts_and_distant_words():
    local = "a" * 300
    assert spans(I.emails, f"to {local}@x.example now") == [f"{local}@x.example"]
    assert spans(I.id_numbers, "passport number:" + " " * 90 + "LH4233316") == ["LH4233316"]
    name = " ".join(["Longward" * 12] * 3)
    assert spans(I.addresses, f"at 198 {name} Street, Wexcombe QX10 9BE") == [f"198 {name} Street, Wexcombe QX10 9BE"]
