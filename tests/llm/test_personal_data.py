import pytest

from logweave.llm import personal_data as pd

SAMPLES = [
    ("Contact: Ada Lovering, ada.lov+x@mail.example, +44 20 7946 0018.", ["name:Ada Lovering", "email:ada.lov+x@mail.example", "phone:+44 20 7946 0018"]),
    ("write to bo (at) post-team (dot) test now", ["email:bo (at) post-team (dot) test"]),
    ("cc BO.X [at] mail69.example", ["email:BO.X [at] mail69.example"]),
    ("Pinned to cache@v3.3 and retry@3x. Build 2026.01.11-544 is tagged @nightly-63.", []),
    ("Parcel 246 246 246 was scanned; Part no. 911-11-1371; Counter at +891 891 891 ticks; 10.0.208.190:8302", []),
    ("Call (202) 555-0122 and ask for Dee, Sandra if it hangs.", ["phone:(202) 555-0122", "name:Dee, Sandra"]),
    ('(tel 030/23125636) "x" (Ann B. Cole, 0049 (0)171 3920035)', ["phone:030/23125636", "name:Ann B. Cole", "phone:0049 (0)171 3920035"]),
    ("Ausweis-Nr. X5396637J, vorgelegt von W. Makel.", ["id_number:X5396637J", "name:W. Makel"]),
    ("SSN 930-40-1473 tax id 62 206 094 537 passport ZZ00 1653 3095 9034", ["id_number:930-40-1473", "id_number:62 206 094 537", "id_number:ZZ00 1653 3095 9034"]),
    ("He lives at 94 Otters Ave., Moor, 98032, she said.", ["address:94 Otters Ave., Moor, 98032"]),
    ("went to Flat 28, 177 Tarn Rd, Sant-Alboro.", ["address:Flat 28, 177 Tarn Rd, Sant-Alboro"]),
    ("wohnhaft Am Tarnring 153, 53393 Torne, Tel.", ["address:Am Tarnring 153, 53393 Torne"]),
    ("Holderstr. 19 in 57325 Au; au 87 bis avenue Kessel, 31186 Au-Bas; Avda. Pell, 68, 37909 Torne", ["address:Holderstr. 19 in 57325 Au", "address:87 bis avenue Kessel, 31186 Au-Bas", "address:Avda. Pell, 68, 37909 Torne"]),
    ("The state. - Mel Quill\nAs agreed, the run ended. As Kai Ulm put it: no.", ["name:Mel Quill", "name:Kai Ulm"]),
    ("ääöü 😀 Thanks Orso Wick!", ["name:Orso Wick"]),
    ("req-3488947821997 - Das Schema öffnete die Lade", []),
]


@pytest.mark.parametrize("text,want", SAMPLES)
def test_found(text, want):
    assert [f"{k}:{text[i:j]}" for k, i, j in pd.Finder().find(text)] == want


def test_edges():
    f = pd.Finder()
    assert f.find(None) == f.find("") == f.find("@") == f.find("(at)") == f.find(" | ") == []
    long = "x " * 200_000 + "mail a@b.example"
    assert f.find(long) == [("email", len(long) - 11, len(long))]
    assert f.find("İ" * 5 + " cc a@b.example")[0][1:] == (9, 20)


def test_tables(spark):
    t = spark.createDataFrame([("documents", 1, "cc a@b.example", 7), ("documents", 2, None, 7), ("capture_lines", 1, "cc a@b.example", 7), ("documents", None, "", 7)], "tbl string, row_id long, text string, start_pos int")
    assert sorted(map(tuple, pd.find_personal_data(t).collect())) == [("capture_lines", 1, "email", 3, 14), ("documents", 1, "email", 3, 14)]
    out = pd.replace_personal_data(t).collect()
    assert sorted((r.tbl, r.row_id or 0, r.text or "", r.findings) for r in out) == [("capture_lines", 1, "cc [EMAIL]", 1), ("documents", 0, "", 0), ("documents", 1, "cc [EMAIL]", 1), ("documents", 2, "", 0)]
    assert pd.find_personal_data(t.limit(0)).count() == 0


def test_rewritten_text_holds_nothing_more():
    f = pd.Finder()
    for text, _ in SAMPLES:
        parts, at = [], 0
        for k, i, j in f.find(text):
            parts += [text[at:i], f"[{k.upper()}]"]
            at = j
        assert f.find("".join(parts) + text[at:]) == []


PLAIN = [
    ("SSN is 930401473", ["id_number:930401473"]),
    ("BSN 123456782 and nif: 123.456.789", ["id_number:123456782", "id_number:123.456.789"]),
    ("Pay to DE89 3704 0044 0532 0130 00 by noon.", ["id_number:DE89 3704 0044 0532 0130 00"]),
    ("At offset 681. tel:+44 7700 900113", ["phone:+44 7700 900113"]),
    ("my number is +1 202 555 0181 2026-03-11T18:28:26Z", ["phone:+1 202 555 0181"]),
    ("x" * 300 + "y.z@mail.example", ["email:" + "x" * 300 + "y.z@mail.example"]),
]


@pytest.mark.parametrize("text,want", PLAIN)
def test_other_forms(text, want):
    assert [f"{k}:{text[i:j]}" for k, i, j in pd.Finder().find(text)] == want


def test_learnt_names(spark):
    said = [f"Thanks to {g} {f}, who came." for g in ("Maria", "Peter", "Sarah") for f in ("Lopez", "Schmidt", "Connor")]
    t = spark.createDataFrame([("documents", i, x) for i, x in enumerate(said + [None, "", "Cc: Only Once"])], "tbl string, row_id long, text string")
    given, family = pd.learn_names(t)
    assert (given, family) == ({"maria", "peter", "sarah"}, {"lopez", "schmidt", "connor"})
    f = pd.Finder(given, family)
    for text, want in (
        ("Yesterday Maria Lopez called Peter J. Schmidt about it", ["Maria Lopez", "Peter J. Schmidt"]), ("I met with S. Connor in Berlin", ["S. Connor"]), ("Connor, Sarah came", ["Connor, Sarah"]),
        ("maria lopez and PETER LOPEZ", ["maria lopez", "PETER LOPEZ"]), ("Connor Street, Lopezville, peter@connor.example", []), ("Peter and Connor", []),
    ):
        assert [text[i:j] for k, i, j in f.find(text) if k == "name"] == want
    assert pd.learn_names(t.limit(0)) == (frozenset(), frozenset())


def test_names_are_learnt_from_all_texts(spark):
    family = [f"Lop{a}{b}z" for a in "aeiou" for b in "rstv"]
    name = "concat('Thanks to Maria ', element_at(split('" + " ".join(family) + "', ' '), CAST(id % 20 AS INT) + 1), ', who came.')"
    t = spark.range(600_000).selectExpr("'documents' AS tbl", "id AS row_id", f"CASE WHEN id < 60 THEN {name} ELSE '' END AS text")
    assert pd.learn_names(t) == ({"maria"}, {x.lower() for x in family})


def test_every_name_seen_often_is_learnt(spark, monkeypatch):
    monkeypatch.setattr(pd, "LEXICON", 2, raising=False)  # no number of names is the most
    said = [f"Thanks to {g} {f}, who came." for g in ("Maria", "Peter", "Sarah") for f in ("Lopez", "Schmidt", "Connor")]
    t = spark.createDataFrame([("documents", i, x) for i, x in enumerate(said)], "tbl string, row_id long, text string")
    assert pd.learn_names(t) == ({"maria", "peter", "sarah"}, {"lopez", "schmidt", "connor"})
