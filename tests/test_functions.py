"""Unit tests of column functions on literal rows, including the semantic traps."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import dialog as DG
from lectern.functions import links as L
from lectern.functions import paths as P
from lectern.functions import text as T


def one(spark, col, value, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(col(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("path,sem,subj", [
    ("data/semester_3/data_structures/unit2_slides.pptx", 3, "Data Structures"),
    ("data/Semester-4/os/x.pdf", 4, "Os"),
    ("data/5/compiler_design/ch1.pdf", 5, "Compiler Design"),
    ("data/semester_2/file.pdf", 2, "unknown"),               # semester part followed by the file
    ("data/semester_1/semester_6/algo/x.pdf", 6, "Semester 6"),  # last semester wins; subject after first
    ("misc/7/x/y.pdf", 0, "unknown"),                         # bare number not under data
    ("notes/x.pdf", 0, "unknown"),
])
def test_path_metadata(spark, path, sem, subj):
    assert one(spark, P.semester_from_path, path) == sem
    assert one(spark, P.subject_from_path, path) == subj


@pytest.mark.parametrize("name,unit", [
    ("unit2_slides.pptx", 2), ("Unit-3_Networks.pptx", 3), ("Module_1.pptx", 1), ("ch4_overview.pptx", 4),
    ("chapter 7.pdf", 7), ("u5_notes.pdf", 5), ("batch_2.pdf", 2),   # T11: 'ch' inside 'batch'
    ("unit0_x.pdf", 0), ("lecture.pdf", 0)])
def test_unit_from_filename(spark, name, unit):
    assert one(spark, P.unit_from_filename, name) == unit


@pytest.mark.parametrize("text,unit", [
    ("Unit 3: Trees", 3), ("UNIT IV graphs", 4), ("Module 2 intro", 2), ("unit ix", 1),
    ("each unit in the course", 1), ("unit iiii then module 5", 5), ("unit-vii", 7), ("nothing", 0)])
def test_unit_from_content(spark, text, unit):  # T8 compat behaviour
    assert one(spark, P.unit_from_content, text) == unit


def test_subject_display_initcap_deviation(spark):  # T9
    assert one(spark, T.subject_display, "design_and_analysis-of_algorithms") == "Design And Analysis Of Algorithms"
    assert one(spark, T.subject_display, "2nd_o'neil") == "2nd O'neil"


@pytest.mark.parametrize("name,safe", [("  Data Structures & Algo! ", "data_structures_algo"),
                                      ("Réseaux  Avancés", "réseaux_avancés"), ("a-b_c", "a-b_c")])
def test_safe_name(spark, name, safe):  # T21: Unicode word characters kept
    assert one(spark, T.safe_name, name) == safe


@pytest.mark.parametrize("url,did,kind", [
    ("https://drive.google.com/drive/folders/AbC_1-x?usp=s", "AbC_1-x", "folder"),
    ("https://drive.google.com/file/d/F123/view", "F123", "file"),
    ("https://drive.google.com/open?id=Q9", "Q9", "file"),
    ("https://example.org/x", None, None),
    ("/folder-viewer?url=https%3A%2F%2Fdrive.google.com%2Fdrive%2Ffolders%2FZ", None, None)])  # T13
def test_drive_id(spark, url, did, kind):
    r = one(spark, L.drive_id, url)
    assert (r["drive_id"], r["drive_type"]) == (did, kind)


@pytest.mark.parametrize("name,cls", [("Unit 1 notes", "unit_notes"), ("PYQ 2023", "pyq"),
                                      ("Lecture slides", "pyq"),  # T12: 'ct' inside 'lecture'
                                      ("Syllabus", "syllabus"), ("Random", "other")])
def test_resource_class(spark, name, cls):
    assert one(spark, L.resource_class, name) == cls


def test_viewer_target_double_decoding(spark):
    href = "/file-viewer?url=https%3A%2F%2Fdrive.google.com%2Ffile%2Fd%2FX1%2Fview&x=1"
    assert one(spark, L.viewer_target, href) == "https://drive.google.com/file/d/X1/view"
    assert one(spark, L.viewer_target, "/file-viewer?title=a") is None


def test_citation_and_percent(spark):
    df = spark.createDataFrame([("Math", 2, 0, 5, "a.pdf", 0.8759), ("", 0, 0, 0, "", 0.6)],
                               "s string, sem int, u int, sl int, f string, score double")
    out = df.select(T.citation(F.col("s"), F.col("sem"), F.col("u"), F.col("sl"), F.col("f")).alias("c"),
                    T.match_percent(F.col("score")).alias("p")).collect()
    assert out[0]["c"] == "Subject: Math | Semester: 2 | Slide: 5 | Source: a.pdf"
    assert out[1]["c"] == "No citation available"
    assert [r["p"] for r in out] == [87, 60]  # truncation, not rounding


def test_token_count_and_strip(spark):
    assert one(spark, lambda c: T.token_count(c), "  a  bb\tc\n ") == 3
    assert one(spark, lambda c: T.token_count(c), "   ") == 0
    assert one(spark, T.strip, " \t x y \n") == "x y"


def test_dialog_rules(spark):
    df = spark.createDataFrame([
        ("tell me about this subject", "DBMS", 3),
        ("what is normalization in databases", None, 0),
        ("joins?", "DBMS", 0),
        ("tell me about community detection", "", 2)],   # T12: 'unit' inside 'community'
        "q string, s string, sem int")
    r = df.select(DG.is_generic(F.col("q"), F.col("s")).alias("g"),
                  DG.with_subject_prefix(F.col("q"), F.col("s")).alias("e"),
                  DG.is_clear(DG.with_subject_prefix(F.col("q"), F.col("s"))).alias("c"),
                  DG.filter_note(F.col("s"), F.col("sem")).alias("n")).collect()
    assert [x["g"] for x in r] == [True, False, False, False]
    assert r[2]["e"] == "DBMS: joins?"
    assert [x["c"] for x in r] == [False, True, False, True]
    assert "semester 3" in r[0]["n"] and r[1]["n"] == "" and "semester: 2" in r[3]["n"]


def test_validate_rewrite(spark):
    df = spark.createDataFrame([(' "normal forms" ', "DBMS"), ("[Subject Name] x", "DBMS"), ("ab", None),
                                ("DBMS joins", "DBMS")], "c string, s string")
    r = df.select(DG.validate_rewrite(F.col("c"), F.col("s"), F.lit("FALLBACK")).alias("r")).collect()
    assert [x["r"] for x in r] == ["DBMS normal forms", "FALLBACK", "FALLBACK", "DBMS joins"]


def test_cache_key_matches_python_sha256(spark):
    import hashlib
    import json
    hist = [("user", "hi"), ("assistant", "yo")]
    df = spark.createDataFrame([("q", 3, "S", hist)], "q string, sem int, s string, h array<struct<role:string,content:string>>")
    k = df.select(T.cache_key(F.col("q"), F.col("sem"), F.col("s"), F.col("h")).alias("k")).first()["k"]
    js = json.dumps([{"role": r, "content": c} for r, c in hist], separators=(",", ":"))
    assert k == hashlib.sha256(f"q|3|S|{js}".encode()).hexdigest()


def test_numbers_beyond_int_are_no_match(spark):
    assert one(spark, P.unit_from_content, "unit 98765432109") == 0
    assert one(spark, P.unit_from_content, "unit 98765432109 module 4") == 4
    assert one(spark, P.unit_from_filename, "unit20231231235959.pdf") == 0
    assert one(spark, P.semester_from_path, "data/semester_2/semester_20231231235959/x.pdf") == 2
    assert one(spark, P.semester_from_path, "data/20231231235959/s/x.pdf") == 0


@pytest.mark.parametrize("href,target", [
    ("/file-viewer?url=https%3A%2F%2Fh%2Fa%2Bb", "https://h/a+b"),         # an encoded plus stays
    ("/file-viewer?url=https%3A%2F%2Fh%2Fa+b", "https://h/a b"),
    ("/file-viewer?url=https%253A%252F%252Fh%252Fx", "https://h/x"),       # encoded twice
    ("/file-viewer?url=100%&x=1", "100%"), ("/file-viewer?url=5%25%20off", "5% off"), ("/file-viewer?u=1", None)])
def test_viewer_target_decoding(spark, href, target):
    assert one(spark, L.viewer_target, href) == target


def test_unicode_blanks(spark):
    assert one(spark, T.non_blank, "\u00a0\u2003 \x1f") is False
    assert one(spark, T.token_count, "a\u00a0b\u3000c ") == 3
    assert one(spark, T.strip, "\u00a0 x \u2028") == "x"


def test_prompt_wording_is_a_parameter(spark):
    mine = DG.PromptTexts(note_subject="[{subject}]", question="Q ", answer="A")
    df = spark.createDataFrame([("why", "maths", None)], "q string, s string, n int")
    row = df.select(DG.filter_note(F.col("s"), F.col("n"), mine).alias("note"),
                    DG.build_prompt(F.lit("sys"), F.col("q"), F.lit("ctx"), F.col("s"), F.col("n"), F.lit(""), mine).alias("p"),
                    DG.rewrite_request(F.col("q"), F.col("s"), F.col("n"), F.lit("")).alias("r")).first()
    assert row.note == "[maths]" and row.p.startswith("sys[maths]") and row.p.endswith("Q why\n\nA")
    assert "why" in row.r and "maths" in row.r


def test_history_over_gapped_turns(spark):
    from lectern.operators import history as HI
    m = spark.createDataFrame([(1, t, "user" if t % 2 else "assistant", f"m{t}") for t in (0, 1, 4, 9, 9000)] +
                              [(2, 5, "user", "x")], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): [h.content for h in r.history] for r in HI.previous_messages(m, 3).collect()}
    assert got[(1, 9)] == ["m0", "m1", "m4"] and got[(1, 9000)] == ["m1", "m4", "m9"]
    assert got[(1, 0)] == [] and got[(2, 5)] == []


def test_manifest_order_with_many_links(spark):
    from lectern.operators import links as LK
    rows = [(1, 1, p, f"n{p}") for p in (1, 9_999, 10_002, 300_000)] + [(1, 2, 1, "viewer"), (2, 1, 1, "next")]
    res = spark.createDataFrame(rows, "page_id long, strategy int, pos int, name string")
    assert [r.name for r in LK.manifest_order(res).orderBy("ord").collect()] == \
        ["n1", "n9999", "n10002", "n300000", "viewer", "next"]


def test_knn_blocks_filters_and_odd_vectors(spark):
    import numpy as np

    from lectern.operators import knn
    from lectern.params import Params
    rng = np.random.default_rng(1)
    v = rng.integers(-5, 6, (1000, 6)).astype(float)
    v[7] = 0
    rows = [(i, [float(x) for x in v[i]], i % 3, f"s{i % 2}") for i in range(1000)]
    c = spark.createDataFrame(rows + [(2000, [1.0, 2.0], 1, "s1"), (2001, None, 1, "s1")],
                              "chunk_id long, embedding array<double>, semester int, subject string")
    q = c.select(F.col("chunk_id").alias("query_id"), "embedding",
                 F.when(F.col("chunk_id") % 4 == 0, F.col("semester")).alias("qs"),
                 F.when(F.col("chunk_id") % 5 == 0, F.col("subject")).otherwise(F.lit(" ")).alias("qj"))
    out = knn.knn_join(q, c, 3, Params(knn_query_block=100), query_semester="qs", query_subject="qj", normalize="after",
                       exclude_self=True, carry=["subject"]).collect()
    n = np.sqrt((v * v).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        s = (v @ v.T) / (n[:, None] * n[None, :])
    got = {}
    for r in out:
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id))
        assert r.subject == f"s{r.chunk_id % 2}"
    for i in range(1000):
        ok = [j for j in range(1000) if j != i and not np.isnan(s[i, j]) and (i % 4 or not i % 3 or j % 3 == i % 3)
              and (i % 5 or j % 2 == i % 2)]
        want = sorted(ok, key=lambda j: (-s[i, j], j))[:3]
        assert sorted(got.get(i, [])) == [(k + 1, j) for k, j in enumerate(want)], i
    assert 2000 not in got                                   # no other vector of its dimension
    assert {r.chunk_id for r in knn.invalid_vectors(c, dim=6).collect()} == {7, 2000, 2001}
