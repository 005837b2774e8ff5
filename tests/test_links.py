"""Link discovery on literal pages: subject-link fallback and script dedup."""

from lectern.operators import links as LK


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, subject string, semester int, html string")


def test_subject_links_primary_and_fallback(spark):
    pages = _pages(spark, [
        (1, "u1", "s", 3, '<a href="/semesters/3/subjects/Data%20Mining/">  </a><a href="/x">X</a>'),
        (2, "u2", "s", 3, '<a href="/semesters/3/list/subjects/os">Operating Systems</a>'),   # fallback only
        (3, "u3", "s", 3, '<a href="/semesters/3/subjects/a">A</a><a href="/semesters/3/z/subjects/b">B</a>')])
    got = sorted((r["page_id"], r["name"], r["url"]) for r in LK.subject_links(pages, "https://p.example/").collect())
    assert got == [(1, "Data Mining", "https://p.example/semesters/3/subjects/Data%20Mining/"),
                   (2, "Operating Systems", "https://p.example/semesters/3/list/subjects/os"),
                   (3, "A", "https://p.example/semesters/3/subjects/a")]


def test_script_links_deduplicated_against_page_links(spark):
    html = ('<a href="https://drive.google.com/file/d/A1/view">Unit 1</a>'
            '<iframe src="https://drive.google.com/open?id=B2"></iframe>'
            '<script>x="https://drive.google.com/file/d/A1/view";y="https://drive.google.com/drive/folders/C3";'
            'z="https://drive.google.com/drive/folders/C3?x=1"</script>')
    res = LK.all_resources(_pages(spark, [(1, "u", "s", 1, html)])).collect()
    got = sorted((r["strategy"], r["drive_id"], r["drive_type"], r["name"]) for r in res)
    assert got == [(1, "A1", "file", "Unit 1"), (3, "B2", "file", "Embedded file"),
                   (4, "C3", "folder", "Script-embedded folder")]
