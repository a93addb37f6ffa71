"""Small cases whose results follow from the written rules."""

import datetime

import pytest
from pyspark.sql import functions as F

from cvlake.functions import text as t
from cvlake.operators import catalogue as cat
from cvlake.operators import contact, experience, names
from cvlake.plans import search
from cvlake.sources import documents, listing, store


@pytest.fixture
def of(spark):
    """The value of an expression of one column "x"."""

    def value(x, expression, kind="string"):
        r = spark.createDataFrame([(x,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()[0]
        return r

    return value


@pytest.mark.parametrize("name, is_one", [("cv1.pdf", False), ("cv.john.pdf", False), ("myCV.pdf", False), ("CV_x.pdf", True), ("resume.PDF", True)])
def test_resume_filename(of, name, is_one):
    assert of(name, listing.is_resume_filename) is is_one


def test_a_word_before_an_underscore_stays_in_the_name(of):
    assert of("Resume_John_Smith.pdf", names.name_from_filename)["name"] == "Resume John Smith"


@pytest.mark.parametrize("name, person", [("CV-John-Smith.pdf", "John Smith"), ("cv JohnSmith 2024.docx", "John Smith"), ("Resume - John McDonald (1).pdf", None)])
def test_name_from_filename(of, name, person):
    assert of(name, names.name_from_filename)["name"] == person


def test_phones(of):
    assert of("+44 (0)7911 123456", contact.uk_phones) == []
    assert of("07911 123456\n2019 - 2020", contact.uk_phones) == ["07911 123456 20"]


def test_postcodes(of):
    assert of("M11AE SW1A1AA tw3 3nu", contact.postcodes) == ["M1 1AE", "SW1A 1AA", "TW3 3NU"]


def test_address_with_all_signals(of):
    found = of("12 Long Acre Road\nLondon, TW3 3NU", lambda x: contact.address(x, contact.postcodes(x)))
    assert found["confidence"] == pytest.approx(0.9)


@pytest.mark.parametrize("line", ["Jan 2020 - Present", "2019 to 2021", "2019–2021", "September 2018-2019"])
def test_date_ranges(of, line):
    assert of(line, experience.has_date_range)


@pytest.mark.parametrize("line", ["2019 — 2021", "01/2019 - 03/2020", "Jan '20 - Mar '21"])
def test_no_date_ranges(of, line):
    assert not of(line, experience.has_date_range)


@pytest.mark.parametrize("start, end, months", [("2019-01", "2021-01", 25), ("2019-01", "Current", None)])
def test_duration(spark, start, end, months):
    row = spark.createDataFrame([(start, end)], "a string, b string").select(experience.duration_months(F.col("a"), F.col("b"))).first()
    assert row[0] == months


@pytest.mark.parametrize(
    "text, name, confidence", [("cctv", "CCTV monitoring", 0.95), ("C.C.T.V", "CCTV monitoring", 0.70), ("door supervisor", "SIA Door Supervisor", 0.95), ("DBS", "DBS check", 0.88)]
)
def test_canonical_skills(of, text, name, confidence):
    found = of(text, lambda x: cat.canonicalise(x, cat.Catalogue()))
    assert (found["canonical"], found["confidence"]) == (name, pytest.approx(confidence))


@pytest.mark.parametrize("query, years", [("10+yrs", 10), ("3.5 years", 5), ("5-year", None), ("100 years", None)])
def test_query_years(of, query, years):
    assert of(query, search.query_years) == years


def test_query_skills(of):
    assert of("door supervisor, forklift, 3 years", lambda q: search.query_skills(q, cat.Catalogue())) == ["SIA Door Supervisor", "Forklift driving"]


def test_first_spellings(of):
    assert of(["B", "a", "b", "A"], t.first_spellings, "array<string>") == ["B", "a"]


def test_month_year(of):
    assert of("Sept 2018", t.month_year)["date"] == datetime.date(2018, 9, 1)
    assert of("yesterday", t.month_year)["date"] is None


def test_nulls_pass(of):
    for f in (t.clean_lines, t.one_line, contact.emails, contact.uk_phones, contact.postcodes, t.month_year):
        of(None, f)


def test_docx_round_trip(spark, tmp_path):
    import zipfile

    body = "".join(f"<w:p><w:r><w:t>{line}</w:t></w:r></w:p>" for line in ("Jane Doe", "Key Skills", "CCTV"))
    with zipfile.ZipFile(tmp_path / "CV_Jane.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    rows = documents.extract_text(documents.read_files(spark, str(tmp_path))).collect()
    assert len(rows) == 1 and "Key Skills" in str(rows[0])


def test_later_rows_replace_earlier_ones(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "file_id string, n int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "file_id string, n int")
    assert sorted(map(tuple, store.upsert(old, new).collect())) == [("a", 1), ("b", 2), ("c", 2)]


def test_token_set_ratio(spark):
    """Against the definition by plain code, and known cases."""
    import itertools

    from cvlake.operators.fuzzy import token_set_ratio

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = list(itertools.accumulate(range(1, len(b) + 1), lambda last, j, row=row, x=x: row[j - 1] + 1 if x == b[j - 1] else max(row[j], last), initial=0))
        return row[-1]

    def plain(a, b):
        ta, tb = set(a.split()), set(b.split())
        if not ta or not tb:
            return 0.0
        both, x, y = (" ".join(sorted(s)) for s in (ta & tb, ta - tb, tb - ta))
        if both and (not x or not y):
            return 1.0
        xs, ys = f"{both} {x}".strip(), f"{both} {y}".strip()
        of = lambda s, t, c: 2 * c / (len(s) + len(t))
        gap = len(both) + bool(both)
        return max(of(xs, ys, gap + lcs(x, y)), of(both, xs, len(both)) if both else 0, of(both, ys, len(both)) if both else 0)

    names = ["Maria Smith", "Smith Maria", "Maria J Smith", "María Smyth", "maria smith", "", "  ", "A B C", "Jon Smithe", "Zed"]
    pairs = [(a, b) for a in names for b in names]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", token_set_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(abs(r.r - plain(r.a, r.b)) < 1e-9 for r in got)
    assert {(r.a, r.b): r.r for r in got}["Maria Smith", "Maria J Smith"] == 1.0


@pytest.mark.parametrize(
    "number,wanted",
    [("020 7946 0123", ("geographic", True, "+442079460123")), ("+44 7700 900123", ("mobile", True, "+447700900123")), ("+44 (0)7700 900123", ("mobile", True, "+447700900123")), ("0044 113 496 0000", ("geographic", True, "+441134960000")), ("01632 96012", ("geographic", True, "+44163296012")),
     ("0113 496 000", ("geographic", False, None)), ("07624 460123", ("mobile", True, "+447624460123")), ("0760 0000000", ("pager", True, "+447600000000")), ("0800 1111", ("free", True, "+448001111")), ("0999 999 9999", (None, False, None)), ("", (None, False, None)), ("0171 222 3333", ("not in use", False, None))],
)
def test_numbering_plan(spark, number, wanted):
    from cvlake.operators.phone_plan import planned

    row = spark.createDataFrame([(number,)], "n string").select(planned(F.col("n")).alias("p")).first().p
    assert tuple(row) == wanted
