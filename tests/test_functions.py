import datetime

import pytest
from pyspark.sql import functions as F

from lodestone import hooks
from lodestone.functions import calendar, ids, shapes, text, vectors


def one(spark, column, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(column.alias("y")).head()[0]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("BYD Company, Ltd.", "byd company ltd"), ("  Saudi   Aramco ", "saudi aramco"), ("L'Oréal S.A.", "loréal sa"), ("", ""), ("!!!", ""), (None, None)],
)
def test_normalize_name(spark, raw, expected):
    assert one(spark, text.normalize_name("x"), raw) == expected


@pytest.mark.parametrize(
    ("name", "forms"),
    [("byd company ltd", ["byd company ltd", "byd"]), ("tesla inc", ["tesla inc", "tesla"]), ("ford motor company", ["ford motor company", "ford motor"]), ("saudi aramco", ["saudi aramco"]), ("ab inc", ["ab inc"]), ("", [])],
)
def test_short_forms(spark, name, forms):
    assert one(spark, text.short_forms("x"), name) == forms


@pytest.mark.parametrize(("raw", "expected"), [("FoodSecurityTracker", "Food Security Tracker"), ("EUTrade", "EU Trade"), ("WEO", "WEO"), ("2025 Factbook", "2025 Factbook"), ("", "")])
def test_split_camel(spark, raw, expected):
    assert one(spark, text.split_camel("x"), raw) == expected


def test_label_tokens_join_periods(spark):
    assert one(spark, text.label_tokens("x"), "The Washington D.C.") == one(spark, text.label_tokens("x"), "Washington DC") == ["dc", "washington"]


@pytest.mark.parametrize(("raw", "expected"), [("Revenue (USD M)", "revenue"), ("revenue usd m thousand", "revenue"), ("Share count", "share"), ("Mass", "mass")])
def test_table_label(spark, raw, expected):
    assert one(spark, text.table_label("x"), raw) == expected


def test_trigram_similarity(spark):
    row = spark.createDataFrame([("word", "two words"), ("", ""), ("abc", "abc")], "a string, b string").select(text.trigram_similarity("a", "b")).collect()
    assert [r[0] for r in row] == [pytest.approx(4 / 11), 0.0, 1.0]


def test_legibility(spark):
    prose = "the cat and the dog of this house are not for sale but " * 5
    assert one(spark, text.legibility("x"), prose) > 0.3
    assert one(spark, text.legibility("x"), "xq zv kk " * 30) == 0.0
    assert one(spark, text.legibility("x"), "too short") == -1.0
    assert one(spark, text.legibility("x"), None) == -1.0
    assert not one(spark, text.is_legible("x"), "xq zv kk " * 30)


def test_section_coverage(spark):
    got = one(spark, text.section_coverage("x"), "# Claims\nfoo\n  - WARNINGS: none\nin lists")
    assert [k for k, v in got.asDict().items() if v] == ["CLAIMS", "REGULATORY_SAFETY_WARNINGS"]


def test_iris(spark):
    assert one(spark, text.local_name("x"), "http://a/b#C") == "C"
    assert one(spark, text.namespace_of("x"), "http://a/b/C") == "http://a/b/"
    assert one(spark, text.mint_namespace("x", "d#"), "http://xmlns.com/foaf/0.1/Agent") == "d#"
    assert one(spark, text.mint_namespace("x", "d#"), "http://a/geo#Country") == "http://a/geo#"
    assert one(spark, text.mint_namespace("x", "d#"), None) == "d#"
    assert one(spark, ids.chunk_iri(F.lit("a" * 64), F.lit(7)), "") == f"{ids.NAMESPACE}#Chunk_{'a' * 16}_0007"
    assert one(spark, ids.entity_iri("x", F.lit("c")), "A B!").startswith(f"{ids.NAMESPACE}#a-b-")


def test_json_and_fields(spark):
    assert one(spark, text.json_text("x"), '```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, text.json_text("x"), 'Sure: {"a": 1} done') == '{"a": 1}'
    assert one(spark, text.json_text("x"), "none") is None
    assert one(spark, text.date_field("x"), " 2024-02-30 ") == "2024-02-30"
    assert one(spark, text.date_field("x"), "2024-2-3") is None
    assert one(spark, text.string_field("x"), "  ") is None
    assert one(spark, text.clip("x", 5), "ab\ncdefg") == "ab cd..."
    assert one(spark, text.scrub_citations("x"), "fact [kg:Chunk_1]. [http://x y] [see: 3]") == "fact. [see: 3]"
    assert one(spark, text.strip_nul("x"), "a\x00b") == "ab"


@pytest.mark.parametrize(("raw", "expected"), [("$1,200", True), ("(3.5)%", True), ("abc", False), ("", False), (None, False), ("$", False)])
def test_looks_numeric(spark, raw, expected):
    assert one(spark, text.looks_numeric("x"), raw) is expected


def test_html_and_links(spark):
    assert one(spark, text.html_to_text("x"), "<p>a &amp; b</p><script>x</script>\n\n<form>q</form><p> c  d</p><b>e</b>") == "a & b\n\nc  d\ne"
    assert one(spark, text.safe_filename("x"), "Q1: report/final.pdf ") == "Q1__report_final.pdf"
    assert one(spark, text.safe_filename("x"), "...") == "untitled"
    assert one(spark, text.directory_slug("x"), "Apple Inc. -- 2024") == "apple-inc-2024"
    assert one(spark, text.unwrap_redirect("x"), "//duck.example/l/?uddg=https%3A%2F%2Fa.b%2Fc&r=1") == "https://a.b/c"
    assert one(spark, text.unwrap_redirect("x"), "https://a.b") == "https://a.b"
    assert one(spark, text.looks_like_pdf("x"), b"%PDF-1.7 ...", "x binary")
    assert one(spark, text.year_term("x"), "in 1999 and 2001") == "YEAR_1999"


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 0.0], [0.0, 4.0])], "a array<float>, b array<float>")
    assert rows.select(vectors.l2_distance("a", "b")).head()[0] == pytest.approx(5.0)
    embedded = one(spark, vectors.hashed_embedding("x", 16), "one two two three")
    assert sum(v * v for v in embedded) == pytest.approx(1.0, abs=1e-5)
    assert one(spark, vectors.hashed_embedding("x", 4), None) == [0.0] * 4


def test_calendar(spark):
    for identifier, level, start, end, label, parent in [
        ("DAY_2024_02_29", "day", (2024, 2, 29), (2024, 2, 29), "2024-02-29", "MONTH_2024_02"),
        ("MONTH_2024_02", "month", (2024, 2, 1), (2024, 2, 29), "February 2024", "Q1_2024"),
        ("Q4_2023", "quarter", (2023, 10, 1), (2023, 12, 31), "Q4 2023", "YEAR_2023"),
        ("YEAR_1999", "year", (1999, 1, 1), (1999, 12, 31), "1999", None),
    ]:
        row = spark.createDataFrame([(identifier,)], "x string").select(calendar.level_of("x").alias("l"), calendar.start_of("x").alias("s"))
        row = row.select("l", "s", calendar.end_of("l", "s"), calendar.label_of("l", "s"), calendar.parent_id("l", "s")).head()
        assert tuple(row) == (level, datetime.date(*start), datetime.date(*end), label, parent)


@pytest.mark.parametrize(
    ("label", "reason"),
    [
        ("BYD Company Ltd.", "corporate-suffix"), ("FoodSecurityTracker", "document-title"), ("Market Outlook", "document-title"), ("Forecast", None), ("2025 Strategy Conference", "year-prefix"),
        ("2025", None), ("Mammal", None), ("", None), (None, None), ("Groupie", None),
    ],
)
def test_entity_shape(spark, label, reason):
    assert one(spark, shapes.entity_shape("x"), label) == reason


def test_entity_shape_extensions(spark):
    assert one(spark, shapes.entity_shape("x", F.lower("x").isin("myanmar")), "Myanmar") == "known-place"
    assert one(spark, shapes.entity_shape("x", more_suffixes=shapes.words_pattern(["Oyj"])), "Nokia Oyj") == "corporate-suffix"
    assert shapes.words_pattern(["", " "]) is None


@pytest.mark.parametrize(
    ("value", "keep"),
    [("78,400", False), ("FY2024", False), ("Total", False), ("n/a", False), ("  ", False), (None, False), ("BYD", True), ("$4.5m", False), ("Q1 2024", False), ("Saudi Aramco", True), ("ab", False)],
)
def test_table_candidate(spark, value, keep):
    assert one(spark, shapes.is_table_candidate("x"), value) is keep


@pytest.mark.parametrize(("label", "person"), [("Anna Smith", True), ("Anna", False), ("Gulf War", False), ("Bank of Rome", False), ("A B C D E", False), ("Élodie Durand", True), ("Anna 2", False)])
def test_person_name(spark, label, person):
    assert one(spark, shapes.is_person_name("x"), label) is person


def test_suspicious(spark):
    rows = [("Acme Corp", "Animal", True), ("Acme Corp", "Organization", False), ("oil embargo", "Event", False), ("Minister", "Person", True), ("Minister", "Role", False), ("Dog", None, True), ("Dog", "Mammal", False), ("", None, False)]
    df = spark.createDataFrame(rows, "l string, p string, want boolean")
    assert df.where(shapes.is_suspicious("l", "p") != F.col("want")).count() == 0


def test_grids(spark):
    schema = "x array<array<string>>"
    assert one(spark, shapes.is_simple_grid("x"), [["a", "b"], ["c", "d"]], schema)
    assert not one(spark, shapes.is_simple_grid("x"), [["a", "b"], ["c"]], schema)
    assert not one(spark, shapes.is_simple_grid("x"), [["a"], ["b"], ["c"], ["d"]], schema)
    assert not one(spark, shapes.is_simple_grid("x"), [["a", None], [None, "d"]], schema)
    assert not one(spark, shapes.is_simple_grid("x"), [], schema)
    toc = [[f"Part {i}", str(i)] for i in range(6)]
    assert one(spark, shapes.grid_noise("x"), toc, schema) == "toc-or-index"
    assert one(spark, shapes.grid_noise("x"), [["A et al.", "x"], ["B et al.", "y"], ["pp. 3", "Journal"]], schema) == "bibliography"
    assert one(spark, shapes.grid_noise("x", F.lit("Index of names")), toc, schema) == "caption-toc-index-bib"
    assert one(spark, shapes.grid_noise("x", None, F.lit(1.0), F.lit(5.0), F.lit(100.0)), [["a", ""]], schema) == "header-band"
    assert one(spark, shapes.grid_noise("x"), [["a", "b"], ["c", "d"], ["e", "f"]], schema) is None
    assert one(spark, shapes.is_fabricated("x"), ["Column 1", "row 2", "z"], "x array<string>")


def test_semantic_role(spark):
    assert one(spark, shapes.semantic_role("x", F.lit("StudyRelationship")), "a relationship between a study and a site").asDict() == {"role": "relationship_like_class", "confidence": "high"}
    assert one(spark, shapes.semantic_role("x", F.lit("zzz")), "nothing here").asDict() == {"role": "unclassified_class", "confidence": "low"}


def test_hooks(spark):
    h = hooks.Hooks()
    assert one(spark, h.summarize(F.col("x")), "A. B. C. D.") == "A. B. C."
    assert one(spark, h.intent(F.col("x")), "Compare A versus B") == "comparison"
    assert one(spark, h.judge(F.col("x"), F.lit("a b")), "b c") == 0.5
    assert one(spark, h.answer(F.array(F.col("x"))), "fact") == "[1] fact"
    assert one(spark, text.human_bytes("x"), 2048.0, "x double") == "2.0 KB"
    assert one(spark, hooks.estimated_cost(F.lit(100), F.lit(10), F.lit(50), (1.0, 2.0)), "") == pytest.approx((50 + 5 + 20) / 1e6)
