import pytest
from pyspark.sql import functions as F

from codexlake.functions import json_text as J, rules as R, text as T
from codexlake.operators import metrics as M


def values(spark, f, *args):
    """f of literal columns, one row."""
    return spark.range(1).select(f(*[F.lit(a) for a in args]).alias("v")).first()["v"]


def test_names(spark):
    rows = spark.createDataFrame([("Müller, Hans von der Au",), ("Groß-Älter  Straße!",), (None,)], "n string")
    got = rows.select(T.slug(F.col("n")).alias("s"), T.index_name(F.col("n")).alias("i"), T.person_name(F.col("n")).alias("p"), T.match_keys(F.col("n")).alias("k")).collect()
    assert got[0].s == "mueller-hans-von-der-au" and got[0].i == "muller, hans au" and got[0].p == "muller hans au"
    assert got[0].k == ["muller, hans au", "mueller, hans au"]
    assert got[1].s == "gross-aelter-strasse" and got[2].s is None


@pytest.mark.parametrize(
    "text, want",
    [("", False), ("   ", False), ("u" * 100, True), ("abcabcabc", True), ("Ein ganz gewöhnlicher Satz mit vielen verschiedenen Buchstaben darin.", False), ("\n".join("xyzabcdefghijk"), True), ("wort und satz quer ding bald famos " * 30, True), (None, False)],
)
def test_degenerate(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(T.is_degenerate(F.col("t")).alias("v"), T.quality_score(F.col("t")).alias("q"))
    row = df.first()
    assert row.v is want
    if want and len(text) >= 20:
        assert row.q == 0.1


def test_chunks(spark):
    got = values(spark, lambda t: T.chunks(t, 4, 1), "abcdefgh")
    assert [(c.nth, c.start, c.chunk) for c in got] == [(0, 0, "abcd"), (1, 3, "defg"), (2, 6, "gh")]
    assert [c.chunk for c in values(spark, lambda t: T.chunks(t, 4, 1), "abc")] == ["abc"]


@pytest.mark.parametrize("text, want", [("14. Jh.", 14), ("1200-1250", 13), ("ca. 1350", 14), ("1803", 19), ("Mittelalter", 14), ("o. D.", None), ("14. Jahrhundert", 14), ("Ende des 9. Jahrhunderts", None), ("19. JAHRHUNDERT, 1350", 19)])
def test_century(spark, text, want):
    assert values(spark, R.parse_century, text) == want


@pytest.mark.parametrize("text, want", [("Mittelhochdeutsch", "de"), ("Mittellatein (unsicher)", "la"), ("de", "de"), ("Klingonisch", ""), ("", ""), ("Altfranzösisch", "fr")])
def test_language(spark, text, want):
    assert values(spark, R.normalise_lang, text) == want


def test_small_rules(spark):
    assert values(spark, R.normalise_script, "Gotische Textura, 2. H.") == "textura"
    assert tuple(values(spark, R.parse_years, "um 1300–1370")) == (1300, 1370)
    assert values(spark, R.page_of, "p1:kraken/m:1") == "p1" and values(spark, R.engine_model_of, "p1:kraken/m:1") == "kraken/m:1"
    assert values(spark, R.page_of, "kraken") == "" and len(values(spark, lambda v: R.pseudonym(v, "s"), "u1")) == 16
    assert values(spark, lambda v: R.pseudonym(v, "s"), "") == "anon"
    assert values(spark, R.natural_key, "Page10") > values(spark, R.natural_key, "page2")
    assert values(spark, lambda t: T.script_implausible(t, F.lit("de")), "שלום עולם") and not values(spark, lambda t: T.script_implausible(t, F.lit("de")), "hallo")
    assert values(spark, T.fold_abbreviations, "ſtraße ī") == "sstrasse i" or values(spark, T.fold_abbreviations, "ſtraße ī") == "strasse i"


def test_error_rates(spark):
    assert values(spark, M.cer, "Welt!", "welt") == 0.0
    assert values(spark, lambda a, b: M.cer(a, b, **M.RAW), "gebürt", "geburt") == pytest.approx(1 / 6)
    assert values(spark, M.cer, "", "") == 0.0 and values(spark, M.cer, "", "x") == 1.0
    assert values(spark, M.wer, "a b c", "a x c d") == pytest.approx(2 / 3)


def test_model_answers(spark):
    from codexlake.functions import json_text as J

    rows = [('```json\n{"a": 1,}\n```',), ('Sure: {"a": 1} done',), ('[{"a": 1}, {"a": 2}, {"a"',), ("nothing",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(F.try_variant_get(J.tolerant(F.col("t")), "$.a", "int").alias("a"), F.size(J.salvage(F.col("t"))).alias("n")).collect()
    assert [r.a for r in got] == [1, 1, 1, None, None] and [r.n for r in got[:4]] == [1, 1, 2, 0]
    d = spark.createDataFrame([('{"Schrift": {"wert": "Gotische Textura"}, "Sprache": "Latein (unsicher)", "Datierung": {"value": "1350"}, "Dokumenttyp": ""}',)], "j string")
    r = d.select(J.criteria(F.parse_json("j")).alias("c"), J.marked_uncertain(F.parse_json("j")).alias("u"), J.missing_elements(F.parse_json("j"), ["Schrift", "Dokumenttyp", "Ort"]).alias("m")).first()
    assert tuple(r.c) == ("textura", "la", 14, None) and r.u and r.m == ["Dokumenttyp", "Ort"]
    assert values(spark, lambda t: J.choice(t, "pick", ["a", "b"]), '{"pick": "B"}') == "b" and values(spark, lambda t: J.choice(t, "pick", ["a"]), '{"pick": "x"}') is None
    assert tuple(values(spark, lambda t: J.coordinates(F.parse_json(t)), "[46.9, 7.4]")) == (46.9, 7.4) and values(spark, lambda t: J.coordinates(F.parse_json(t)), "[1]") is None
    assert values(spark, lambda t: J.source_url("http://x/", t), "a b") == "http://x/a+b"


def test_criteria_from_prose(spark):
    rows = [("Urbar in kursive, 15. Jahrhundert, deutsch", '{"Schrift": {"wert": "Blackletter"}}'), ("Brief, 1250-1399, Latein", None), ("um 1450", '{"Sprache": "Klingonisch", "Datierung": "", "Inhalt": "Ein Testament"}'), (None, None), ("nichts", "{}")]
    df = spark.createDataFrame(rows, "t string, j string").select(J.criteria_with_prose(F.try_parse_json("j"), F.col("t")).alias("c"))
    assert [tuple(r.c) for r in df.collect()] == [("fraktur", "de", 15, "urbarium"), (None, "la", 13, "letter"), (None, None, 15, "testament"), (None,) * 4, (None,) * 4]
