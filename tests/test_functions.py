import pytest
from pyspark.sql import functions as F

from foliant.functions import calc
from foliant.functions import numbers as nb
from foliant.functions import text as tx


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    ("fn", "value", "want"),
    [
        (tx.fix_ligatures, "eﬃcient ﬂow", "efficient flow"), (tx.one_line, " a \n b ", "a b"), (tx.word_count, "one two 水的", 3.0), (tx.letters_key, "Speciﬁc Heat-4!", "speciﬁcheat4"), (tx.slug, "Heat (J) & Flow!", "heat-flow"), (tx.slug, "(x)", "item"),
        (tx.strip_citations, 'It falls. [p.3: "it falls"]', "It falls."), (tx.is_unsure, " unsure: no", True), (tx.normal_key, " Look_For ", "look-for"), (tx.is_math_line, "q = m c", True), (tx.is_math_line, "It falls (4.1)", True),
        (tx.is_math_line, "It falls.", False), (tx.garble_ratio, "plain text", 0.0), (tx.garble_ratio, "a (cid:3) b", 0.05), (tx.garble_ratio, "", 0.0), (tx.braces_balanced, r"\frac{1}{2}", True), (tx.braces_balanced, "}{", False), (tx.braces_balanced, r"\{", True),
        (tx.latex_ok, "f(x)", True), (tx.latex_ok, "$x$", False), (tx.latex_ok, "f(x", False), (tx.roman_value, "xiv", 14), (tx.roman_value, "iiii", None), (tx.chinese_value, "二十三", 23), (tx.chinese_value, "十", 10), (tx.chinese_value, "百", None),
        (tx.natural_key, "page10.png", "page000000000010.png"),
    ],
)
def test_text_functions(spark, fn, value, want):
    got = one(spark, fn, value)
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


@pytest.mark.parametrize("fn", [tx.fix_ligatures, tx.one_line, tx.word_count, tx.estimate_tokens, tx.letters_key, tx.slug, tx.garble_ratio, tx.citations, tx.match_key, nb.number_groups])
def test_null_in_null_out(spark, fn):
    assert one(spark, fn, None) is None


def test_arrays(spark):
    assert [tuple(c) for c in one(spark, tx.citations, 'a [p.3: "x y"] b [p. iv: "z"]')] == [("3", "x y"), ("iv", "z")]
    assert one(spark, tx.covers, "(covers: T-1, LO-2)") == ["T-1", "LO-2"]
    assert one(spark, tx.split_cells, 'a | b [p.1: "x|y"] | c') == ["a", 'b [p.1: "x|y"]', "c"]


def test_roman_numerals_round_trip(spark):
    df = spark.range(1, 4000).select("id", tx.roman_value(tx.to_roman(F.col("id"))).alias("back"))
    assert df.where("id != back OR back IS NULL").count() == 0


def test_match_keys():
    assert tx.key_of("Speciﬁc heat") == tx.key_of("specific   HEAT")
    assert tx.key_of("tempera-\nture") == "temperature"
    assert tx.key_of("4.184 J") != tx.key_of("41.84 J")
    assert tx.key_of("−890 kJ") != tx.key_of("890 kJ")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("15,690 J and −890 kJ and 250. g and 0.500 kg", [["15690", "15.69"], ["-890"], ["250"], ["0.5"]]), ("1.234,56", [["1234.56"]]), ("1,234.56", [["1234.56"]]), ("10 000", [["10000"]]), ("4.184", [["4.184", "4184"]]),
        ("version 2.1.3", [["2", "1", "3"]]), ("1,000,000", [["1000000"]]), ("x7 a1b", []), ("007", [["7"]]), ("0,184", [["0.184"]]),
    ],
)
def test_number_readings(spark, text, want):
    assert one(spark, nb.number_groups, text) == want


def test_claim_numbers_and_support(spark):
    groups = one(spark, nb.claim_numbers, "See Figure 2.1 and Equation (2.3): 4.184 J in Chapter 2")
    assert groups == [["4.184", "4184"]]
    df = spark.createDataFrame([([["4.184", "4184"], ["-5"], ["7"]], ["4184", "5"])], "g array<array<string>>, a array<string>")
    assert df.select(nb.unsupported(F.col("g"), F.col("a")).alias("x")).first().x == ["7"]


@pytest.mark.parametrize(("stated", "want"), [("15.7", 0.05), ("15690", 0.5), ("1.57e4", 50.0), ("16000", 50.0), ("0", 0.5)])
def test_rounding(spark, stated, want):
    assert one(spark, nb.rounding_tolerance, stated) == pytest.approx(want)
    assert calc.tolerance_of(stated) == pytest.approx(want)


def test_units():
    assert calc.parse_unit("J/(g*degC)")[0] == pytest.approx(1000)
    assert calc.parse_unit("mL")[0] == pytest.approx(1e-6)
    assert calc.parse_unit("kg m^2 s^-2") == calc.parse_unit("J") or calc.parse_unit("kg*m^2/s^2") == calc.parse_unit("J")
    for bad in ("florps", "J/(g", "J)"):
        with pytest.raises(calc.CalcError):
            calc.parse_unit(bad)


def test_calculations():
    ok = [r[0] for r in calc.run_lines(["dT = 40[degC] - 25[degC]", "250[g]*4.184[J/(g*degC)]*dT => 15690[J]", "250[g]*4.184[J/(g*degC)]*dT => 15.7[kJ]", "-2^2 => -4", "2^3^2 => 512", "sqrt(16[m^2]) => 4.0[m]"])]
    assert ok == [True] * 6
    bad = [r[0] for r in calc.run_lines(["250[g]*4.184[J/(g*K)]*15[K] => 15.6[kJ]", "25[degC]*2[g]", "2 +", "1/0", "3[m] + 2[s]", "nothing", ""])]
    assert bad == [False] * 7
    assert calc.formula_consistent("q=m*c*dT", "dT=q/(m*c)")
    assert not calc.formula_consistent("q=m*c*dT", "dT=q*m/c")


def test_calc_columns(spark):
    df = spark.createDataFrame([(["2*3 => 6", "2*3 => 7"],), (None,), ([],)], "l array<string>")
    got = [r.x for r in df.select(calc.calc_results(F.col("l")).alias("x")).collect()]
    assert [[c.ok for c in x] if x is not None else None for x in got] == [[True, False], None, []]
    assert one(spark, calc.unit_factor, "florps").factor is None
