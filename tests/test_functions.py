import math

import pytest
from pyspark.sql import functions as F

from hearthframe.functions import geometry as g
from hearthframe.functions import scalars as s
from hearthframe.functions import text as t


def one(spark, column, **values):
    kinds = {str: "string", int: "bigint", float: "double", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int"
    row = spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("v")).first()[0]
    return row


@pytest.mark.parametrize("x, want", [("Elx / Elche", "Elx_Elche"), ("Łódź", "Lodz"), ("O'Connor-(West)", "OConnor_West"), ("Straße", "Strasse"), (None, ""), ("  ", "")])
def test_city_key(spark, x, want):
    assert one(spark, t.city_key(F.col("x")), x=x) == want
    assert one(spark, t.city_key_any(F.col("x")), x=x) == want


def test_labels(spark):
    assert one(spark, t.shown(F.col("x")), x=" NaN ") == "Unknown" and one(spark, t.shown(F.col("x")), x=None) == "Unknown"
    assert one(spark, t.shown(F.col("x")), x=" a b ") == "a b"
    assert one(spark, t.shown_key(F.col("x"), {"synthetic / pvc": "PVC"}), x="synthetic / pvc frame") == "PVC_frame"
    assert one(spark, t.path_part(F.col("x"), "f"), x=" ") == "f" and one(spark, t.path_part(F.col("x")), x=" é/b  c! ") == "é_b_c_"
    assert one(spark, t.at_most(F.col("x"), 3), x="abcdef") == "abc\n... (truncated) ..." and one(spark, t.at_most(F.col("x"), 3), x="abc") == "abc"
    assert one(spark, t.sample_key(F.col("x"), F.lit(7)), x="St. Pölten") == "St_P_lten_7"
    assert one(spark, t.first_words(F.array(*map(F.lit, "abcde")))) == "a, b, c (+2)" and one(spark, t.first_words(F.array(F.lit("a")))) == "a"
    assert one(spark, t.grouped_digits(F.col("x"), 1), x=1234567.5) == "1,234,567.5" and one(spark, t.grouped_digits(F.col("x").cast("double")), x=None) == "-"
    assert one(spark, t.size_or_zero(F.split(F.col("x"), ",")), x="a,b") == 2 and one(spark, t.size_or_zero(F.split(F.col("x"), ",")), x=None) == 0
    assert one(spark, t.collapse_whitespace(F.col("x")), x="  a \n b ") == "a b"
    assert one(spark, t.end_use_label(F.col("x")), x="Heating:General") == "Heating"
    assert one(spark, t.end_use_label(F.col("x")), x="Heating:Boiler") == "Heating:Boiler"
    assert one(spark, t.zone_id(F.col("x")), x="Z1 IDEAL LOADS AIR SYSTEM") == "Z1"
    assert one(spark, t.building_id(F.col("x")), x="/a/b/town_0001out.sql") == "town_0001"
    assert one(spark, t.url_name(F.col("x")), x="https://h/a/b.2007-2021.zip?x=1#y") == "b.2007-2021.zip"
    assert one(spark, t.json_like(F.col("x"), "k int"), x="{'k': 3}").k == 3
    assert one(spark, t.json_like(F.col("x"), "k int"), x="nonsense") is None
    mixed = """{'n': None, 'b': True, 'f': False, 's': "it's None", 't': 'say "hi"', 'u': 'it\\'s'}"""
    got = one(spark, t.json_like(F.col("x"), "n string, b boolean, f boolean, s string, t string, u string"), x=mixed)
    assert tuple(got) == (None, True, False, "it's None", 'say "hi"', "it's")


@pytest.mark.parametrize("x, want", [("Berfore 1945", (None, 1945)), ("1945 - 1969", (1945, 1969)), ("Post 2010", (2011, None)), ("x", (None, None)), (None, (None, None))])
def test_years(spark, x, want):
    assert tuple(one(spark, t.age_years(F.col("x")), x=x)) == want


def test_numbers(spark):
    assert one(spark, s.whole_or_null(F.col("x")), x="12.0") == 12
    assert one(spark, s.whole_or_null(F.col("x")), x="12.5") is None
    assert one(spark, s.whole_or_null(F.col("x")), x="x") is None
    assert one(spark, s.number_or_null(F.col("x")), x="1,5") == 1.5
    assert one(spark, s.parse_number(F.col("x")), x="1,234.5") == 1234.5
    assert one(spark, s.to_kwh(F.lit(3.6), F.col("x")), x="MJ") == pytest.approx(1.0)
    assert one(spark, s.to_kwh(F.lit(3.6), F.col("x")), x="m3") is None
    assert one(spark, s.percent(F.lit(1), F.lit(0))) == 0
    shares = one(spark, s.positive_shares(F.create_map(F.lit(" Wood"), F.lit(0.2), F.lit("wood"), F.lit(0.3), F.lit("nan"), F.lit(1.0), F.lit("steel"), F.lit(-1.0))))
    assert [(e.key, round(e.share, 6)) for e in shares] == [("wood", 0.5)]
    assert tuple(one(spark, s.floor_estimate(F.lit(9.0)))) == (3, 3.0)
    assert tuple(one(spark, s.floor_estimate(F.lit(1.0)))) == (1, 2.0)
    assert one(spark, s.floor_estimate(F.lit(-1.0))) is None


def test_places(spark):
    assert one(spark, s.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(6_371_000 * math.pi / 180)
    assert one(spark, s.utm_zone(F.lit(180.0))) == 60
    assert one(spark, s.utm_epsg(F.lit(-1.0), F.lit(3.0))) == 32731
    # a published check point: the origin of a zone, and symmetry around it
    x = one(spark, s.utm_forward(F.lit(0.0), F.lit(3.0)))
    assert (x.x, x.y) == (pytest.approx(500000, abs=1e-6), pytest.approx(0, abs=1e-6))
    a, b = one(spark, s.utm_forward(F.lit(52.0), F.lit(1.0))), one(spark, s.utm_forward(F.lit(52.0), F.lit(5.0)))
    assert a.x - 500000 == pytest.approx(500000 - b.x, abs=1e-6) and a.y == pytest.approx(b.y, abs=1e-6)
    assert one(spark, s.angle_between(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))) == 180
    assert one(spark, s.angle_between(F.lit(1.0), F.lit(0.0), F.lit(-1.0), F.lit(0.0), True)) == pytest.approx(0)
    assert one(spark, s.parallel_difference(F.lit(179.0), F.lit(1.0))) == pytest.approx(2)


def test_geometry(spark):
    ell = g.ring(*[(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (20, 0), (20, 8), (8, 8), (8, 20), (0, 20))])
    assert one(spark, g.ring_area(ell)) == 256
    assert one(spark, g.perimeter(ell)) == 80
    assert one(spark, g.reflex_count(ell)) == 1
    assert one(spark, g.is_convex(ell)) is False
    hole = g.ring(*[(F.lit(float(x)), F.lit(float(y))) for x, y in ((1, 1), (1, 3), (3, 3), (3, 1))])
    poly = F.struct(ell.alias("exterior"), F.array(hole).alias("holes"))
    assert one(spark, g.polygon_area(poly)) == 252
    e = g.edges(ell)[0]
    assert one(spark, g.trim_segment(e, 1.0)).length == 18
    assert one(spark, g.trim_segment(e, 10.0)) is None
    assert len(one(spark, g.sample_points(e, 6.0))) == 5
    assert one(spark, g.facing_score(e, g.point(F.lit(10), F.lit(-5)), F.lit(True))) == pytest.approx(1)
    local = one(spark, g.to_local(ell))
    assert (local[0].x, local[0].y) == (-10, -10)
    assert one(spark, g.svg_path(F.slice(ell, 1, 2))) == "M 0 0 L 20 0 Z"
