"""Golden cases of the listing patterns: a hit and a miss of each."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cadastra.functions import dates, extract, fixed, text
from cadastra.sources import listings

SURFACES = [
    # text, covered, garden, land
    ("Villa 200 m² couverte, 350 m² jardin, 600m2 terrain", 200, 350, 600),
    ("120m habitable", 120, None, None),
    ("85 M² de surface bâtie", 85, None, None),
    ("surface 90 m²", 90, None, None),  # the first surface named stands in
    ("40 m2 de terrasse et 12 m² balcon", 40, 40, None),
    ("Lot 5, 400 m² lot", 400, None, 400),
    ("m² couverte", None, None, None),
    ("à 300 km de la mer", None, None, None),
    (None, None, None, None),
]
FEATURES = [
    # text, floor, furnished, parking, pool, lift, standing, built, state
    ("3ème étage meublé, ascenseur", 3, True, False, False, True),
    ("au Rez-de-chaussée avec garage", 0, False, True, False, False),
    ("rez de chaussee, piscine", 0, False, False, True, False),
    ("étage noble", None, False, False, False, False),
    ("1er  étage furnished pool elevator parking", 1, True, True, True, True),
]
ROOMS = [
    # text, kind, bedrooms, rooms, baths, salons
    ("S+2 lumineux, 5 chambres, 9 pièces", "S+2", 2, 3, None, None),
    ("s+3 avec 2 salles de bain", "S+3", 3, 4, 2, None),
    ("XS+4", None, None, None, None, None),
    ("4 Chambres 6 pieces 1 salon 3 SDB", None, 4, 6, 3, 1),
    ("2 bedrooms, 5 rooms, 1 living", None, 2, 5, None, 1),
    ("1 salle d'eau", None, None, None, 1, None),
    ("chambres et salons", None, None, None, None, None),
    ("", None, None, None, None, None),
]
TYPES = [
    # said, surface, rooms, description, type
    ("App. 3 Pic", None, None, None, "Appartement"),
    ("Surfaces", None, None, None, "Terrain"),
    ("Immo neuf", 160.0, None, None, "Maison"),
    ("Immo neuf", 90.0, 5, None, "Maison"),
    ("projet  neuf", 90.0, 4, None, "Appartement"),
    ("autre", 20.0, None, "belle OLIVERAIE", "Ferme"),
    ("AUTRE", 501.0, None, "rien", "Terrain"),
    (" autre ", 29.0, None, None, "Chambre"),
    ("autre", 0.0, None, None, "Autre"),
    ("bel s+2", None, None, None, "Appartement"),
    ("fonds de commerce", None, None, None, "Local Commercial"),
    ("grand plateau", None, None, None, "Grand Plateau"),
    (None, 900.0, None, None, None),
]
PRICES = [("prix 250 000 TND", 250_000.0), ("12 TND", None), ("999 999 999 TND", None), ("sans prix", None), (None, None)]
CITIES = [("Tunis - La Marsa", "la marsa"), ("Sfax - Sakiet Ezzit", "sakiet ezzit"), ("Nabeul - Hammamet", "hammamet"), ("La Marsa", "la marsa"), ("Tunis", "tunis"), (None, None)]
DATES = [
    ("25/12/2024 09:30", "2024-12-25 09:30"), ("1/2/2024", "2024-02-01 00:00"), ("2024-03-05 10:11:12.345678", "2024-03-05 10:11"), ("2024-03-05 10:11", "2024-03-05 10:11"), (" 2024-03-05 ", "2024-03-05 00:00"),
    ("05-03-2024", "2024-03-05 00:00"), ("2024/03/05", "2024-03-05 00:00"), ("5.3.2024", "2024-03-05 00:00"), ("2024-03-05T06:07:08", "2024-03-05 06:07"), ("13/13/2024", None), ("hier", None), (None, None),
]
PHRASES = [
    ("Pieds dans l eau", "bord mer front mer vue mer luxe"),
    ("dar el baraka", "maison benediction luxe haut gamme prestige"),  # standing, put in by one phrase, gives way to another
    ("S+3 à la Marsa", "appartement trois chambres a la marsa balneare prestige"),
    ("Résidence fermée", "residence securisee gardiennage luxe haut gamme prestige"),  # the longer phrase went first
    ("rien du tout", "rien du tout"),
]


def shown(spark, rows, kinds, columns):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {kinds}")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_surfaces(spark):
    assert shown(spark, [r[:1] for r in SURFACES], "t string", list(extract.surfaces(F.col("t")).values())) == [r[1:] for r in SURFACES]


def test_features(spark):
    f = extract.features(F.col("t"))
    assert shown(spark, [r[:1] for r in FEATURES], "t string", [f[k] for k in ("floor", "furnished", "parking", "pool", "lift")]) == [r[1:] for r in FEATURES]


def test_rooms(spark):
    assert shown(spark, [r[:1] for r in ROOMS], "t string", list(extract.rooms(F.col("t")).values())) == [r[1:] for r in ROOMS]


def test_property_types(spark):
    c = F.col
    got = shown(spark, [r[:4] for r in TYPES], "t string, surface double, rooms int, d string", [extract.property_type(c("t"), c("surface"), c("rooms"), c("d"))])
    assert [x for (x,) in got] == [r[4] for r in TYPES]


@pytest.mark.parametrize(("cases", "column"), [(PRICES, lambda c: extract.price(c)), (CITIES, lambda c: listings.after_dash(c)), (DATES, lambda c: F.date_format(dates.parse(c), "yyyy-MM-dd HH:mm")), (PHRASES, lambda c: text.replace_phrases(text.fold_accents(c), fixed.PHRASES))], ids=["price", "city", "date", "phrases"])
def test_values(spark, cases, column):
    assert [x for (x,) in shown(spark, [r[:1] for r in cases], "t string", [column(F.col("t"))])] == [r[1] for r in cases]


def test_the_phrases_go_by_length(spark):
    """Every phrase alone gives what plain replacing in order of length gives."""
    order = sorted(fixed.PHRASES, key=len, reverse=True)
    for phrase in fixed.PHRASES:
        want = phrase
        for k in order:
            want = want.replace(k, fixed.PHRASES[k])
        fixed_ = spark.range(1).select(text.replace_phrases(F.lit(phrase), fixed.PHRASES).alias("x")) if len(phrase) > 14 else None
        assert fixed_ is None or fixed_.first()["x"] == want
