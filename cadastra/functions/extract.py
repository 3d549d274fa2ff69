"""Column expressions that read listings: surfaces, features, prices, places, ratings, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadastra.functions import fixed, text

# Patterns of surfaces in a description.
COVERED = r"(?i)([0-9]+)\s*m[²2]?\s*(?:de\s+)?(?:surface?\s+)?(?:couverte?|habitable?|bâtie?|living)"
GARDEN = r"(?i)([0-9]+)\s*m[²2]?\s*(?:de\s+)?(?:jardin|terrasse|balcon)"
LAND = r"(?i)([0-9]+)\s*m[²2]?\s*(?:de\s+)?(?:terrain|lot)"
ANY_SURFACE = r"(?i)([0-9]+)\s*m[²2]"
# Patterns of further features.
FLOOR = r"(?i)([0-9]+)[eè]?(?:r|ème|er|eme)?\s+étage"
GROUND = r"(?i)rez\s*[-–]?\s*de\s*[-–]?\s*chauss[ée]e"
STANDING = r"(?i)(haut\s+standing|standing|luxe|luxury)"
BUILT = r"(?i)(?:construi[t]?\s+en|ann[ée]e?\s+(?:de\s+)?construction\s*:?\s*)\s*([0-9]{4})"
NEW, RENOVATED, OLD = r"(?i)\b(?:neuf|new)\b", r"(?i)\b(?:rénov[eé]|réhabilit|renovated)", r"(?i)\bancien\b"
PRICE = r"([0-9][0-9\s]*?)\s*TND"
PLACE = r"([A-Z][a-z-]{2,25}),\s*([A-Z][a-z-]{2,20})\s+[0-9]+\s*m"
# Patterns of rooms.
SALON_PLUS = r"(?i)\bS\+([0-9]+)\b"
BEDROOMS, ROOMS = r"(?i)([0-9]+)\s*(?:chambre?s?|bedroom)", r"(?i)([0-9]+)\s*(?:pi[èe]ce?s?|room)"
BATHS, SALONS = r"(?i)([0-9]+)\s*(?:salle?s?\s*(?:de\s*bain?|d'eau)|sdb)", r"(?i)([0-9]+)\s*(?:salon|living)"
NEW_BUILDING = r"(?:immo|projet)\s*neuf"
ROOM_SHORT = r"(?i)^App[.\s]*([0-9]+)\s*Pic$"


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def whole(c: Column, pattern: str) -> Column:
    return found(c, pattern).try_cast("int")


def surfaces(c: Column) -> dict[str, Column]:
    """Covered (else the first surface named), garden and land surface of a description."""
    return {"covered": F.coalesce(whole(c, COVERED), whole(c, ANY_SURFACE)), "garden": whole(c, GARDEN), "land": whole(c, LAND)}


def features(c: Column) -> dict[str, Column]:
    """Floor, furnished, parking, pool, lift, standing, year of construction and state."""
    has = lambda *words: text.contains_any(F.lower(c), list(words))
    return {
        "floor": F.coalesce(whole(c, FLOOR), F.when(c.rlike(GROUND), 0)),
        "furnished": has("meublé", "meuble", "furnished"),
        "parking": has("parking", "garage"),
        "pool": has("piscine", "pool"),
        "lift": has("ascenseur", "elevator"),
        "standing": F.lower(found(c, STANDING)),
        "built": whole(c, BUILT),
        "state": F.when(c.rlike(NEW), "neuf").when(c.rlike(RENOVATED), "rénové").when(c.rlike(OLD), "ancien"),
    }


def let(value: Column, then) -> Column:
    """then(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def guarded(value: Column, low: float, high: float) -> Column:
    """The value within its bounds, else null."""
    return F.when(value.between(low, high), value)


def price(c: Column) -> Column:
    """A price in dinars with spaces between its digits, from 10,000 to 100,000,000."""
    return guarded(F.regexp_replace(found(c, PRICE), r"\s+", "").try_cast("double"), 10_000, 100_000_000)


def filled(own: Column, other: Column) -> Column:
    """The value, or the other one where it is null or 0."""
    return F.coalesce(F.nullif(own, F.lit(0).cast("double")), other.cast("double"), own)


def room_shorthand(c: Column) -> tuple[Column, Column]:
    """(type, rooms) of 'App. 3 Pic' and 'Surfaces'."""
    n = whole(F.trim(c), ROOM_SHORT)
    return F.when(n.isNotNull(), "Appartement").when(F.trim(c).rlike(r"(?i)^Surfaces?$"), "Terrain"), n


def rooms(c: Column) -> dict[str, Column]:
    """Type (S+N), bedrooms, rooms, baths and salons of a description; S+N has N bedrooms and N + 1 rooms, whatever else is said."""
    n = whole(c, SALON_PLUS)
    return {"kind": F.concat(F.lit("S+"), n.cast("string")), "bedrooms": F.coalesce(n, whole(c, BEDROOMS)), "rooms": F.coalesce(n + 1, whole(c, ROOMS)), "baths": whole(c, BATHS), "salons": whole(c, SALONS)}


def property_type(c: Column, surface: Column, n_rooms: Column, description: Column) -> Column:
    """A property's type: by a room shorthand, of new buildings by size, by the first word of a type, else as it is said; 'Autre' by the description's words, then the surface."""
    v = F.lower(F.trim(c))
    named = F.when(F.lit(False), F.lit(None).cast("string"))
    for word, kind in fixed.TYPE_NAMES.items():
        named = named.when(v.contains(word), F.lit(kind))
    large = F.coalesce((surface > 150) | (n_rooms > 4), F.coalesce(surface > 150, F.lit(False)) | F.coalesce(n_rooms > 4, F.lit(False)))
    own = F.coalesce(room_shorthand(c)[0], F.when(v.rlike(NEW_BUILDING), F.when(large, "Maison").otherwise("Appartement")), F.when(v == "autre", "Autre"), named, F.initcap(F.trim(c)))
    other = F.coalesce(text.first_match(F.lower(F.coalesce(description, F.lit(""))), fixed.TYPE_WORDS, None), F.when(surface > 500, "Terrain").when((surface < 30) & (surface != 0), "Chambre"), F.lit("Autre"))
    return F.when(c.isNotNull(), F.when(own == "Autre", other).otherwise(own))


def _without_deal(v: Column) -> Column:
    out = v
    for p in reversed(fixed.CITY_PREFIXES):
        out = F.when(v.startswith(p), F.trim(F.substring(v, F.lit(len(p) + 1), F.length(v)))).otherwise(out)
    return out


def _without_date(v: Column) -> Column:
    head = F.trim(F.get(F.split(v, ","), F.lit(0)))
    return F.when(~text.contains_any(v, fixed.RELATIVE_WORDS), v).when(v.contains(",") & (F.length(head) > 1), head)


def _of_address(v: Column) -> Column:
    known = F.lit(None).cast("string")
    for k in reversed(fixed.ADDRESS_CITIES):
        known = F.when(v.contains(k), k).otherwise(known)
    return F.when((F.length(v) > 45) & v.rlike("[0-9]"), known).otherwise(v)


def _corrected(v: Column) -> Column:
    typos = F.create_map(*[F.lit(x) for pair in fixed.CITY_TYPOS.items() for x in pair])
    return F.when(~v.isin(fixed.NO_CITIES), F.coalesce(F.try_element_at(typos, v), v))


def city(c: Column) -> Column:
    """A city: without noise and the words of a deal before it, the part before a relative date, a known city of a long address, and without typing errors."""
    v = F.lower(F.trim(text.strip_noise(c)))
    for step in (_without_deal, _without_date, _of_address, _corrected, lambda v: F.when(F.length(v) >= 2, F.trim(v))):
        v = let(v, step)
    return v


def region(c: Column, default: str | None = None) -> Column:
    """The first region, in their fixed order, that a text names."""

    def named(t: Column) -> Column:
        out = F.lit(default).cast("string")
        for name in reversed(fixed.REGIONS):
            out = F.when(t.contains(name.lower()), name).otherwise(out)
        return out

    return let(F.lower(c), named)


def image_quality(url: Column, source: Column, n_filled: Column, price_ok: Column, liquidity: Column, real: Column) -> Column:
    """Weighted sum of eight signs of a good picture, from 0 to 1."""
    low, linked = F.lower(url), url.startswith("http")
    has = lambda *words: text.contains_any(low, list(words))
    ends = lambda *words: F.get(F.split(low, r"\?"), F.lit(0)).rlike("(?:" + "|".join(words) + ")$")
    known = F.lit(0.40)
    for k, q in reversed(fixed.SOURCE_QUALITY.items()):
        known = F.when(F.lower(source).contains(k), q).otherwise(known)
    parts = [
        (F.when(linked, 1.0).otherwise(0.0), 0.20),
        (real * 0.60 + known * 0.40, 0.20),
        (F.when(ends("[.]jpg", "[.]jpeg"), 1.0).when(ends("[.]png"), 0.8).when(ends("[.]webp"), 0.6).when(linked, 0.3).otherwise(0.0), 0.10),
        (F.round(n_filled / 7.0, 4), 0.20),
        (F.when(has("large", "hd", "high", "1200", "800", "full"), 1.0).when(has("medium", "med", "600", "400"), 0.6).when(has("thumb", "small", "tiny", "150", "200"), 0.3).when(linked, 0.5).otherwise(0.0), 0.10),
        (F.when(url.rlike(r"[_/-][0-9]{1,2}[_/.-]"), 1.0).when(linked, 0.5).otherwise(0.0), 0.05),
        (price_ok, 0.10),
        (F.round(F.coalesce(liquidity, F.lit(0.3)), 4), 0.05),
    ]
    return F.round(F.greatest(F.least(sum((x * w for x, w in parts), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)), 4)


def rating(c: Column) -> Column:
    """A rating like 4,5 or '4 étoiles'; 0 without one."""
    return F.coalesce(F.replace(found(c, r"([0-9][,.][0-9])"), F.lit(","), F.lit(".")).try_cast("double"), found(c, r"([0-9])\s+étoile").try_cast("double"), F.lit(0.0))


def reviews(c: Column) -> Column:
    """A number of reviews with spaces or commas between its digits; 0 without one."""
    return F.coalesce(found(F.regexp_replace(c, "[  ,]", ""), "([0-9]+)").try_cast("long"), F.lit(0))


def image_links(links: Column, root: str) -> Column:
    """Absolute links of pictures, without icons; full sizes if there are any."""
    whole_ = F.transform(links, lambda x: F.when(x.startswith("http"), x).when(x.startswith("//"), F.concat(F.lit("https:"), x)).otherwise(F.concat(F.lit(root), x)))
    pictures = F.filter(whole_, lambda x: ~F.lower(x).rlike("icon|spacer|logo") & F.lower(x).rlike("[.](?:jpg|jpeg|png|webp|gif)"))
    full = F.filter(pictures, lambda x: ~F.lower(x).contains("thumb"))
    return F.when(F.size(full) > 0, full).otherwise(pictures)


def contract_type(c: Column) -> tuple[Column, Column]:
    """(type, subtype) of a contract by ordered words."""
    n = F.lower(text.arabic(c))
    has, norm = (lambda *w: text.contains_any(c, list(w))), (lambda *w: text.contains_any(n, list(w)))
    rent = has("كراء", "تسويغ") | norm("ايجار")
    rules = [
        (has("وعد بالبيع") | norm("وعد بالبيع"), "وعد بالبيع", "وعد"),
        (norm("وكاله") | has("وكالة"), "وكالة عقارية", "وكالة"),
        (has("بيع عقار مبني") | (has("بيع") & has("مبني")), "بيع عقار مبني", "بيع"),
        (has("بيع") & (norm("ارض", "قطعه", "فلاح") | has("أرض")), "بيع أرض", "بيع"),
        (has("بيع") & norm("ابقار", "ماشيه", "بومنيار"), "بيع منقول", "بيع"),
        (has("بيع"), "بيع عقاري", "بيع"),
        (rent & has("سكني", "سكنى", "مسكن"), "كراء سكني", "كراء"),
        (rent & has("تجاري", "تجارة", "محل"), "كراء تجاري", "كراء"),
        (rent & has("مهني", "مكتب", "شركة"), "كراء مهني", "كراء"),
        (rent, "كراء مختلط", "كراء"),
    ]
    kind, sub = F.lit("عقد غير مصنف"), F.lit("أخرى")
    for test, a, b in reversed(rules):
        kind, sub = F.when(test, a).otherwise(kind), F.when(test, b).otherwise(sub)
    return kind, sub
