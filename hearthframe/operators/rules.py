"""Rules: building classes from tags, templates from shares, layer and insulation arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import literal_map

# Tags that mean "not set", and the tag values of service classes.
UNSET = ["", "no", "none", "null"]
TRADE_BUILDINGS = ["retail", "commercial", "supermarket", "mall"]
SCHOOL_AMENITIES = ["school", "kindergarten", "university", "college"]
SCHOOL_BUILDINGS = ["school", "university", "college"]
HEALTH_AMENITIES = ["hospital", "clinic", "doctors", "dentist", "pharmacy"]
HEALTH_BUILDINGS = ["hospital", "clinic"]
HOTEL_TOURISM = ["hotel", "hostel", "guest_house", "motel"]
FOOD_AMENITIES = ["restaurant", "cafe", "fast_food", "bar", "pub"]
SERVICE_TAGS = ["aeroway", "amenity", "industrial", "landuse", "leisure", "man_made", "office", "railway", "shop", "tourism"]

#: Shares of solar heat and light by glazing (fixed values).
OPTICS = {"single glazing": (0.85, 0.9), "double glazing": (0.7, 0.8), "triple glazing": (0.6, 0.7)}
OPTICS_ELSE = (0.7, 0.7)
LEAST_R = 1e-4
APARTMENT_HIGH = 9


def tag(x: Column) -> Column:
    return F.lower(F.trim(F.coalesce(x, F.lit(""))))


def is_set(x: Column) -> Column:
    return ~tag(x).isin(UNSET)


def service_class(building, amenity, shop, office, tourism, healthcare) -> Column:
    """The first service class whose rule holds, else null."""
    b, a, t = tag(building), tag(amenity), tag(tourism)
    return (
        F.when((b == "office") | is_set(office), "Offices")
        .when(is_set(shop) | b.isin(TRADE_BUILDINGS) | (a == "marketplace"), "Trade")
        .when(a.isin(SCHOOL_AMENITIES) | b.isin(SCHOOL_BUILDINGS), "Education")
        .when(a.isin(HEALTH_AMENITIES) | is_set(healthcare) | b.isin(HEALTH_BUILDINGS), "Health")
        .when(t.isin(HOTEL_TOURISM) | (b == "hotel") | a.isin(FOOD_AMENITIES), "HotelsRestaurants")
    )


def looks_non_residential(building: Column, service_values: list[str], tags: list[Column]) -> Column:
    return tag(building).isin(service_values) | F.exists(F.array(*[is_set(t) for t in tags]), lambda x: x)


def family_scores(shares: DataFrame, keys: list[str], element: str, name: str, share: str, families: DataFrame) -> DataFrame:
    """Sums of shares by family: one row a key with mass, wood, steel, metal.

    ``families``: rows (element, name, family). Shares that are not positive do not count.
    """
    known = shares.filter(F.col(share) > 0).join(families, [element, name], "left")
    return known.groupBy(*keys, element).agg(*[F.coalesce(F.sum(F.when(F.col("family") == f, F.col(share))), F.lit(0.0)).alias(f) for f in ("mass", "wood", "steel", "metal")])


def template_family(element: Column, material: dict[str, Column], method: dict[str, Column]) -> Column:
    """The family whose template an element takes.

    A family's weight is twice its materials' share plus its methods'. Only walls and roofs may be anything but mass.
    Metal comes before steel: either takes the element by any material of its own or by outweighing wood and
    mass. What is left is wood or mass by weight; equal weights make a roof wood and a wall mass.
    """
    both = {k: 2.0 * material[k] + method[k] for k in material}
    top = F.greatest(both["wood"], both["mass"])
    framed = lambda k: (material[k] > 0) | (both[k] > top)
    wins = F.when(element == "ROOF", both["wood"] >= both["mass"]).otherwise(both["wood"] > both["mass"])
    wood = (material["wood"] > material["mass"]) | (wins & ((material["wood"] > 0) | (method["wood"] > 0)))
    return F.when(~element.isin("WALL", "ROOF"), "mass").when(framed("metal"), "metal").when(framed("steel"), "steel").when(wood, "wood").otherwise("mass")


def layer_r(published: Column, thickness: Column, conductivity: Column) -> Column:
    """Thermal resistance: the published one, else thickness by conductivity; null if unknown."""
    return F.coalesce(published, F.when(conductivity > 0, thickness / conductivity))


def construction_u(layers: DataFrame, construction: str, r: str) -> DataFrame:
    """U-value of each construction; null where a layer's resistance is unknown."""
    known = F.count_if(F.col(r).isNull()) == 0
    return layers.groupBy(construction).agg(F.when(known, F.try_divide(F.lit(1.0), F.sum(r))).alias("u_value"), F.sum(r).alias("r_total"), F.count("*").alias("n_layers"))


def insulation(u_target: Column, r_fixed: Column) -> Column:
    """Struct (r_target, r_insulation, clamped) of the one layer that reaches the target."""
    target = 1.0 / u_target
    clamped = target - r_fixed <= LEAST_R
    return F.struct(target.alias("r_target"), F.when(clamped, F.lit(LEAST_R)).otherwise(target - r_fixed).alias("r_insulation"), clamped.alias("clamped"))


#: Insulation layers of templates (a fixed value).
INSULATION_PREFIX = "Typical Insulation"


def opaque_constructions(targets: DataFrame, layers: DataFrame, materials: DataFrame, key: str, prefix: str = INSULATION_PREFIX) -> tuple[DataFrame, DataFrame]:
    """(generated, failures): a template's layers with the one insulation that reaches a target.

    ``targets``: key, construction, u_target, mode (replace or insert), donor, insert_after. ``layers``: construction,
    position from zero, material, r. ``materials``: material. ``replace`` needs exactly one layer whose name begins
    with ``prefix``; ``insert`` puts the donor (default: the prefix itself) behind position ``insert_after`` or
    last. Generated rows have r_fixed, r_target, r_insulation, clamped, layers (the insulation named after the key),
    u_value and u_diff; failures have the first ``error`` found.
    """
    is_ins = F.col("material").startswith(prefix)
    entry = F.struct("position", "material")
    template = layers.groupBy("construction").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["material"]).alias("__layers"),
        F.sum("r").alias("__r_all"),
        F.count_if(F.col("r").isNull()).alias("__unknown"),
        F.count_if(is_ins).alias("__n"),
        F.coalesce(F.sum(F.when(is_ins, F.col("r"))), F.lit(0.0)).alias("__r_ins"),
        F.max(F.when(is_ins, F.col("material"))).alias("__own"),
    )
    replace, insert = F.col("mode") == "replace", F.col("mode") == "insert"
    rows = targets.join(template, "construction", "left").withColumn("__donor", F.when(replace, F.col("__own")).otherwise(F.coalesce("donor", F.lit(prefix))))
    known = materials.select(F.col("material").alias("__donor")).distinct().withColumn("__found", F.lit(True))
    rows = rows.join(known, "__donor", "left")
    error = (
        F.when(~F.coalesce(replace | insert, F.lit(False)), F.concat(F.lit("unsupported mode "), F.coalesce("mode", F.lit("null"))))
        .when(F.col("__layers").isNull(), "unknown construction")
        .when(replace & (F.col("__n") != 1), F.format_string("expected one insulation layer, found %d", F.col("__n")))
        .when(F.col("__found").isNull(), "unknown donor")
        .when(F.col("__unknown") > 0, "unknown resistance")
        .when(~F.coalesce(F.col("u_target") > 0, F.lit(False)), "no target")
    )
    rows = rows.withColumn("error", error)
    name = F.concat(F.lit("insulation "), F.col(key).cast("string"))
    size = F.size("__layers")
    at = F.least(F.coalesce(F.col("insert_after") + 1, size), size)
    own = F.when(replace, F.transform("__layers", lambda x: F.when(x.startswith(prefix), name).otherwise(x))).otherwise(F.concat(F.slice("__layers", F.lit(1), at), F.array(name), F.slice("__layers", at + 1, size)))
    fixed = F.when(replace, F.col("__r_all") - F.col("__r_ins")).otherwise(F.col("__r_all"))
    good = rows.filter("error IS NULL").withColumns({"r_fixed": fixed, "layers": own})
    good = good.withColumn("__s", insulation(F.col("u_target"), F.col("r_fixed"))).withColumn("u_value", 1.0 / (F.col("r_fixed") + F.col("__s.r_insulation")))
    out = good.select(key, "construction", "u_target", "mode", "r_fixed", "__s.r_target", "__s.r_insulation", "__s.clamped", "layers", "u_value", F.abs(F.col("u_value") - F.col("u_target")).alias("u_diff"))
    return out, rows.filter("error IS NOT NULL").select(key, "u_target", "error")


def optics(glazing: Column) -> Column:
    table = literal_map({k: v[0] for k, v in OPTICS.items()}), literal_map({k: v[1] for k, v in OPTICS.items()})
    key = F.lower(F.trim(glazing))
    return F.struct(F.coalesce(F.try_element_at(table[0], key), F.lit(OPTICS_ELSE[0])).alias("shgc"), F.coalesce(F.try_element_at(table[1], key), F.lit(OPTICS_ELSE[1])).alias("vt"))


def program_candidates(vintage: Column, residential: Column, levels: Column, archetype: Column, space: Column, default: str = "2016", high: int = APARTMENT_HIGH) -> Column:
    """Program names in order of preference, without repeats."""
    v = F.when(F.trim(F.coalesce(vintage, F.lit(""))) == "", F.lit(default)).otherwise(F.trim(vintage))
    main = F.when(residential, F.when(levels >= high, "HighriseApartment").otherwise("MidriseApartment")).otherwise(archetype)
    other = F.when(residential, F.when(levels >= high, "MidriseApartment").otherwise("HighriseApartment"))
    kind = F.when(residential, "Apartment").otherwise(space)
    name = lambda a, b: F.concat_ws("::", a, b, kind)
    return F.array_distinct(F.array_compact(F.array(name(v, main), name(F.lit(default), main), F.when(other.isNotNull(), name(v, other)), F.when(other.isNotNull(), name(F.lit(default), other)))))


def first_installed(candidates: Column, installed: Column) -> Column:
    return F.try_element_at(F.filter(candidates, lambda c: F.array_contains(installed, c)), F.lit(1))


#: Ideal air systems of all rooms (fixed values).
IDEAL_AIR = {"economizer": "DifferentialDryBulb", "ventilation_on_demand": False, "sensible_recovery": 0.0, "latent_recovery": 0.0, "heating_air_c": 50.0, "cooling_air_c": 13.0}


def programs(buildings: DataFrame, candidates: Column, installed: DataFrame, program: str = "program") -> tuple[DataFrame, DataFrame]:
    """(buildings with their program, its type, whether it is a fallback, and the ideal air system; buildings no program fits).

    The first candidate that is installed wins.
    """
    rows = buildings.withColumns({"__c": candidates, "__row": F.monotonically_increasing_id()})
    each = rows.select("__row", F.posexplode("__c").alias("__at", program)).join(installed.select(program).distinct(), program)
    first = each.groupBy("__row").agg(F.min(F.struct("__at", program)).alias("__m"))
    both = rows.join(first, "__row", "left").withColumns({program: F.col(f"__m.{program}"), "program_type": F.split_part(F.col(f"__m.{program}"), F.lit("::"), F.lit(2)), "fallback": F.col("__m.__at") > 0})
    named = both.filter("__m IS NOT NULL").drop("__c", "__row", "__m").withColumns({k: F.lit(v) for k, v in IDEAL_AIR.items()})
    return named, both.filter("__m IS NULL").select(*buildings.columns, F.array_join("__c", "; ").alias("candidates"))
