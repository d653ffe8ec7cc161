"""Classification of tagged objects: columns from a map of tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sets and tables of tag values.
MAJOR = ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link")
MINOR = ("residential", "unclassified", "living_street", "service", "road")
PATH = ("footway", "path", "cycleway", "track", "pedestrian", "bridleway")
EXCLUDED_SERVICES = ("parking_aisle", "driveway", "drive-through", "emergency_access")
NO_FOOT = ("no", "private", "use_sidepath")
NO_ACCESS = ("private", "no", "agricultural", "forestry", "delivery", "military")
FOOT_ALLOWED = ("yes", "designated", "permissive")
RAIL_MODES = ("train", "subway", "light_rail", "tram", "monorail")
SURFACES = {
    "paved": ("asphalt", "paved", "concrete", "concrete:plates", "concrete:lanes", "paving_stones", "chipseal", "tartan", "rubber", "acrylic"),
    "compacted": ("compacted", "fine_gravel"),
    "gravel": ("gravel", "pebblestone"),
    "cobbles": ("sett", "cobblestone", "unhewn_cobblestone"),
    "unpaved": ("unpaved", "ground", "dirt", "earth", "grass", "mud", "sand", "soil", "woodchips", "grass_paver"),
}
TRACKTYPES = {"grade1": "compacted", "grade2": "gravel", "grade3": "unpaved", "grade4": "unpaved", "grade5": "unpaved"}
LIT_YES = ("yes", "24/7", "automatic", "sunset-sunrise", "limited", "interval")
LIT_NO = ("no", "disused")
WATER_NATURAL, WATER_LANDUSE = ("water", "wetland"), ("reservoir", "basin")
PARK_LEISURE = ("park", "garden", "nature_reserve", "common", "recreation_ground", "golf_course")
GREEN_LANDUSE = ("grass", "recreation_ground", "forest", "meadow", "village_green", "cemetery")
GREEN_NATURAL = ("wood", "scrub", "grassland")
RUNNING_SPORTS = ("athletics", "running")
TRACK_SURFACES = ("tartan", "rubber")
FACILITY_LEISURE, FACILITY_AMENITY = ("stadium", "sports_centre", "sports_hall"), ("school", "college", "university")
RESTRICTED_AMENITY = ("school", "college")
PUBLIC_ACCESS = ("yes", "permissive", "designated", "public")
RESTRICTED_ACCESS = ("no", "private", "customers", "members", "permit")
STANDARD_LAPS_M = (200.0, 250.0, 300.0, 1000.0 / 3.0, 400.0)
LAP_TOLERANCE = 0.2


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def among(value: Column, values: tuple[str, ...]) -> Column:
    """Membership; a missing value is no member."""
    return F.coalesce(value.isin(*values), F.lit(False))


def equals(value: Column, other: str) -> Column:
    return F.coalesce(value == other, F.lit(False))


def is_rail_platform(tags: Column) -> Column:
    rail = F.lit(False)
    for mode in RAIL_MODES:
        rail = rail | equals(tag(tags, mode), "yes")
    return equals(tag(tags, "railway"), "platform") | (equals(tag(tags, "public_transport"), "platform") & rail)


def classify_way(tags: Column) -> Column:
    """``major``, ``minor``, ``path`` or null; major ways are barriers whatever their access."""
    highway, foot = tag(tags, "highway"), tag(tags, "foot")
    closed = (
        equals(tag(tags, "area"), "yes")
        | among(tag(tags, "service"), EXCLUDED_SERVICES)
        | among(foot, NO_FOOT)
        | (among(tag(tags, "access"), NO_ACCESS) & ~among(foot, FOOT_ALLOWED))
        | equals(tag(tags, "oneway:foot"), "yes")
        | F.map_contains_key(tags, "aeroway")
        | is_rail_platform(tags)
    )
    return F.when(among(highway, MAJOR), "major").when(~closed & among(highway, MINOR), "minor").when(~closed & among(highway, PATH), "path")


def is_underground(tags: Column) -> Column:
    def below(key: str) -> Column:
        return F.coalesce(F.split_part(tag(tags, key), F.lit(";"), F.lit(1)).try_cast("double") < 0, F.lit(False))

    tunnel = F.coalesce(tag(tags, "tunnel") != "no", F.lit(False))
    return below("layer") | below("level") | equals(tag(tags, "location"), "underground") | tunnel


def structure_of(tags: Column) -> Column:
    """``bridge`` before ``tunnel``, or null."""
    bridge = F.coalesce(tag(tags, "bridge") != "no", F.lit(False))
    tunnel = F.coalesce(tag(tags, "tunnel") != "no", F.lit(False)) | equals(tag(tags, "covered"), "yes")
    return F.when(bridge, "bridge").when(tunnel, "tunnel")


def surface_category(surface: Column, tracktype: Column, road_class: Column) -> Column:
    """A present surface decides alone; then the track type; minor roads are taken as paved."""
    known = F.lit("unknown")
    for name, values in SURFACES.items():
        known = F.when(among(surface, values), name).otherwise(known)
    table = F.create_map(*(F.lit(x) for pair in TRACKTYPES.items() for x in pair))
    rest = F.coalesce(F.try_element_at(table, tracktype), F.when(road_class == "minor", "paved").otherwise("unknown"))
    return F.when(surface.isNotNull(), known).otherwise(rest)


def lit_category(lit: Column) -> Column:
    return F.when(among(lit, LIT_YES), "yes").when(among(lit, LIT_NO), "no").otherwise("unknown")


def setting_kind(tags: Column) -> Column:
    natural, landuse = tag(tags, "natural"), tag(tags, "landuse")
    water = among(natural, WATER_NATURAL) | among(landuse, WATER_LANDUSE)
    green = among(landuse, GREEN_LANDUSE) | among(natural, GREEN_NATURAL)
    return F.when(water, "water").when(among(tag(tags, "leisure"), PARK_LEISURE), "park").when(green, "green")


def values_of(value: Column) -> Column:
    """The trimmed, non-empty values of a semicolon list; empty if missing."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), ";"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def is_running_track(tags: Column) -> Column:
    sports = values_of(tag(tags, "sport"))
    runs = F.arrays_overlap(sports, F.array(*map(F.lit, RUNNING_SPORTS)))
    return equals(tag(tags, "leisure"), "track") & F.when(F.size(sports) > 0, runs).otherwise(among(tag(tags, "surface"), TRACK_SURFACES))


def is_facility(tags: Column) -> Column:
    return among(tag(tags, "leisure"), FACILITY_LEISURE) | among(tag(tags, "amenity"), FACILITY_AMENITY)


def access_category(tags: Column) -> Column:
    foot, access = tag(tags, "foot"), tag(tags, "access")
    return (
        F.when(among(foot, PUBLIC_ACCESS), "public")
        .when(among(foot, RESTRICTED_ACCESS), "restricted")
        .when(among(access, PUBLIC_ACCESS), "public")
        .when(among(access, RESTRICTED_ACCESS) | among(tag(tags, "amenity"), RESTRICTED_AMENITY), "restricted")
        .otherwise("unknown")
    )


def is_indoor(tags: Column, facility: Column) -> Column:
    building = F.coalesce(tag(tags, "building") != "no", F.lit(False))
    hall = equals(tag(facility, "leisure"), "sports_hall")
    return equals(tag(tags, "indoor"), "yes") | equals(tag(tags, "covered"), "yes") | building | hall


def is_car_free(road_class: Column, footway: Column) -> Column:
    return (road_class == "path") & ~among(footway, ("sidewalk", "crossing"))


def lap_length(length: Column) -> Column:
    """The standard lap with the smallest relative gap, the first on ties; null beyond the tolerance."""
    laps = F.array(*(F.struct((F.abs(length - lap) / lap).alias("gap"), F.lit(i).alias("i"), F.lit(lap).alias("lap")) for i, lap in enumerate(STANDARD_LAPS_M)))
    best = F.array_min(laps)
    return F.when(best["gap"] <= LAP_TOLERANCE, best["lap"])
