"""Class tables of roads, places and land, as data for functions.text.choose."""

# fixed values: recode tables
_get = lambda key: ["get", key]

ROAD_CLASS = [
    "case",
    ["==", _get("brunnel"), "ferry"], "ferry",
    ["all", ["==", _get("class"), "motorway"], ["==", _get("ramp"), 1]], "motorway_link",
    ["all", ["match", _get("class"), ["trunk", "primary", "secondary", "tertiary"], True, False], ["==", _get("ramp"), 1]], "link",
    ["match", _get("class"), "motorway", "motorway", "trunk", "trunk", "primary", "primary", "secondary", "secondary", "tertiary", "tertiary", "minor", "street", "service", "service", "track", "track",
     "path", "path", "pedestrian", "path", "steps", "path", "raceway", "street", "rail", "major_rail", "transit", "transit", "ferry", "ferry", "cable_car", "aerialway", "gondola", "aerialway", "street"],
]
CONSTRUCTION = [f"{c}_construction" for c in ("motorway", "trunk", "primary", "secondary", "tertiary", "minor", "path", "service", "track", "raceway")]
RAMPS = ["motorway", "trunk", "primary", "secondary", "tertiary"]
_RAMP = ["==", ["to-string", ["coalesce", _get("ramp"), 0]], "1"]
ROAD_CLASS_RESTORED = [
    "case",
    ["match", _get("class"), CONSTRUCTION, True, False], "construction",
    *(x for c in RAMPS for x in (["all", _RAMP, ["==", _get("class"), c]], f"{c}_link")),
    ["match", _get("class"), "motorway", "motorway", "trunk", "trunk", "primary", "primary", "secondary", "secondary", "tertiary", "tertiary", ["minor", "residential", "unclassified"], "street",
     "living_street", "street_limited", "service", "service", "track", "track", "path", "path", "raceway", "street", ["busway", "bus_guideway"], "primary", "rail", "major_rail", "transit", "transit",
     "ferry", "ferry", "motorway_junction", "motorway_junction", "street"],
]
ROAD_TYPE = [
    "match", _get("class"), "motorway_construction", "motorway", "trunk_construction", "trunk", "primary_construction", "primary", "secondary_construction", "secondary",
    "tertiary_construction", "tertiary", "minor_construction", "street", "path_construction", ["coalesce", _get("subclass"), "path"], "service_construction", "service",
    "track_construction", "track", "raceway_construction", "street", "path", ["coalesce", _get("subclass"), "path"], ["rail", "transit"], ["coalesce", _get("subclass"), _get("class")], _get("class"),
]
PLACE = [
    (["continent"], "continent"), (["country"], "country"), (["state", "province"], "state"), (["city", "town", "village", "hamlet", "isolated_dwelling"], "settlement"),
    (["borough", "suburb", "quarter", "neighbourhood"], "settlement_subdivision"),
]
LANDCOVER = [(["farmland"], "crop"), (["ice"], "snow")]
LANDUSE = [
    (["farmland", "farm", "farmyard", "orchard", "vineyard", "plant_nursery"], "agriculture"), (["forest", "wood"], "wood"), (["grass", "grassland", "meadow"], "grass"),
    (["scrub", "heath"], "scrub"), (["glacier"], "glacier"), (["pitch", "stadium", "sports_centre"], "pitch"), (["sand", "beach", "dune"], "sand"),
    (["park", "garden", "recreation_ground", "playground", "zoo", "golf_course"], "park"), (["aerodrome", "airport"], "airport"), (["cemetery", "grave_yard"], "cemetery"),
    (["hospital", "clinic"], "hospital"), (["school", "university", "college", "kindergarten"], "school"), (["commercial", "retail"], "commercial_area"),
    (["industrial", "quarry"], "industrial"), (["rock", "bare_rock", "scree"], "rock"), (["residential"], "residential"),
]
OVERLAY = [(["national_park", "nature_reserve", "protected_area", "park", "forest", "wood"], "national_park"), (["wetland", "wetland_noveg", "marsh", "swamp", "bog", "saltmarsh", "tidalflat"], "wetland")]
ADMIN_LEVEL = {"0": "2", "1": "4", "2": "6"}
RENAMED = {
    "structure": "brunnel", "shield": "ref", "house_num": "housenumber", "height": "render_height", "min_height": "render_min_height", "elevation_m": "ele", "filterrank": "rank",
    "symbolrank": "rank", "sizerank": "rank", "localrank": "rank", "iso_3166_1": "iso_a2", "mode": "subclass", "stop_type": "subclass",
}
