"""Kinds and labels of mapped objects. Fixed values throughout this file."""

from __future__ import annotations

from typing import NamedTuple


class Kind(NamedTuple):
    """Tags that make an object of a kind: one of values under key, none of exclude, and all of require present."""

    key: str
    values: tuple[str, ...]
    label: str
    exclude: tuple[tuple[str, tuple[str, ...]], ...] = ()
    require: tuple[str, ...] = ()


NOT_LOOKOUTS = ("communication", "communications", "transmission", "water_tower", "cooling", "chimney")

#: In order of precedence: an object is of the first kind that fits.
POI_KINDS: dict[str, Kind] = {
    "church": Kind("amenity", ("place_of_worship",), "place of worship"),
    "shrine": Kind("historic", ("wayside_shrine", "wayside_cross"), "shrine"),
    "ruins": Kind("historic", ("ruins",), "ruin"),
    "castle": Kind("historic", ("castle", "fort"), "castle"),
    "memorial": Kind("historic", ("memorial", "monument"), "memorial"),
    "archaeology": Kind("historic", ("archaeological_site",), "archaeological site"),
    "boundary_stone": Kind("historic", ("boundary_stone",), "boundary stone"),
    "mill": Kind("man_made", ("windmill", "watermill"), "mill"),
    "mine": Kind("man_made", ("adit", "mineshaft"), "mine entrance"),
    "peak": Kind("natural", ("peak",), "peak"),
    "rock": Kind("natural", ("rock", "arch", "stone"), "rock"),
    "sinkhole": Kind("natural", ("sinkhole",), "sinkhole"),
    "cave": Kind("natural", ("cave_entrance",), "cave"),
    "spring": Kind("natural", ("spring",), "spring"),
    "drinking_water": Kind("amenity", ("drinking_water",), "drinking water"),
    "waterfall": Kind("waterway", ("waterfall",), "waterfall"),
    "viewpoint": Kind("tourism", ("viewpoint",), "viewpoint"),
    "tower": Kind("man_made", ("tower",), "tower", exclude=(("tower:type", NOT_LOOKOUTS),)),
    "tree": Kind("natural", ("tree",), "named tree", require=("name",)),
    "museum": Kind("tourism", ("museum",), "museum"),
    "artwork": Kind("tourism", ("artwork",), "artwork"),
    "hut": Kind("tourism", ("alpine_hut", "wilderness_hut"), "mountain hut"),
    "shelter": Kind("amenity", ("shelter",), "shelter", exclude=(("shelter_type", ("public_transport",)), ("highway", ("bus_stop",)))),
    "picnic": Kind("tourism", ("picnic_site",), "picnic site"),
    "firepit": Kind("leisure", ("firepit",), "fire pit"),
    "camp": Kind("tourism", ("camp_site",), "campsite"),
    "refreshment": Kind("amenity", ("pub", "restaurant", "cafe"), "pub/restaurant"),
    "toilets": Kind("amenity", ("toilets",), "toilets"),
}
#: Kind: (key, value, label, is rail).
TRANSIT_KINDS = {
    "station": ("railway", "station", "train station", True),
    "halt": ("railway", "halt", "train halt", True),
    "tram_stop": ("railway", "tram_stop", "tram stop", False),
    "bus_stop": ("highway", "bus_stop", "bus stop", False),
}
RIDE_UP = ("chair_lift", "gondola", "cable_car", "mixed_lift")
SURFACE_LABELS = {
    "asphalt": "asphalt", "paved": "paved", "concrete": "concrete", "paving_stones": "paving stones", "sett": "sett (cobbles)", "cobblestone": "cobblestone",
    "compacted": "compacted gravel", "fine_gravel": "fine gravel", "gravel": "gravel", "pebblestone": "pebbles", "unpaved": "unpaved", "ground": "ground",
    "dirt": "dirt", "earth": "earth", "grass": "grass", "sand": "sand", "rock": "rock", "wood": "boardwalk",
}
#: Parts of an address that name a place, in order.
PLACE_KEYS = ("village", "town", "city", "hamlet", "municipality", "suburb", "city_district", "locality", "isolated_dwelling", "county", "state")
