"""Small constant maps. Fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from canvass.session import local_table

REGION_STATES = {
    "New England": "ME VT NH MA CT RI",
    "NY and NJ": "NY NJ",
    "Mid-Atlantic": "PA MD DE DC VA WV",
    "Southeast": "KY TN NC SC GA AL MS FL",
    "Upper Midwest": "MN WI MI IL IN OH",
    "Midwest, Plains, and S. Central": "AR LA OK TX NM NE IA KS MO MT ND SD WY UT CO",
    "Southwest and West Coast": "NV CA AZ HI AK ID OR WA",
}

STATE_NAMES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California",
    "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "FL": "Florida", "GA": "Georgia",
    "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa",
    "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland",
    "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi",
    "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire",
    "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina",
    "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania",
    "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee",
    "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington",
    "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming", "DC": "District of Columbia",
}


def region_map(spark: SparkSession) -> DataFrame:
    rows = [(region, abb) for region, states in REGION_STATES.items() for abb in states.split()]
    return local_table(spark, rows, "region_epa string, state_abb string")


def state_names(spark: SparkSession) -> DataFrame:
    return local_table(spark, list(STATE_NAMES.items()), "state_abb string, state_name string")
