"""The survey analysis: derived columns, the eleven tables, tests, models and the map dataset.

Every function takes a conformed survey table (see ``sources.schema``) or the
result of ``derive`` and stays lazy. ``derive`` is narrow work: one projection
per dependency layer and one lookup join, so it fuses with the scan, and each
table reads only the columns it names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.domain import Domain, bin_by, pick, recode, sorted_levels
from canvass.functions import flags
from canvass.operators.inference import chi2_from_counts, flag_counts, mean_interval
from canvass.operators.probit import (
    ProbitBatch, Term, factor_terms, fit_probits, numeric_term, report_table, sign_table)
from canvass.operators.profile import (
    Cut, Measure, in_order, joint_groups_bounded, profile, roll_up, set_id, sums, tagged)
from canvass.operators.relate import complete_cases, lookup, natural_left_join, pairs, region_frequency
from canvass.operators.reshape import MISSING, gather, spread_pairs, stack_by_name
from canvass.session import local_table, materialized

# ---------------------------------------------------------------------------
# Category domains, bin edges, and which answer feeds which flag.
# ---------------------------------------------------------------------------

REVENUE = Domain(("<25K", "25-250K", "250-500K", "500K-1M", "1-5M", "5M+"))
REVENUE_EDGES = (25_000, 250_000, 500_000, 1_000_000, 5_000_000)
REVENUE_GROUPS = {
    "<25K": "<25K",
    "25-250K": "25-500K", "250-500K": "25-500K",
    "500K-1M": ">500K", "1-5M": ">500K", "5M+": ">500K",
}
REVENUE_ABBR = Domain(("<25K", "25-500K", ">500K"))
ORGANIC = Domain(("Both", "Organic", "Conventional"))
ORGANIC_GROUPS = {"Both": "Some", "Organic": "Some", "Conventional": "None"}
ORGANIC_ABBR = Domain(("Some", "None"))
QUARTILE = Domain(("[0%,25%)", "[25%,50%)", "[50,75%)", "[75%,100%)"))
LANDSCAPE = Domain(("Most", "Some", "None"))
TEST_FREQ = Domain(("freq", "occ", "never"))
TREAT_FREQ = Domain(("never", "always", "sometimes"))

# Labels by position in the sorted raw levels, where the blank answer comes first.
POSITIONS = {
    "org_v_conv": {2: "Both", 3: "Organic", 4: "Conventional"},
    "border_noncrop": {2: "Most", 5: "Some", 3: "None"},
    "border_livestock": {2: "Most", 5: "Some", 3: "None"},
    "water_freq_test": {2: "freq", 5: "freq", 6: "occ", 8: "occ", 4: "never"},
    "water_treat": {2: "never", 4: "always", 5: "sometimes"},
}

SHARES = {
    "veg_pct": "acre_infield_veg_herb", "fruit_pct": "acre_infield_fruit",
    "cereal_pct": "acre_infield_cerealbeans", "gh_pct": "acre_gh", "pasture_pct": "acre_pasture",
    "grass_pct": "acre_grass", "wild_pct": "acre_wild", "fallow_pct": "acre_fallow",
    "other_pct": "acre_other",
}
CHANNELS = (
    "sale_directcons", "sale_wholesale", "sale_grocery", "sale_massmerch",
    "sale_process", "sale_other", "sale_foodserv",
)

YES_FLAGS = {
    "emp_train": "train_attend", "fs_plan": "fsplan", "fs_consult": "fsplan_consult",
    "fs_insure": "insure", "fs_audit": "audit", "fs_loss": "losses_fs",
    "hab_clearbuffer": "wlrisk_clearbuffer", "hab_expbuffer": "wlrisk_expbuffer",
    "hab_lowriskcrop": "wlrisk_lowriskcrop", "hab_fallow": "wlrisk_fallow",
    "hab_corridor": "wlrisk_corridors", "hab_drain": "wlrisk_drain",
    "hab_clearvegwater": "wlrisk_remove_nc_water", "hab_clearvegnear": "wlrisk_remove_nc_fieldedge",
    "det_deerfence": "wl_manage_deerfence", "det_plasticfence": "wl_manage_plasticfence",
    "det_waterfence": "wl_manage_water_fence", "det_mechtrap": "wl_manage_mechanicaltraps",
    "det_poison": "wl_manage_poison", "det_hunt": "wl_manage_hunt", "det_deter": "wl_manage_deter",
    "cons_prog": "cons_incentive_yn", "cons_self": "cons_self_yn",
    "cons_impair": "cost_fsimpair_yn", "cons_runoff": "water_runoff_nc",
}
RISK_FLAGS = {
    "hr_bird": "risk_birds", "hr_rodent": "risk_rodents", "hr_deer": "risk_cervid",
    "hr_rept": "risk_rept", "hr_pet": "risk_pets", "hr_livestock": "risk_livestock",
    "hr_draft": "risk_draft",
}
ANSWERED_FLAGS = {
    "prac_watertest": "fspract_watertest_treat", "prac_soil": "fspract_bsaao_treat",
    "prac_monwild": "fspract_wild_monitor", "prac_deter": "fspract_deter_animals",
    "prac_hygiene": "fspract_hygeine", "prac_emp": "fspract_worker_train",
    "prac_sani": "fspract_sanitize", "prac_rec": "fspract_fsrecords",
    "water_touch_stand": "water_stand", "water_touch_flow": "water_flow",
    "water_touch_ground": "water_ground", "water_touch_public": "water_public",
    "water_touch_other": "filler_21",
    "buf_dirt": "buffer_dirt", "buf_grass": "buffer_mowedgrass", "buf_lrcrop": "buffer_lowriskcrop",
    "buf_ncv": "buffer_nc", "buf_nouse": "buffer_notused",
    "wl_con_auditor": "concern_wl_auditor", "wl_con_buyer": "concern_wl_buyer",
    "wl_con_insp": "concern_wl_inspector", "wl_con_consult": "concern_wl_consult",
    "wl_con_fstrain": "concern_wl_fstrainer", "wl_con_ext": "concern_wl_extension",
    "wl_con_worker": "concern_wl_worker", "wl_con_none": "concern_wl_none",
    "nc_con_auditor": "concern_nc_auditor", "nc_con_buyer": "concern_nc_buyer",
    "nc_con_insp": "concern_nc_inspector", "nc_con_consult": "concern_nc_consult",
    "nc_con_fstrain": "concern_nc_fstrain", "nc_con_ext": "concern_nc_extension",
    "nc_con_none": "concern_nc_none",
    "audit_pt_wl": "audit_lost_pts_wl", "audit_pt_water": "audit_lost_pt_water",
    "audit_pt_soil": "audit_lost_pt_soil", "audit_pt_clean": "audit_lost_pt_clean",
    "audit_pt_worker": "audit_lost_pt_worker", "audit_pt_none": "audit_lost_pt_none",
    "con_hedge": "cons_hedges", "con_nat": "cons_natural", "con_buf": "cons_riparian",
    "con_time": "cons_timing", "con_house": "cons_houses", "con_flower": "cons_poll",
    "con_none": "cons_none",
}
ANY_ANSWERED_FLAGS = {
    "water_any_stand": ("water_stand", "water_notouch_stand"),
    "water_any_flow": ("water_flow", "water_notouch_flow"),
    "water_any_ground": ("water_ground", "water_notouch_ground"),
    "water_any_public": ("water_public", "water_notouch_public"),
    "water_any_other": ("filler_20", "filler_21"),
}
ANY_POSITIVE_FLAGS = {"acre_rej": ("loss_acre_animals", "loss_acre_water", "loss_noncrop_acre")}
AMOUNT_FLAGS = {"fs_ins_payout": "loss_insurance_payout", "fs_oth_comp": "loss_other_payout"}
ROW_MAX_FLAGS = {
    "buyer": ("wl_con_buyer", "nc_con_buyer"),
    "auditor": ("wl_con_auditor", "wl_con_insp", "nc_con_auditor", "nc_con_insp"),
    "advisor": ("wl_con_consult", "wl_con_fstrain", "wl_con_ext",
                "nc_con_consult", "nc_con_ext", "nc_con_fstrain"),
}
ROW_MIN_FLAGS = {"noone": ("wl_con_none", "nc_con_none")}

PROGRAM = ("emp_train", "fs_plan", "fs_consult", "fs_insure", "fs_audit", "fs_loss")
PRACTICE = ("prac_watertest", "prac_soil", "prac_monwild", "prac_deter",
            "prac_hygiene", "prac_emp", "prac_sani", "prac_rec")
BUFFER = ("buf_dirt", "buf_grass", "buf_lrcrop", "buf_ncv", "buf_nouse")
HABITAT = ("hab_clearbuffer", "hab_expbuffer", "hab_lowriskcrop", "hab_fallow",
           "hab_corridor", "hab_drain", "hab_clearvegwater", "hab_clearvegnear")
DETERRENCE = ("det_deerfence", "det_plasticfence", "det_waterfence", "det_mechtrap",
              "det_poison", "det_hunt", "det_deter")
HIGH_RISK = ("hr_bird", "hr_rodent", "hr_deer", "hr_rept", "hr_pet", "hr_livestock", "hr_draft")
INPUT = ("buyer", "auditor", "advisor", "noone")
CONSERVATION = ("con_hedge", "con_nat", "con_buf", "con_time", "con_house", "con_flower", "con_none")

PROBIT_FAMILIES = {
    "fs": PRACTICE, "buf": BUFFER, "hab": HABITAT, "det": DETERRENCE, "con": CONSERVATION,
}

# Which cuts meet which responses in the independence tests.
CUTS_PROGRAM = ("rev_cat", "org_abbr", "region_epa", "fvacreage_quartile", "directsales_quartile")
CUTS_LANDSCAPE = ("rev_cat", "org_abbr", "lscape_wild", "lscape_graze")
CUTS_RISK = ("rev_cat", "org_abbr", "fvacreage_quartile", "lscape_wild", "lscape_graze")
CUTS_INPUT = ("rev_cat", "org_abbr", "fvacreage_quartile", "directsales_quartile")
CHI2_FAMILIES = (
    (CUTS_PROGRAM, PROGRAM),
    (CUTS_LANDSCAPE, PRACTICE),
    (CUTS_LANDSCAPE, BUFFER),
    (CUTS_LANDSCAPE, HABITAT),
    (CUTS_LANDSCAPE, DETERRENCE),
    (CUTS_RISK, HIGH_RISK),
    (CUTS_INPUT, INPUT),
    (CUTS_LANDSCAPE, ("cons_prog", "cons_self", "cons_impair")),
    (CUTS_LANDSCAPE, ("cons_runoff", *CONSERVATION)),
)

CUT_LABELS = {
    "rev_cat": "Revenue Category", "org_abbr": "Organic Status", "region_epa": "Geographic Region",
    "fvacreage_quartile": "FV Acreage Proportion", "directsales_quartile": "Direct Sales Proportion",
    "lscape_wild": "Landscape Wildlife Habitat", "lscape_graze": "Landscape Grazing",
    "test_freq": "Testing Frequency", "treat_freq": "Treatment Frequency",
}
DOMAINS = {
    "rev_cat": REVENUE, "rev_cat_abbr": REVENUE_ABBR, "org": ORGANIC, "org_abbr": ORGANIC_ABBR,
    "fvacreage_quartile": QUARTILE, "directsales_quartile": QUARTILE,
    "lscape_wild": LANDSCAPE, "lscape_graze": LANDSCAPE,
    "test_freq": TEST_FREQ, "treat_freq": TREAT_FREQ,
}
REGIONS = Domain((
    "Mid-Atlantic", "Midwest, Plains, and S. Central", "New England", "NY and NJ",
    "Southeast", "Southwest and West Coast", "Upper Midwest",
))

COEFFICIENT_LABELS = {
    "(Intercept)": "Intercept",
    "org_abbrSome": "Some Organic (0/1)",
    "rev_cat_abbr25-500K": "Revenue $25K to $500K",
    "rev_cat_abbr>500K": "Revenue > $500K",
    "fvacreage_pct": "Produce Acreage Percent (0 to 100)",
    "sale_directcons": "DTC Sales Percentage (0 to 100)",
    "lscape_wildMost": "Bordering Noncrop Vegetation = Most",
    "lscape_wildSome": "Bordering Noncrop Vegetation = Some",
}

# ---------------------------------------------------------------------------
# Configuration that depends on the data at hand
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Dictionary:
    """What the questionnaire leaves open: raw spellings per category column, and the regions."""

    recodes: Mapping[str, Mapping[str, str]]
    regions: Domain = field(default=REGIONS)

    @staticmethod
    def from_levels(levels: Mapping[str, Sequence[str]], regions: Domain = REGIONS) -> "Dictionary":
        """From each column's full sorted level list, blank first."""
        return Dictionary({c: pick(levels[c], POSITIONS[c]) for c in POSITIONS}, regions)

    @staticmethod
    def from_data(df: DataFrame, regions: Domain = REGIONS, collation: str | None = None) -> "Dictionary":
        """Look the levels up in a conformed table, sorted by code point or by a collation."""
        with materialized(df.select(*POSITIONS), "levels") as cells:
            return Dictionary.from_levels(sorted_levels(cells, {c: max(p) for c, p in POSITIONS.items()}, collation), regions)


# ---------------------------------------------------------------------------
# Derivation
# ---------------------------------------------------------------------------


def attach_region(survey: DataFrame, regions: DataFrame, names: DataFrame) -> DataFrame:
    """Add ``region_epa`` (and ``state_abb``) to every respondent; no match keeps the row."""
    return lookup(survey, "state", natural_left_join(regions, names), "state_name")


def derive(survey: DataFrame, dictionary: Dictionary) -> DataFrame:
    """All derived columns, flags as 0/1 with NULL kept."""
    cleaned = survey.withColumns({c: flags.zero_to_null(c) for c in ("rev_est", "exp_est")})
    recoded = {
        "org": "org_v_conv", "lscape_wild": "border_noncrop", "lscape_graze": "border_livestock",
        "test_freq": "water_freq_test", "treat_freq": "water_treat",
    }
    first = {
        "rev_cat": bin_by(F.col("rev_est"), REVENUE_EDGES, REVENUE.levels),
        **{name: recode(F.col(c), dictionary.recodes[c]) for name, c in recoded.items()},
        "fvacreage_pct": flags.share("acre_infield_veg_herb + acre_infield_fruit", "acre_sum"),
        **{name: flags.share(part, "acre_sum") for name, part in SHARES.items()},
        "dist_hhi": flags.concentration(*CHANNELS),
        "directsales_quartile": bin_by(F.col("sale_directcons"), (25, 50, 75), QUARTILE.levels),
        **{name: flags.equals(c, "Yes") for name, c in YES_FLAGS.items()},
        **{name: flags.equals(c, "High Risk") for name, c in RISK_FLAGS.items()},
        **{name: flags.answered(c) for name, c in ANSWERED_FLAGS.items()},
        **{name: flags.any_answered(*cs) for name, cs in ANY_ANSWERED_FLAGS.items()},
        **{name: flags.any_positive(*cs) for name, cs in ANY_POSITIVE_FLAGS.items()},
        **{name: flags.text_positive(c) for name, c in AMOUNT_FLAGS.items()},
    }
    second = {
        "rev_cat_abbr": recode(F.col("rev_cat"), REVENUE_GROUPS),
        "org_abbr": recode(F.col("org"), ORGANIC_GROUPS),
        "fvacreage_quartile": bin_by(F.col("fvacreage_pct"), (0.25, 0.5, 0.75), QUARTILE.levels),
        "acre_hhi": flags.concentration(*[f"{c} * 100" for c in SHARES]),
    }
    return flags.booleans_to_int(cleaned.withColumns(first).withColumns(second))


def collapse_inputs(derived: DataFrame) -> DataFrame:
    """Combined wildlife / noncrop concern flags by source of advice."""
    return derived.withColumns(
        {name: flags.row_max(*cs) for name, cs in ROW_MAX_FLAGS.items()}
        | {name: flags.row_min(*cs) for name, cs in ROW_MIN_FLAGS.items()}
    )


def water_classes(derived: DataFrame) -> DataFrame:
    """Surface water flags.

    ``nosurface_any`` only asks that no surface water touches produce;
    ``nosurface`` also asks that none is used elsewhere.
    """
    touching = derived.withColumns({
        "surface": flags.row_max("water_touch_stand", "water_touch_flow"),
        "surface_anywhere": flags.row_max("water_any_stand", "water_any_flow"),
    })
    apart = touching.withColumn("surface_nt", F.expr("cast(surface = 0 and surface_anywhere = 1 as int)"))
    return apart.withColumns({
        "nosurface_any": F.expr("cast(surface = 0 and other_pna is not null as int)"),
        "nosurface": F.expr("cast(surface = 0 and surface_nt = 0 and other_pna is not null as int)"),
    })


# ---------------------------------------------------------------------------
# Tables
# ---------------------------------------------------------------------------


def _cuts(dictionary: Dictionary, names: Sequence[str]) -> list[Cut]:
    return [Cut(n, CUT_LABELS[n], DOMAINS.get(n, dictionary.regions)) for n in names]


PROFILE_TABLES = {
    "tbl2": (CUTS_PROGRAM, PROGRAM),
    "tbl3": (CUTS_LANDSCAPE, PRACTICE),
    "tbl4": (CUTS_LANDSCAPE, BUFFER),
    "tbl5": (CUTS_LANDSCAPE, HABITAT),
    "tbl6": (CUTS_LANDSCAPE, DETERRENCE),
    "tblA2": (CUTS_RISK, HIGH_RISK),
    "tbl7": (CUTS_INPUT, INPUT),
    "tbl8": (CUTS_LANDSCAPE, ("cons_prog", "cons_self", "cons_runoff", "cons_impair")),
    "tbl9": (CUTS_LANDSCAPE, CONSERVATION),
}


def profile_table(derived: DataFrame, dictionary: Dictionary, name: str, with_order: bool = False) -> DataFrame:
    """One of the nine profile tables: ``(type, level, N, one mean per flag)``."""
    cuts, columns = PROFILE_TABLES[name]
    source = collapse_inputs(derived) if name == "tbl7" else derived
    measures = [Measure("none", "noone") if c == "noone" else Measure(c, c) for c in columns]
    return profile(source, _cuts(dictionary, cuts), measures, with_order=with_order)


def farm_characteristics(derived: DataFrame, dictionary: Dictionary, with_order: bool = False) -> DataFrame:
    """Counts, means and sums across revenue categories.

    All ten blocks come out of one aggregate over the rows. ``all`` is the total
    over the categories for counts and sums and the true overall mean for means;
    ``row_sum`` is the plain sum across the row for every block.
    """
    rev = _cuts(dictionary, ["rev_cat"])[0]
    rows = [
        Cut("org", "Organic Status", ORGANIC), Cut("region_epa", "Region", dictionary.regions),
        Cut("lscape_wild", "Landscape Wildlife Habitat", LANDSCAPE),
        Cut("lscape_graze", "Landscape Grazing Land", LANDSCAPE),
    ]
    keys = [rev.column, *[c.column for c in rows]]
    averaged = {"fvacreage_pct": "Prop. FV Acreage", "acre_hhi": "Avg. Acreage HHI",
                "dist_hhi": "Avg. Distribution HHI"}
    summed = {"surface": "Surface Water", "nosurface_any": "Other Water"}
    used = [*averaged, *summed]
    alone, overall = set_id(keys, [rev.column]), set_id(keys, [])
    crossed = {set_id(keys, [rev.column, c.column]): c for c in rows}
    totals = {set_id(keys, [c.column]): c for c in rows}
    sets = [[rev.column], [], *[[rev.column, c.column] for c in rows], *[[c.column] for c in rows]]
    rolled = roll_up(water_classes(derived), sets, keys, used, joint_groups_bounded([rev, *rows]))

    def cell(kind, level, place, value):
        return F.struct(F.lit(kind).alias("type"), level.alias("level"),
                        place.cast("int").alias("level_ord"), value.cast("double").alias("resp"))

    nothing = F.lit(float("nan"))
    whole = [cell("All Farms", F.lit("All"), F.lit(1), F.col("rows"))]
    whole += [cell(label, F.lit("All"), F.lit(1), F.coalesce(
        F.try_divide(F.col(f"sum__{c}"), F.col(f"cnt__{c}")), nothing)) for c, label in averaged.items()]
    whole += [cell(label, F.lit("All"), F.lit(1), F.coalesce(F.col(f"sum__{c}"), F.lit(0)))
              for c, label in summed.items()]
    by_set = {alone: F.array(*whole), overall: F.array(*whole)}
    for ids in (crossed, totals):
        for i, c in ids.items():
            by_set[i] = F.array(cell(c.label, F.col(c.column), c.domain.ordinal(F.col(c.column)), F.col("rows")))
    is_total = F.col("gid").isin(overall, *totals)
    long = rolled.select(
        F.when(is_total, F.lit("all")).otherwise(F.coalesce(F.col(rev.column), F.lit(MISSING))).alias("key"),
        F.explode(tagged(F.col("gid"), by_set)).alias("c"),
    ).select("key", "c.*")
    names = [*REVENUE.levels, MISSING]
    wide = long.groupBy("type", "level", "level_ord").pivot("key", [*names, "all"]).agg(F.first("resp"))
    filled = {n: F.coalesce(F.col(f"`{n}`"), F.lit(0.0)) for n in names}
    out = wide.select("type", "level", "level_ord", *[c.alias(n) for n, c in filled.items()], "all")
    out = out.withColumn("row_sum", flags.row_sum(*[f"`{n}`" for n in names]))
    blocks = ["All Farms", "Organic Status", "Region", *averaged.values(), "Landscape Wildlife Habitat",
              "Landscape Grazing Land", *summed.values()]
    if with_order:
        return out.withColumn("block_ord", Domain(tuple(blocks)).ordinal(F.col("type")))
    return out.drop("level_ord")


def farm_checks(derived: DataFrame) -> DataFrame:
    """The four scalar checks printed next to the first table."""
    return derived.agg(
        F.avg("dist_hhi").alias("dist_hhi"),
        F.avg("acre_hhi").alias("acre_hhi"),
        F.avg("fvacreage_pct").alias("fvacreage_pct"),
        F.count_if(F.col("other_pna") == "Source used").alias("other_pna_used"),
    )


WATER_MEASURES = ("surface", "surface_nt", "nosurface")
WATER_COLUMNS = tuple(
    f"{CUT_LABELS[c]}_{v}" for c, d in (("test_freq", TEST_FREQ), ("treat_freq", TREAT_FREQ))
    for v in (*d.levels, MISSING)
)


def water_management(derived: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Surface water sums by testing and treatment frequency, measures as rows."""
    measures = list(WATER_MEASURES)
    table = profile(water_classes(derived), _cuts(dictionary, ["test_freq", "treat_freq"]),
                    sums(*measures), count_as=None)
    long = gather(table, ["type", "level"], measures)
    return spread_pairs(long, ["var"], ("type", "level"), ["All Farms_All", *WATER_COLUMNS], "value")


def all_tables(derived: DataFrame, dictionary: Dictionary) -> dict[str, DataFrame]:
    """The eleven tables in output order, rows in block and domain order."""
    out = {"tbl1": in_order(farm_characteristics(derived, dictionary, with_order=True))}
    for name in ("tbl2", "tbl3", "tbl4", "tbl5", "tbl6", "tbl7", "tbl8", "tbl9"):
        out[name] = in_order(profile_table(derived, dictionary, name, with_order=True))
    measure = F.array_position(F.array(*map(F.lit, WATER_MEASURES)), F.col("var"))
    out["tblA1"] = water_management(derived, dictionary).orderBy(measure)
    out["tblA2"] = in_order(profile_table(derived, dictionary, "tblA2", with_order=True))
    return out


# ---------------------------------------------------------------------------
# Tests, interval, map
# ---------------------------------------------------------------------------


def independence_columns(collapsed: DataFrame) -> DataFrame:
    """The cuts and responses the tests read, of a table with the collapsed flags."""
    names = [n for cuts, responses in CHI2_FAMILIES for n in (*cuts, *responses)]
    return collapsed.select(*dict.fromkeys(names))


def independence_tests(collapsed: DataFrame, dictionary: Dictionary) -> DataFrame:
    """``(cut, resp, stat, df, pval, sig)`` for all pairs of the nine families.

    Families with the same cuts share one pass over the rows, four in all; store
    the table first when deriving it is dear.
    """
    grouped: dict[tuple[str, ...], list[str]] = {}
    for cuts, responses in CHI2_FAMILIES:
        grouped.setdefault(cuts, []).extend(responses)
    counts = stack_by_name(*[
        flag_counts(collapsed, _cuts(dictionary, cuts), responses) for cuts, responses in grouped.items()])
    return chi2_from_counts(counts, ["cut", "resp"])


def in_test_order(tests: DataFrame) -> DataFrame:
    """Tests by family, then cut, then response."""
    listed = [pair for cuts, responses in CHI2_FAMILIES for pair in pairs(cuts, responses)]
    order = local_table(tests.sparkSession, [(*p, i) for i, p in enumerate(listed)], "cut string, resp string, ord int")
    return natural_left_join(tests, order).orderBy("ord").drop("ord")


def acreage_interval(derived: DataFrame) -> DataFrame:
    return mean_interval(derived, "fvacreage_pct")


def region_map_data(attributes: DataFrame, derived: DataFrame) -> DataFrame:
    return region_frequency(attributes, derived, "name", "region_epa")


# ---------------------------------------------------------------------------
# Probit models
# ---------------------------------------------------------------------------


def probit_terms() -> list[Term]:
    """The shared right-hand side, in order."""
    return [
        *factor_terms("org_abbr", ORGANIC_ABBR.relevel("None")),
        *factor_terms("rev_cat_abbr", REVENUE_ABBR.relevel("<25K")),
        numeric_term("fvacreage_pct"),
        numeric_term("sale_directcons"),
        *factor_terms("lscape_wild", LANDSCAPE.relevel("None")),
    ]


def probit_rows(derived: DataFrame) -> DataFrame:
    """Respondents complete on the regressors and the region; acreage share in percent."""
    scaled = derived.withColumn("fvacreage_pct", F.col("fvacreage_pct") * 100)
    return complete_cases(scaled, "org_abbr", "rev_cat_abbr", "fvacreage_pct", "lscape_wild",
                          "region_epa", "sale_directcons")


def probit_models(derived: DataFrame, families: Sequence[str] = tuple(PROBIT_FAMILIES)) -> ProbitBatch:
    """The 35 models of the five families, or those of some."""
    return fit_probits(
        probit_rows(derived), probit_terms(), {f: PROBIT_FAMILIES[f] for f in families})


def probit_signs(batch: ProbitBatch) -> DataFrame:
    return sign_table(batch.coefficients, [t.name for t in probit_terms()])


def probit_report(batch: ProbitBatch, family: str) -> DataFrame:
    return report_table(batch, family, PROBIT_FAMILIES[family], COEFFICIENT_LABELS)
