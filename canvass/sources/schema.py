"""The survey table's columns. Names and kinds of the questionnaire's cells."""

NUMERIC = (
    "rev_est", "exp_est",
    "acre_infield_veg_herb", "acre_infield_fruit", "acre_sum", "acre_infield_cerealbeans",
    "acre_gh", "acre_pasture", "acre_grass", "acre_wild", "acre_fallow", "acre_other",
    "sale_directcons", "sale_wholesale", "sale_grocery", "sale_massmerch",
    "sale_process", "sale_other", "sale_foodserv",
    "loss_acre_animals", "loss_acre_water", "loss_noncrop_acre",
)

CATEGORY = (
    "state", "org_v_conv", "border_noncrop", "border_livestock", "water_freq_test", "water_treat",
)

AMOUNT_TEXT = ("loss_insurance_payout", "loss_other_payout")

YES_NO = (
    "train_attend", "fsplan", "fsplan_consult", "insure", "audit", "losses_fs",
    "wlrisk_clearbuffer", "wlrisk_expbuffer", "wlrisk_lowriskcrop", "wlrisk_fallow",
    "wlrisk_corridors", "wlrisk_drain", "wlrisk_remove_nc_water", "wlrisk_remove_nc_fieldedge",
    "wl_manage_deerfence", "wl_manage_plasticfence", "wl_manage_water_fence",
    "wl_manage_mechanicaltraps", "wl_manage_poison", "wl_manage_hunt", "wl_manage_deter",
    "cons_incentive_yn", "cons_self_yn", "cost_fsimpair_yn", "water_runoff_nc",
)

RISK = (
    "risk_birds", "risk_rodents", "risk_cervid", "risk_rept",
    "risk_pets", "risk_livestock", "risk_draft",
)

CHECK_ALL = (
    "fspract_watertest_treat", "fspract_bsaao_treat", "fspract_wild_monitor",
    "fspract_deter_animals", "fspract_hygeine", "fspract_worker_train",
    "fspract_sanitize", "fspract_fsrecords",
    "water_stand", "water_notouch_stand", "water_flow", "water_notouch_flow",
    "water_ground", "water_notouch_ground", "water_public", "water_notouch_public",
    "filler_20", "filler_21",
    "buffer_dirt", "buffer_mowedgrass", "buffer_lowriskcrop", "buffer_nc", "buffer_notused",
    "concern_wl_auditor", "concern_wl_buyer", "concern_wl_inspector", "concern_wl_consult",
    "concern_wl_fstrainer", "concern_wl_extension", "concern_wl_worker", "concern_wl_none",
    "concern_nc_auditor", "concern_nc_buyer", "concern_nc_inspector", "concern_nc_consult",
    "concern_nc_fstrain", "concern_nc_extension", "concern_nc_none",
    "audit_lost_pts_wl", "audit_lost_pt_water", "audit_lost_pt_soil",
    "audit_lost_pt_clean", "audit_lost_pt_worker", "audit_lost_pt_none",
    "cons_hedges", "cons_natural", "cons_riparian", "cons_timing",
    "cons_houses", "cons_poll", "cons_none",
)

SOURCE_USE = ("other_pna",)

TEXT = CATEGORY + AMOUNT_TEXT + YES_NO + RISK + CHECK_ALL + SOURCE_USE
COLUMNS = NUMERIC + TEXT
