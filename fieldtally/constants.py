"""Fixed values of the programme: schedules, word lists, texts and limits.

Everything here has to equal the published programme definitions for results to
agree, so it is kept as plain tables in their natural order.
"""

# --- fixed values: loose booleans -------------------------------------------
TRUE_WORDS = ("yes", "true", "1", "1.0", "y", "t")
FALSE_WORDS = ("no", "false", "0", "0.0", "n", "f")

# --- fixed values: accepted county names ------------------------------------
COUNTIES = (
    "baringo", "bomet", "bungoma", "busia", "elgeyo-marakwet", "embu", "garissa",
    "homa bay", "isiolo", "kajiado", "kakamega", "kericho", "kiambu", "kilifi",
    "kirinyaga", "kisii", "kisumu", "kitui", "kwale", "laikipia", "lamu", "machakos",
    "makueni", "mandera", "marsabit", "meru", "migori", "mombasa", "murang'a",
    "nairobi", "nakuru", "nandi", "narok", "nyamira", "nyandarua", "nyeri", "samburu",
    "siaya", "taita taveta", "tana river", "tharaka-nithi", "trans nzoia", "turkana",
    "uasin gishu", "vihiga", "wajir", "west pokot",
)

# --- fixed values: dose schedules, ages in months ---------------------------
CORE_SCHEDULE_MONTHS = (
    ("has_bcg", 0), ("has_opv_0", 0), ("has_opv_1", 2), ("has_opv_2", 3), ("has_opv_3", 4),
    ("has_pcv_1", 2), ("has_pcv_2", 3), ("has_pcv_3", 4),
    ("has_penta_1", 2), ("has_penta_2", 3), ("has_penta_3", 4), ("has_ipv", 4),
    ("has_rota_1", 2), ("has_rota_2", 3), ("has_rota_3", 4),
    ("has_measles_9_months", 9), ("has_measles_18_months", 18),
)
MALARIA_SCHEDULE_MONTHS = (
    ("has_malaria_6_vaccine", 5), ("has_malaria_7_vaccine", 6),
    ("has_malaria_8_vaccine", 7), ("has_malaria_24_vaccine", 24),
)
VITAMIN_A_SCHEDULE_MONTHS = tuple((f"has_vitamin_a_{m}_months", m) for m in range(6, 61, 6))

# --- fixed values: dose schedule, ages in days ------------------------------
SCHEDULE_DAYS = (
    ("has_bcg", 0), ("has_opv_0", 0),
    ("has_opv_1", 42), ("has_penta_1", 42), ("has_pcv_1", 42), ("has_rota_1", 42),
    ("has_opv_2", 70), ("has_penta_2", 70), ("has_pcv_2", 70), ("has_rota_2", 70),
    ("has_opv_3", 98), ("has_penta_3", 98), ("has_pcv_3", 98), ("has_ipv", 98),
    ("has_measles_9_months", 270),
)

CORE_DOSES = tuple(name for name, _ in CORE_SCHEDULE_MONTHS)
MALARIA_DOSES = tuple(name for name, _ in MALARIA_SCHEDULE_MONTHS)
DAY_DOSES = tuple(name for name, _ in SCHEDULE_DAYS)

DOSE_SERIES = {
    "penta_series_complete": ("has_penta_1", "has_penta_2", "has_penta_3"),
    "opv_series_complete": ("has_opv_1", "has_opv_2", "has_opv_3"),
    "pcv_series_complete": ("has_pcv_1", "has_pcv_2", "has_pcv_3"),
    "rota_series_complete": ("has_rota_1", "has_rota_2", "has_rota_3"),
}

# --- fixed values: bands and tiers ------------------------------------------
AGE_BANDS_DAYS = (
    (-1, 41, 69, 97, 269, 364, 729, 1825),
    ("0-6w", "6-10w", "10-14w", "14w-9m", "9-12m", "12-24m", "24m+"),
)
AGE_BANDS_MONTHS = (
    (0, 2, 6, 12, 18, 24, 36, 48, 61),
    ("0-2m", "3-6m", "7-12m", "13-18m", "19-24m", "25-36m", "37-48m", "49-60m"),
)
SCORE_TIERS = (("LOW", 0.33), ("MEDIUM", 0.60), ("HIGH", None))
LIST_TIERS = ((0.0, 0.5, 0.75, 1.0), ("medium", "high", "critical"))

# --- fixed values: source tables --------------------------------------------
SOURCE_TABLES = (
    "iz", "active_chps", "supervision", "homevisit", "population", "pnc",
    "preg_reg", "preg_reg2", "preg_visit", "preg_visit2", "fp", "refill",
)
DATE_COLUMNS = {
    "iz": ("reported", "immunization_follow_up_date", "follow_up_date"),
    "supervision": ("reported", "next_supervision_visit_date"),
    "homevisit": ("reported",),
    "preg_reg": ("reported", "last_anc_date", "next_anc_visit_date", "date_of_birth"),
    "preg_reg2": ("reported", "last_anc_date", "next_anc_visit_date", "date_of_birth"),
    "preg_visit": ("reported", "next_anc_visit_date"),
    "preg_visit2": ("reported", "next_anc_visit_date"),
    "pnc": ("reported", "date_of_delivery"),
    "fp": ("reported",),
    "refill": ("reported",),
}
YES_NO_COLUMNS = (
    "needs_follow_up", "needs_immunization_follow_up", "has_good_immunization_status",
    "is_available", "is_in_malaria_endemic_region",
    "is_participating_in_monthly_growth_monitoring", "has_signs_of_delayed_milestones",
    "is_participating_in_growth_monitoring",
)
INACTIVE_SUPERVISION_COLUMNS = (
    "calc_cancer_denominator", "calc_oral_health_denominator", "calc_eye_health_denominator",
    "calc_cancer_score", "calc_oral_health_score", "calc_eye_health_score",
)
SCORED_MODULES = (
    "immunization", "assessment", "family_planning", "nutrition",
    "pregnancy_home_visit", "newborn_visit", "wash",
)

# --- fixed values: model features, by group, in order -----------------------
FEATURE_GROUPS = {
    "child_numeric": (
        "patient_age_in_months", "vax_completeness_score", "vax_completeness_all",
        "age_expected_vaccine_count", "due_count_clean", "vitamin_a_completeness",
        "months_since_reported", "vax_received_core", "vax_received_total",
    ),
    "child_binary": (
        "patient_sex_binary", "is_malaria_endemic_binary", "is_growth_monitoring_binary",
        "has_delayed_milestones_binary", "penta_series_complete", "opv_series_complete",
        "pcv_series_complete", "rota_series_complete", "measles_booster_gap",
    ) + CORE_DOSES,
    "chw_numeric": (
        "chw_supervision_frequency", "chw_immunization_competency_pct",
        "chw_overall_assessment_pct", "chw_workload_u2", "monthly_homevisit_rate",
        "months_since_last_supervision",
    ),
    "chw_binary": ("chw_has_all_tools", "chw_has_ppe"),
    "maternal_numeric": ("maternal_anc_visits",),
    "maternal_binary": ("maternal_anc_defaulter", "maternal_muac_risk", "maternal_iron_folate"),
    "engagement_binary": ("household_on_fp",),
    "geographic_categorical": ("sub_county_encoded", "county_encoded"),
}
FEATURES = tuple(name for group in FEATURE_GROUPS.values() for name in group)
# Derived from the same field as the label, so it gives the answer away.
LEAKS_LABEL = ("due_count_clean",)
TARGET = "is_defaulter"

# --- fixed values: accepted input ranges (low, high; None = open) -----------
_UNIT = (0, 1)
INPUT_RANGES = {
    "patient_age_in_months": (0, 60), "patient_sex_binary": _UNIT,
    "vax_completeness_score": _UNIT, "vax_completeness_all": _UNIT,
    "age_expected_vaccine_count": (0, 20), "due_count_clean": (0, 20),
    "is_malaria_endemic_binary": _UNIT, "vitamin_a_completeness": _UNIT,
    "is_growth_monitoring_binary": _UNIT, "has_delayed_milestones_binary": _UNIT,
    **{name: _UNIT for name in DOSE_SERIES},
    "measles_booster_gap": (-24, 60), "months_since_reported": (0, 120),
    **{name: _UNIT for name in CORE_DOSES},
    "chw_supervision_frequency": (0, None), "chw_immunization_competency_pct": (0, 100),
    "chw_overall_assessment_pct": (0, 100), "chw_workload_u2": (0, None),
    "monthly_homevisit_rate": (0, None), "months_since_last_supervision": (0, None),
    "chw_has_all_tools": _UNIT, "chw_has_ppe": _UNIT, "maternal_anc_visits": (0, 20),
    "maternal_anc_defaulter": _UNIT, "maternal_muac_risk": _UNIT,
    "maternal_iron_folate": _UNIT, "household_on_fp": _UNIT,
    "sub_county_encoded": (0, None), "county_encoded": (0, None),
}

# --- fixed values: deployment limits ----------------------------------------
DEPLOYMENT_LIMITS = (
    ("pr_auc", "min", 0.50), ("roc_auc", "min", 0.65), ("precision_at_20pct", "min", 0.40),
    ("expected_calibration_error", "max", 0.15), ("auc_gap", "max", 0.10),
)
PSI_GREEN_BELOW, PSI_AMBER_BELOW = 0.1, 0.2

# --- fixed values: texts -----------------------------------------------------
FRIENDLY_NAMES = {
    "vax_completeness_score": "Overall vaccine completeness",
    "patient_age_in_months": "Child's age (months)",
    "due_count_clean": "Doses currently outstanding",
    "months_since_reported": "Months since last CHW contact",
    "chw_supervision_frequency": "CHW supervision visits (count)",
    "chw_immunization_competency_pct": "CHW immunization knowledge score",
    "chw_workload_u2": "Under-2 children per CHW area",
    "monthly_homevisit_rate": "Monthly home visit rate in area",
    "maternal_anc_visits": "Mother's ANC visits attended",
    "maternal_anc_defaulter": "Mother defaulted on ANC",
    "maternal_muac_risk": "Mother had nutritional risk (MUAC)",
    "measles_booster_gap": "Missed measles booster (18-month)",
    "penta_series_complete": "Penta 1-2-3 series complete",
    "has_penta_1": "Penta-1 received",
    "has_penta_2": "Penta-2 received",
    "has_penta_3": "Penta-3 received",
    "has_measles_9_months": "Measles-Rubella MR1 received",
    "has_measles_18_months": "Measles-Rubella MR2 received",
    "patient_sex_binary": "Child's sex (male)",
    "is_growth_monitoring_binary": "Enrolled in growth monitoring",
    "chw_has_all_tools": "CHW has all required tools",
    "household_on_fp": "Household using family planning",
    "sub_county_encoded": "Sub-county",
}
DOSE_NAMES = {
    "has_bcg": "BCG", "has_opv_0": "OPV-0 (Birth Polio)",
    "has_opv_1": "OPV-1", "has_opv_2": "OPV-2", "has_opv_3": "OPV-3",
    "has_pcv_1": "PCV-1", "has_pcv_2": "PCV-2", "has_pcv_3": "PCV-3",
    "has_penta_1": "Penta-1 (DPT-HepB-Hib)", "has_penta_2": "Penta-2", "has_penta_3": "Penta-3",
    "has_ipv": "IPV", "has_rota_1": "Rota-1", "has_rota_2": "Rota-2", "has_rota_3": "Rota-3",
    "has_measles_9_months": "Measles-Rubella MR1 (9m)",
    "has_measles_18_months": "Measles-Rubella MR2 (18m)",
    "has_malaria_6_vaccine": "Malaria Dose 1 (R21)", "has_malaria_7_vaccine": "Malaria Dose 2 (R21)",
    "has_malaria_8_vaccine": "Malaria Dose 3 (R21)", "has_malaria_24_vaccine": "Malaria Booster (R21)",
}
DRIVER_REASONS = {
    "patient_age_in_months": "Child's age places them in a high-risk vaccine window",
    "months_since_reported": "Extended gap since last CHW contact",
    "due_count_clean": "Multiple vaccine doses currently outstanding",
    "vax_completeness_score": "Vaccine series completion below age expectation",
    "vax_completeness_all": "Overall vaccination coverage (including optional) is low",
    "penta_series_complete": "Pentavalent series (DTP-HepB-Hib) not fully completed",
    "opv_series_complete": "Oral polio vaccine series incomplete",
    "vitamin_a_completeness": "Vitamin A supplementation behind schedule",
    "chw_workload_u2": "CHW carries a high under-2 caseload in this area",
    "chw_immunization_competency_pct": "CHW immunization knowledge score is below average",
    "monthly_homevisit_rate": "Home visit frequency in area is below average",
    "chw_supervision_frequency": "CHW has had limited supervision support recently",
    "patient_sex_binary": "Child's sex is a contributing contextual factor",
    "maternal_anc_visits": "Mother attended fewer ANC visits during pregnancy",
    "household_on_fp": "Family planning engagement status of household",
    "sub_county_encoded": "Sub-county context contributes to risk profile",
}
REASON_DUE = "child currently has due vaccines outstanding"
REASON_SUPERVISION = "long gap since recent CHW supervision"
REASON_NO_VISIT = "no recent home visit activity captured"
REASON_ADMIN = "source data contains administrative field inconsistency"
ACTIONS = {
    "LOW": "Routine follow-up at next scheduled visit.",
    "MEDIUM": "Prioritise within-month home visit. Review vaccine card.",
    "HIGH": "Immediate home visit required. Bring vaccine referral form.",
}
HIGH_EXTRAS_FULL = {
    "measles_booster_gap": " Specifically: schedule MR2 booster referral.",
    "due_count_clean": " Check outstanding doses and arrange facility referral.",
    "months_since_reported": " Child has not been seen recently — locate household.",
}
HIGH_EXTRAS_SHORT = {
    "measles_booster_gap": " Schedule MR2 booster referral.",
    "due_count_clean": " Arrange facility referral for outstanding doses.",
}
