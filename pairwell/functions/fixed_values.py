"""Names, codes and labels that results depend on."""

# Places whose name the state lookup knows, with their codes.
STATE_CODES = {
    "Alabama": "AL",
    "Alaska": "AK",
    "American Samoa": "AS",
    "Arizona": "AZ",
    "Arkansas": "AR",
    "California": "CA",
    "Colorado": "CO",
    "Connecticut": "CT",
    "Delaware": "DE",
    "District of Columbia": "DC",
    "Florida": "FL",
    "Georgia": "GA",
    "Guam": "GU",
    "Hawaii": "HI",
    "Idaho": "ID",
    "Illinois": "IL",
    "Indiana": "IN",
    "Iowa": "IA",
    "Kansas": "KS",
    "Kentucky": "KY",
    "Louisiana": "LA",
    "Maine": "ME",
    "Maryland": "MD",
    "Massachusetts": "MA",
    "Michigan": "MI",
    "Minnesota": "MN",
    "Mississippi": "MS",
    "Missouri": "MO",
    "Montana": "MT",
    "Nebraska": "NE",
    "Nevada": "NV",
    "New Hampshire": "NH",
    "New Jersey": "NJ",
    "New Mexico": "NM",
    "New York": "NY",
    "North Carolina": "NC",
    "North Dakota": "ND",
    "Northern Mariana Islands": "MP",
    "Ohio": "OH",
    "Oklahoma": "OK",
    "Oregon": "OR",
    "Pennsylvania": "PA",
    "Puerto Rico": "PR",
    "Rhode Island": "RI",
    "South Carolina": "SC",
    "South Dakota": "SD",
    "Tennessee": "TN",
    "Texas": "TX",
    "Trust Territories": "TT",
    "Utah": "UT",
    "Vermont": "VT",
    "Virgin Islands": "VI",
    "Virginia": "VA",
    "Washington": "WA",
    "West Virginia": "WV",
    "Wisconsin": "WI",
    "Wyoming": "WY",
}

# Employer names as they occur in eligibility files, and the
# name used for them everywhere else.
CUSTOMER_NAMES = {
    "7-ELEVEN, INC.": "SEVEN ELEVEN",
    "ABA EMPLOYEE SERVICES": "LIGHTHOUSE AUTISM CENTER",
    "ADVANTAGE SALES AND MARKETING": "ADVANTAGE SOLUTIONS",
    "AERA ENERGY SERVICES COMPANY": "AERA ENERGY",
    "API GROUP, INC": "API GROUP",
    "CALIFORNIA HIGHWAY PATROL": "CALIFORNIA ASSOCIATION OF HIGHWAY PATROLMEN",
    "CENTERWELL": "CENTERWELL HOME HEALTH",
    "COREWELL": "COREWELL HEALTH",
    "EMD": "BENEFITS4ME",
    "ENERCON SERVICES, INC.": "ENERCON",
    "ENLYTE (FORMERLY MITCHELL-GENEX SERVICES)": "ENLYTE",
    "FIRST AMERICAN FINANCIAL CORP": "FIRST AMERICAN FINANCIAL",
    "FULL BLOOM": "CATAPULT",
    "GENERAL MILLS, INC.": "GENERAL MILLS",
    "GREIF PACKAGING": "GREIF INC",
    "INTUIT INC.": "INTUIT",
    "L3HARRISTECHNOLOGIESINC": "L3HARRIS",
    "LAND O'LAKES, INC.": "LAND O'LAKES",
    "LANDRY'S AND GOLDEN NUGGET": "LANDRYS INC",
    "LASSONDE PAPPAS": "LASSONDE PAPPAS AND COMPANY",
    "LOWES": "LOWE'S",
    "NEW ARCLIN U.S. HOLDING CORP.": "ARCLIN",
    "PEPSI-COLA AND NATIONAL BRAND BEVERAGES": "HONICKMAN",
    "PRISM/CITY OF REDDING": "CITY OF REDDING",
    "PRISM/COUNTY OF SANTA BARBARA": "COUNTY OF SANTA BARBARA",
    "RACETRAC PETROLEUM, INC.": "RACETRAC",
    "RED RIVER TECHNOLOGY LLC": "RED RIVER TECHNOLOGY",
    "SA RECYCLING, LLC": "SA RECYCLING",
    "TEMPLE UNIVERSITY HEALTH SYSTEM": "TEMPLE",
    "TUTOR PERINI CORPORATION": "TUTOR PERINI",
    "UGI": "AMERIGAS",
    "UNISYS CORPORATION": "UNISYS",
}

# Employer names that stand for "no employer given".  Callers
# add the house names of their own organisation.
PLACEHOLDER_CUSTOMERS = ("BK", "BLANK")

# Chronic-condition value sets.
CHRONIC_CONDITIONS = (
    "ASTHMA",
    "ATRIAL_FIBRILLATION",
    "BLOOD_DYSCRASIAS",
    "CARDIOVASCULAR_DISEASE",
    "CHRONIC_PAIN",
    "CKD3TO5_ESRD_DIALYSIS",
    "COPD",
    "CORONARY_ARTERY_DISEASE",
    "DEPRESSION",
    "DIABETES_MELLITUS",
    "EATING_DISORDERS",
    "HEART_FAILURE",
    "HYPERLIPIDEMIA",
    "HYPERTENSION",
    "IMMUNODEFICIENCY_DISORDERS",
    "INFLAMMATORY_BOWEL_DISEASE",
    "LIVER_DISEASE_ALL",
    "MALIGNANT_NEOPLASM",
    "OBESITY_MORBID",
    "OSTEOARTHRITIS",
    "PERIPHERAL_VASCULAR_DISEASE",
    "PSYCHOSIS_AFFECTIVE",
    "RHEUMATOID_ARTHRITIS",
    "SUBSTANCE_DEPENDENCE",
)

# Drug value sets that mark diabetes, and those excluded.
DIABETES_DRUG_SETS = ("INSULIN", "DIABETES_MEDS_NOT_INSULIN")
DIABETES_DRUG_EXCLUSION_SETS = ("GLP1_RA",)

# Diagnoses for which an emergency visit counts as avoidable.
AVOIDABLE_ER_SETS = (
    "ALLERGIC_CONDITIONS",
    "BRONCHITIS_ACUTE",
    "CONJUNCTIVITIS",
    "CONSTIPATION",
    "HEADACHE",
    "LOWER_BACK_PAIN",
    "OTITIS_MEDIA",
    "PRESCRIPTION_REFILL",
    "RASH_DERMATITIS_INSECT_BITES",
    "SPRAINS_STRAINS",
    "UPPER_RESPIRATORY_INFECTION",
    "URINARY_INFECTION",
)

# LIKE patterns on revenue-code descriptions; the first that
# matches names the category.
REVENUE_RULES = (
    ("%Emergency Room%", "ER"),
    ("%Urgent Care%", "UC"),
    ("%Screening Mammography%", "Mammogram"),
    ("%Room & Board%", "Inpatient"),
    ("%room and board%", "Inpatient"),
    ("%Labor Room%", "Inpatient"),
    ("%Inpatient Renal Dialysis%", "Inpatient"),
    ("%Hospital Visit%", "Inpatient"),
    ("%Intensive Care%", "Inpatient"),
    ("%Coronary Care%", "Inpatient"),
    ("%Operating Room Services%", "Surgery"),
)
# Rules that name a category but do not select a code by themselves.
REVENUE_RULES_NOT_SELECTING = ("%Urgent Care%",)
# The same for places of service.
PLACE_RULES = (
    ("%Emergency Room%", "ER"),
    ("%Office%", "Office Visits"),
    ("%Inpatient Hospital%", "Inpatient"),
)

# Visit categories, and those that count as acute care.
VISIT_CATEGORIES = (
    "Avoidable ER", "ER", "Inpatient", "Mammogram", "Office Visits", "Surgery", "UC",
)
ACUTE_CATEGORIES = ("ER", "Inpatient")

# Programme names of the event extracts.
SAVINGS_CATEGORIES = (
    "High Cost Claimants (HCC)",
    "Case Management",
    "Disease Management",
    "Maternity Program",
    "Treatment Decision Support",
)
NAVIGATION_PROGRAMS = (
    "Conditions Care", "Symptoms Care", "Wellness Care", "Preventive Care", "Care Navigation",
)
FUNNEL_EXCLUDED_PATTERNS = ("%BH%", "%NICU%", "%Pediatric%")
FUNNEL_EXCLUDED_PROGRAMS = ("Pharmacy", "MSK", "MHIC")
PARTNERS = (
    "Carrot", "Carrum Health", "Cylinder", "Equip Health", "FOLX Health", "Headspace Care",
    "Hinge Health", "Kindbody", "Lantern", "Lyra", "Rx Savings Solutions", "SurgeryPlus",
    "Sword", "Virta Health", "WellRight",
)
RENAMED_PARTNERS = {"SurgeryPlus": "Lantern"}
VOID_TASK_STATES = ("duplicate", "rejected", "cancelled", "entered-in-error", "draft")

# Code ranges and sets of the day-count rules.
ER_REVENUE = ("R450", "R451", "R452", "R459", "R981")
ER_CPT_RANGES = (("99281", "99285"),)
ER_HCPCS_RANGES = (("G0380", "G0384"),)
INPATIENT_REVENUE = ("R987",)
INPATIENT_REVENUE_RANGES = (
    ("R100", "R169"), ("R200", "R229"), ("R720", "R722"), ("R800", "R804"),
)
INPATIENT_CPT_RANGES = (
    ("99221", "99223"), ("99231", "99233"), ("99238", "99239"), ("99251", "99255"),
    ("99291", "99292"), ("99356", "99357"),
)
URGENT_CARE_REVENUE = ("R456",)
URGENT_CARE_HCPCS = ("S9083", "S9088")
MAMMOGRAM_REVENUE = ("R403",)
SURGERY_REVENUE = ("R360", "R361", "R362", "R369")
OUTPATIENT_REVENUE = ("R500", "R509")
