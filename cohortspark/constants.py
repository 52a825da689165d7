"""Fixed values of the study design; every one is a default that callers can replace."""

# Laboratory rules (unit mIU/L) and calendar windows (days).
UPPER_LIMIT = 4.5
LOWER_LIMIT = 0.5
MIN_AGE = 19
BASELINE_DAYS = 364
LOOKBACK_DAYS = 180
ERA_GAP = 7
SPAN_GAP = 30
FOLLOW_UP_DAYS = 365
RECENCY_BINS = (30, 60, 90, 180)

# Matching.
CONTROLS_PER_CASE = 4
AGE_BAND = 5
ENTRY_BAND = 30

# Concept ids.
MALE = 8507
T3_CODES = (3010340, 3030897, 3008304)
T4_CODES = (3016451, 3016991, 3032367, 3024908, 3014620, 3003045)
FREE_T4_CODES = (1175900, 3008486, 3008598, 3032600, 3016363, 40761932)
RADIOIODINE_CODES = (4036252, 4333348, 4331674, 4161520, 4040441, 4161255)
HORMONES = {"T3": T3_CODES, "T4": T4_CODES, "freeT4": FREE_T4_CODES}

# Surgery billing codes, found anywhere inside the source value.
SURGERY_PATTERNS = ("P4551", "P4552", "P4553", "P4554")

# Drug classes, in the order of the flags cdr1..cdr18.
DRUG_CLASSES = (
    "TKI", "cancerimmunotherapy", "antituberculosis", "dobutamine", "octreotide", "interferonalfa",
    "lithium", "amiodarone", "azathioprine", "mercaptopurine", "warfarin", "dopamine",
    "metformin", "nsaid", "acetaminophen", "oxycodone", "colchicine", "corticosteroid",
)

COMORBIDITIES = tuple(f"CCI{i}" for i in range(1, 18))
DRUG_FLAGS = tuple(f"cdr{i}" for i in range(1, 19))

# Weights of the comorbidity score. CCI7 counts 1 + 4, and CCI17 does not count.
SCORE_WEIGHTS = {
    "CCI2": 2, "CCI5": 2, "CCI6": 1, "CCI7": 5, "CCI9": 2, "CCI11": 1, "CCI12": 2,
    "CCI13": 1, "CCI14": 2, "CCI15": 4, "CCI16": 6,
}
SCORE_CUTS = (1, 2, 3)

# First age of each band after the first; ages under 19 or over 79 fall in the last band.
AGE_BANDS = ((19, 29), (30, 39), (40, 49), (50, 59), (60, 69), (70, 79))

# The variables of the frequency table, in order, and those that never enter a model.
TABLE_VARIABLES = ("gender_concept_id", "allo", *COMORBIDITIES, "cdis1", *DRUG_FLAGS,
                   "agegr", "enrollyear", "CCI", "CCIGR")
NOT_MODELLED = ("gender_concept_id", "agegr", "CCI", "CCIGR")

# Labels of the attrition table.
ATTRITION_LABELS = (
    "total patient", "TSH patient", "adult", "exclusion1: TSH abnormal", "exclusion1: condition",
    "exclusion1: Thyroidectomy", "exclusion1: drug", "exclusion1: I-131 therapy", "patient", "control",
)

# ICD-10 chapters (number, first code, last code, title, Korean title).
ICD_CHAPTERS = (
    (1, "A00", "B99", "Certain infectious and parasitic diseases", "특정 감염성 및 기생충성 질환"),
    (2, "C00", "D48", "Neoplasms", "신생물"),
    (3, "D50", "D89", "Diseases of the blood and blood-forming organs and certain disorders involving the "
     "immune mechanism", "혈액 및 조혈기관의 질환과 면역 메커니즘을 침범한 특정 장애"),
    (4, "E00", "E90", "Endocrine, nutritional and metabolic diseases", "내분비, 영양 및 대사 질환"),
    (5, "F00", "F99", "Mental and behavioural disorders", "정신 및 행동 장애"),
    (6, "G00", "G99", "Diseases of the nervous system", "신경계통의 질환"),
    (7, "H00", "H59", "Diseases of the eye and adnexa", "눈 및 눈 부속기의 질환"),
    (8, "H60", "H95", "Diseases of the ear and mastoid process", "귀 및 유돌의 질환"),
    (9, "I00", "I99", "Diseases of the circulatory system", "순환계통의 질환"),
    (10, "J00", "J99", "Diseases of the respiratory system", "호흡계통의 질환"),
    (11, "K00", "K93", "Diseases of the digestive system", "소화계통의 질환"),
    (12, "L00", "L99", "Diseases of the skin and subcutaneous tissue", "피부 및 피하조직의 질환"),
    (13, "M00", "M99", "Diseases of the musculoskeletal system and connective tissue", "근골격계통 및 결합조직의 질환"),
    (14, "N00", "N99", "Diseases of the genitourinary system", "비뇨생식계통의 질환"),
    (15, "O00", "O99", "Pregnancy, childbirth and the puerperium", "임신, 출산 및 산후기"),
    (16, "P00", "P96", "Certain conditions originating in the perinatal period", "출생전후기에 기원한 특정 병태"),
    (17, "Q00", "Q99", "Congenital malformations, deformations and chromosomal abnormalities",
     "선천기형, 변형 및 염색체 이상"),
    (18, "R00", "R99", "Symptoms, signs and abnormal clinical and laboratory findings, not elsewhere classified",
     "달리 분류되지 않은 증상, 징후와 임상 및 검사의 이상 소견"),
    (19, "S00", "T98", "Injury, poisoning and certain other consequences of external causes",
     "손상, 중독 및 외인에 의한 특정 기타 결과"),
    (20, "V01", "Y98", "External causes of morbidity and mortality", "질병이환 및 사망의 외인"),
    (21, "Z00", "Z99", "Factors influencing health status and contact with health services",
     "건강상태 및 보건서비스 접촉에 영향을 주는 요인"),
    (22, "U00", "U99", "Codes for special purposes", "특수목적코드"),
)

# The letters (and, for D and H, the numbers) that send a code to a chapter in the default mode.
# W, X and U are not assigned, Y goes to 20, and D and H codes outside the numbers are not assigned.
CHAPTER_LETTERS = (
    ("A", None, None, 1), ("B", None, None, 1), ("C", None, None, 2), ("D", 1, 48, 2), ("D", 50, 89, 3),
    ("E", None, None, 4), ("F", None, None, 5), ("G", None, None, 6), ("H", 0, 59, 7), ("H", 60, 95, 8),
    ("I", None, None, 9), ("J", None, None, 10), ("K", None, None, 11), ("L", None, None, 12),
    ("M", None, None, 13), ("N", None, None, 14), ("O", None, None, 15), ("P", None, None, 16),
    ("Q", None, None, 17), ("R", None, None, 18), ("S", None, None, 19), ("T", None, None, 19),
    ("V", None, None, 20), ("Y", None, None, 20), ("Z", None, None, 21),
)
