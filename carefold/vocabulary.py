"""The closed clinical vocabulary that checks, grounding and linkage share."""

from __future__ import annotations

# Drugs of each class.
DRUG_CLASSES = {
    "penicillin": ["penicillin", "amoxicillin", "ampicillin", "dicloxacillin", "piperacillin", "amoxicillin-clavulanate"],
    "cephalosporin": ["cephalexin", "cefazolin", "ceftriaxone", "cefuroxime", "cefepime"],
    "carbapenem": ["meropenem", "imipenem", "ertapenem"],
    "macrolide": ["azithromycin", "clarithromycin"],
    "fluoroquinolone": ["ciprofloxacin", "levofloxacin"],
    "sulfonamide": ["sulfamethoxazole", "trimethoprim-sulfamethoxazole"],
    "glycopeptide": ["vancomycin"],
    "tetracycline": ["doxycycline"],
    "ace_inhibitor": ["lisinopril", "enalapril", "ramipril"],
    "arb": ["losartan", "valsartan"],
    "calcium_channel_blocker": ["amlodipine", "diltiazem"],
    "beta_blocker": ["metoprolol", "atenolol"],
    "biguanide": ["metformin"],
    "sulfonylurea": ["glipizide"],
    "insulin": ["insulin"],
    "statin": ["atorvastatin", "rosuvastatin", "simvastatin"],
    "thiazide": ["hydrochlorothiazide"],
    "nsaid": ["ibuprofen", "naproxen", "aspirin", "diclofenac"],
}
# Classes that react with each other.
CROSS_REACTIVE = {"beta_lactam": ["penicillin", "cephalosporin", "carbapenem"]}
# What a condition is watched by, as (analyte, months).
MONITORING = {
    "type 2 diabetes": [("hba1c", 3)],
    "type 1 diabetes": [("hba1c", 3)],
    "diabetes": [("hba1c", 3)],
    "chronic kidney disease": [("creatinine", 6), ("egfr", 6)],
    "hypertension": [("blood pressure", 6)],
    "hyperlipidemia": [("ldl", 12)],
    "heart failure": [("creatinine", 6), ("potassium", 6)],
    "atrial fibrillation": [("inr", 1)],
}
# Conditions that run in families, by category.
HEREDITARY = {
    "cardiovascular": ["myocardial infarction", "heart attack", "coronary artery disease", "stroke", "sudden cardiac death"],
    "metabolic": ["diabetes", "type 2 diabetes"],
    "oncologic": ["breast cancer", "ovarian cancer", "colon cancer", "colorectal cancer"],
}
# First-degree relatives, and who the patient is to each.
PARENTS = ["father", "mother", "parent"]
CHILDREN = ["son", "daughter", "child"]
SIBLINGS = ["brother", "sister", "sibling"]
FIRST_DEGREE = [*PARENTS, *SIBLINGS, *CHILDREN]
INVERSE = dict.fromkeys(PARENTS, "child") | dict.fromkeys(CHILDREN, "parent") | dict.fromkeys(SIBLINGS, "sibling")
# Years between relatives that are plausible, and the age below which an event is early.
PARENT_GAP, SIBLING_GAP = (12, 70), 30
EARLY_ONSET = 55
# Names of analytes by a part of them; the first part found decides.
ANALYTE_PARTS = {
    "hba1c": "hba1c", "a1c": "hba1c", "glycated": "hba1c", "ldl": "ldl", "hdl": "hdl", "triglyc": "triglycerides",
    "cholesterol": "cholesterol", "creatinine": "creatinine", "egfr": "egfr", "potassium": "potassium", "sodium": "sodium",
    "inr": "inr", "glucose": "glucose", "bmi": "bmi",
}
# Flags that call a result abnormal, analytes that get worse by rising, and risk factors, which get no gap.
ABNORMAL = ["high", "low", "abnormal", "critical"]
RISING_BAD = ["hba1c", "ldl", "creatinine", "glucose", "potassium", "inr"]
RISK_FACTORS = ["ldl", "hdl", "cholesterol", "triglycerides", "bmi"]
# What in a later note, procedure or condition follows up an analyte; others by their own name.
FOLLOWUP = {
    "creatinine": ["creatinine", "renal", "kidney", "nephrolog", "egfr"],
    "egfr": ["egfr", "creatinine", "renal", "kidney", "nephrolog"],
    "hba1c": ["hba1c", "a1c", "diabet", "glycemic", "glycaemic", "endocrin"],
    "potassium": ["potassium", "electrolyte"],
    "inr": ["inr", "warfarin", "anticoag"],
}
NOTES = ["note", "referral", "followup", "plan"]
GAP_DAYS = 90
# Resource type by subject.
RESOURCE_TYPES = {
    "allergy": "Allergy", "diagnosis": "Condition", "condition": "Condition", "medication": "Medication", "lab": "LabResult",
    "labresult": "LabResult", "vital": "Vital", "family": "FamilyHistory", "family_history": "FamilyHistory",
    "lifestyle": "Lifestyle", "procedure": "Procedure", "immunization": "Immunization", "document": "SourceDoc",
}
# Sections of a brief by resource type.
SECTIONS = {
    "Condition": "conditions", "Medication": "medications", "Allergy": "allergies", "LabResult": "labs",
    "FamilyHistory": "family", "Lifestyle": "lifestyle", "Vital": "vitals", "Procedure": "procedures",
}
# What cards suggest, and what is said of an order; braces stand for what the card is about.
SUGGESTIONS = {
    "allergy": ["Avoid {} and other {} agents", "Choose a non-cross-reactive alternative", "Reconfirm the allergy and reaction with the patient"],
    "trend": ["Review {} management", "Consider treatment intensification or specialist referral"],
    "gap": ["Order a repeat {}", "Refer to the relevant specialist", "Document a follow-up plan"],
    "heart": ["Assess 10-year cardiovascular risk", "Discuss smoking cessation", "Consider lipid-lowering therapy and cardiovascular review"],
    "hereditary": ["Consider {} screening per family-history guidelines"],
}
ORDER_FINDINGS = "Prescribe-time safety findings (nothing has been ordered):"
ORDER_CLEAR = "No allergy or contraindication found for {} in this patient's records. This is a safety screen only — confirm dosing and interactions for your review."
# Order of severity and of certainty.
SEVERITY = {"critical": 0, "warning": 1, "info": 2}
CERTAINTY = {"settled": 0, "low_confidence": 1, "contested": 2}
LOW_CONFIDENCE = 0.6

DRUG_CLASS = {drug: name for name, drugs in DRUG_CLASSES.items() for drug in drugs}
CLASS_GROUP = {name: group for group, names in CROSS_REACTIVE.items() for name in names}
FAMILY_RISK = {condition: name for name, conditions in HEREDITARY.items() for condition in conditions}
