"""Fixed values of the clinical rule packs and safety tables, as Spark DataFrames.

Rule packs are lists of dictionaries, so others can be given in the same form (``rules_from_json``).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources import packs

#: Laboratory rules (id, observation, operator, value, unit, condition, reason, severity).
LAB_RULES = """
potassium_hyperkalemia | Potassium | gte | 5.5 | mmol/L | Hyperkalemia | elevated_potassium | high
glucose_hyperglycemia | Glucose | gte | 180 | mg/dL | Hyperglycemia | elevated_glucose | moderate
hba1c_diabetes | HbA1c | gte | 6.5 | percent | Diabetes Mellitus | elevated_hba1c | moderate
creatinine_ckd | Creatinine | gt | 1.2 | mg/dL | Chronic Kidney Disease | elevated_creatinine | high
egfr_ckd | eGFR | lt | 60 | mL/min | Chronic Kidney Disease | low_egfr | high
troponin_ami | Troponin I | gt | 0.04 | ng/mL | Acute Myocardial Infarction | elevated_troponin | critical
wbc_infection | WBC | gt | 11.0 | 10^3/uL | Infection | elevated_wbc | moderate
inr_anticoagulation_concern | INR | gt | 3.0 | ratio | Anticoagulation Concern | supratherapeutic_inr | high
ldl_hyperlipidemia | LDL | gt | 130 | mg/dL | Hyperlipidemia | elevated_ldl | moderate
tsh_hypothyroidism | TSH | gt | 4.5 | mIU/L | Hypothyroidism | elevated_tsh | moderate
tsh_hyperthyroidism | TSH | lt | 0.5 | mIU/L | Hyperthyroidism | low_tsh | moderate
hemoglobin_anemia | Hemoglobin | lt | 12.0 | g/dL | Anemia | low_hemoglobin | moderate
sodium_hyponatremia | Sodium | lt | 135 | mmol/L | Hyponatremia | low_sodium | high
sodium_hypernatremia | Sodium | gt | 145 | mmol/L | Hypernatremia | high_sodium | high
"""

#: Claim rules (id, claim type or empty, procedure codes or empty, outcome, severity).
CLAIM_RULES = """
institutional_claim_hospitalization | institutional | | HO | moderate
hospital_cpt_hospitalization | | 99232 99285 99291 99223 | HO | moderate
critical_care_life_threatening | | 99291 92950 31500 | LT | high
cpr_death_signal | | 92950 | DE | high
disability_procedure_signal | | 27447 92928 | DS | moderate
intubation_life_threatening | | 31500 36556 | LT | high
"""

#: Drug interactions (from, to, risk, severity, mechanism).
INTERACTIONS = """
Warfarin | Azithromycin | bleeding_risk | high | CYP3A4_inhibition_increases_warfarin_exposure
Warfarin | Aspirin | bleeding_risk | high | additive_anticoagulation_and_antiplatelet
Lisinopril | Spironolactone | hyperkalemia_risk | moderate | dual_potassium_sparing_ACE_inhibitor_plus_K_sparing_diuretic
Albuterol | Metoprolol | bronchospasm_risk | moderate | pharmacological_antagonism_beta2_agonist_vs_beta_blocker
Metformin | Vancomycin | nephrotoxicity_risk | moderate | renal_competition_reduces_metformin_clearance
Warfarin | Fluconazole | bleeding_risk | high | CYP2C9_inhibition_markedly_raises_warfarin_INR
Aspirin | Clopidogrel | bleeding_risk | high | dual_antiplatelet_aggregation
Atorvastatin | Azithromycin | myopathy_risk | moderate | CYP3A4_inhibition_raises_statin_levels
Losartan | Spironolactone | hyperkalemia_risk | moderate | dual_RAAS_blockade
Furosemide | Vancomycin | nephrotoxicity_risk | high | synergistic_renal_toxicity
Metoprolol | Insulin Glargine | hypoglycemia_masking | moderate | beta_blockade_masks_tachycardia_warning_sign
Dexamethasone | Insulin Glargine | hyperglycemia_risk | moderate | glucocorticoid_induced_insulin_resistance
Clopidogrel | Omeprazole | reduced_antiplatelet_efficacy | moderate | CYP2C19_inhibition_reduces_clopidogrel_activation
Hydrochlorothiazide | Furosemide | electrolyte_depletion | moderate | additive_diuresis_hypokalemia_hyponatremia
Morphine | Gabapentin | respiratory_depression | high | additive_CNS_depression
Warfarin | Ibuprofen | bleeding_risk | high | NSAID_inhibits_platelet_aggregation_and_displaces_warfarin
Warfarin | Heparin | bleeding_risk | high | dual_anticoagulation
Warfarin | Enoxaparin | bleeding_risk | high | dual_anticoagulation_LMWH_plus_VKA
Warfarin | Amoxicillin | bleeding_risk | moderate | gut_flora_disruption_increases_INR
Sertraline | Morphine | serotonin_syndrome | high | SSRI_plus_opioid_serotonergic_synergy
Sertraline | Aspirin | GI_bleeding_risk | moderate | SSRI_impairs_platelet_serotonin_uptake
Sertraline | Ibuprofen | GI_bleeding_risk | moderate | SSRI_plus_NSAID_additive_bleeding
Lisinopril | Losartan | hyperkalemia_risk | high | dual_RAAS_blockade_ACEi_plus_ARB
Digoxin | Amiodarone | digoxin_toxicity | high | amiodarone_reduces_digoxin_clearance
Digoxin | Furosemide | digoxin_toxicity | moderate | hypokalemia_increases_digoxin_sensitivity
Digoxin | Spironolactone | digoxin_toxicity | moderate | spironolactone_reduces_digoxin_clearance
Apixaban | Aspirin | bleeding_risk | high | DOAC_plus_antiplatelet_additive_bleeding
Rivaroxaban | Aspirin | bleeding_risk | high | DOAC_plus_antiplatelet_additive_bleeding
Enoxaparin | Aspirin | bleeding_risk | high | LMWH_plus_antiplatelet
Prednisone | Ibuprofen | GI_ulceration_risk | high | corticosteroid_plus_NSAID_mucosal_injury
Prednisone | Insulin Glargine | hyperglycemia_risk | moderate | glucocorticoid_induced_insulin_resistance
Metoprolol | Diltiazem | severe_bradycardia | high | additive_AV_node_blockade
Metoprolol | Carvedilol | severe_bradycardia | high | duplicate_beta_blockade
Sacubitril-Valsartan | Lisinopril | angioedema_risk | high | ARNI_plus_ACEi_contraindicated_within_36h
Empagliflozin | Furosemide | dehydration_hypotension | moderate | SGLT2i_plus_loop_diuretic_volume_depletion
Ceftriaxone | Furosemide | nephrotoxicity_risk | moderate | synergistic_renal_tubular_toxicity
Linezolid | Sertraline | serotonin_syndrome | high | MAOi_activity_plus_SSRI
Ondansetron | Azithromycin | QT_prolongation | high | additive_QT_prolonging_effect
Nitroglycerin | Amlodipine | severe_hypotension | high | additive_vasodilation
Acetaminophen | Warfarin | INR_elevation | moderate | acetaminophen_potentiates_warfarin_at_high_doses
"""

#: Contraindications (medication, condition, reason, severity).
CONTRAINDICATIONS = """
Ibuprofen | Chronic Kidney Disease | NSAID_nephrotoxicity | high
Ibuprofen | Heart Failure | NSAID_fluid_retention_worsens_HF | high
Digoxin | Hyperkalemia | hyperkalemia_increases_digoxin_toxicity | high
Empagliflozin | Chronic Kidney Disease | eGFR_dependent_efficacy_reduced_below_20 | moderate
Apixaban | Anemia | DOAC_bleeding_risk_in_anemia | high
Enoxaparin | Chronic Kidney Disease | LMWH_accumulation_in_renal_impairment | high
Warfarin | Anemia | increased_bleeding_risk | high
Lisinopril | Hyperkalemia | worsens_hyperkalemia | high
Metformin | Chronic Kidney Disease | lactic_acidosis_risk | high
Spironolactone | Hyperkalemia | worsens_hyperkalemia | high
Albuterol | Heart Failure | tachycardia_risk | moderate
Vancomycin | Chronic Kidney Disease | nephrotoxicity | high
Heparin | Anemia | increased_bleeding_risk | high
Clopidogrel | Anemia | increased_bleeding_risk | high
Prednisone | Diabetes Mellitus | steroid_induced_hyperglycemia | moderate
Dexamethasone | Diabetes Mellitus | glucocorticoid_raises_blood_glucose | moderate
Hydrochlorothiazide | Hyponatremia | thiazide_worsens_hyponatremia | high
Losartan | Hyperkalemia | ARB_raises_serum_potassium | high
Furosemide | Hyponatremia | loop_diuretic_electrolyte_depletion | moderate
Morphine | Chronic Kidney Disease | active_metabolite_accumulation | high
Gabapentin | Chronic Kidney Disease | requires_renal_dose_adjustment | moderate
Aspirin | Heart Failure | fluid_retention_worsens_heart_failure | moderate
Metoprolol | Asthma | beta_blockade_induces_bronchospasm | high
"""

#: Known reactions (medication, symptom, severity, term).
REACTIONS = """
Warfarin | palpitations | high | Palpitation
Warfarin | confusion | high | Confusion
Lisinopril | cough | moderate | Cough
Lisinopril | dizziness | low | Dizziness
Atorvastatin | fatigue | moderate | Fatigue
Atorvastatin | leg cramps | moderate | Myalgia
Amoxicillin | swelling | high | Angioedema
Amoxicillin | shortness of breath | high | Dyspnoea
Metformin | nausea | low | Nausea
Metformin | vomiting | low | Vomiting
Metoprolol | dizziness | moderate | Dizziness
Metoprolol | fatigue | low | Fatigue
Albuterol | palpitations | moderate | Palpitation
Albuterol | chest pain | moderate | Chest Pain
Levothyroxine | palpitations | moderate | Palpitation
Levothyroxine | weight loss | moderate | Weight loss
Morphine | dizziness | moderate | Dizziness
Morphine | nausea | low | Nausea
Sertraline | headache | low | Headache
Sertraline | nausea | low | Nausea
Azithromycin | nausea | low | Nausea
Azithromycin | shortness of breath | high | QT Prolongation/Dyspnoea
Amlodipine | swelling | moderate | Peripheral Oedema
Amlodipine | dizziness | low | Dizziness
Omeprazole | headache | low | Headache
Omeprazole | nausea | low | Nausea
Losartan | dizziness | low | Dizziness
Losartan | headache | low | Headache
Gabapentin | dizziness | moderate | Dizziness
Gabapentin | confusion | moderate | Confusion
Gabapentin | blurred vision | low | Vision Blurred
Hydrochlorothiazide | dizziness | moderate | Orthostatic Hypotension
Hydrochlorothiazide | leg cramps | moderate | Hypokalaemia/Muscle Cramp
Prednisone | weight loss | moderate | Weight Decreased
Prednisone | fatigue | low | Fatigue
Prednisone | night sweats | low | Night Sweats
Heparin | shortness of breath | high | Dyspnoea
Heparin | swelling | high | Heparin-Induced Thrombocytopenia
Insulin Glargine | confusion | high | Hypoglycaemia/Confusion
Insulin Glargine | dizziness | moderate | Hypoglycaemia/Dizziness
Furosemide | dizziness | moderate | Hypotension/Dizziness
Furosemide | leg cramps | moderate | Hypokalaemia/Muscle Cramp
Clopidogrel | headache | low | Headache
Clopidogrel | dizziness | low | Dizziness
Dexamethasone | fatigue | low | Fatigue
Dexamethasone | weight loss | moderate | Weight Decreased
"""

#: Outcomes of claims (code, description).
OUTCOMES = """
DE | Death
LT | Life-Threatening
HO | Hospitalization - Initial or Prolonged
DS | Disability
CA | Congenital Anomaly
OT | Other Serious (Important Medical Events)
"""

#: Classes of source systems (type, trust, privacy class, retention class).
PROVENANCE = """
EHR | high | clinical_phi | standard_clinical
LAB | high | clinical_phi | standard_clinical
DEVICE | medium | clinical_phi | standard_clinical
PHARMACY | high | medication_phi | medication_safety
CLAIMS | medium | financial_phi | revenue_cycle
REFERENCE | curated | reference_data | master_data
"""

#: Terms with a standard binding (family, local code, system, display).
VOCABULARY = """
labs | Potassium | LOINC | Potassium [Moles/volume] in Serum or Plasma
labs | Glucose | LOINC | Glucose [Mass/volume] in Blood
labs | HbA1c | LOINC | Hemoglobin A1c/Hemoglobin.total in Blood
labs | Troponin I | LOINC | Troponin I.cardiac [Mass/volume] in Serum or Plasma
conditions | Hyperkalemia | SNOMED_CT | Hyperkalemia
conditions | Chronic Kidney Disease | SNOMED_CT | Chronic kidney disease
conditions | Diabetes Mellitus | SNOMED_CT | Diabetes mellitus
medications | Warfarin | RxNorm | Warfarin
medications | Metformin | RxNorm | Metformin
medications | Lisinopril | RxNorm | Lisinopril
adverse_reactions | cough | MedDRA | Cough
adverse_reactions | palpitations | MedDRA | Palpitations
adverse_reactions | shortness of breath | MedDRA | Dyspnoea
"""


#: Terms of reference data with a standard binding (family, local code, system, code, display).
REFERENCE_VOCABULARY = """
device_types | monitor | LOCAL_DEVICE_TYPE | monitor | Monitor
device_types | wearable | LOCAL_DEVICE_TYPE | wearable | Wearable
device_types | bedside | LOCAL_DEVICE_TYPE | bedside | Bedside
device_types | implant | LOCAL_DEVICE_TYPE | implant | Implant
device_types | patch | LOCAL_DEVICE_TYPE | patch | Patch
device_types | infusion_pump | LOCAL_DEVICE_TYPE | infusion_pump | Infusion Pump
medication_drug_classes | Anticoagulant | LOCAL_DRUG_CLASS | anticoagulant | Anticoagulant
medication_drug_classes | Antihypertensive | LOCAL_DRUG_CLASS | antihypertensive | Antihypertensive
medication_drug_classes | Antidiabetic | LOCAL_DRUG_CLASS | antidiabetic | Antidiabetic
medication_drug_classes | Antibiotic | LOCAL_DRUG_CLASS | antibiotic | Antibiotic
medication_drug_classes | Bronchodilator | LOCAL_DRUG_CLASS | bronchodilator | Bronchodilator
medication_drug_classes | Statin | LOCAL_DRUG_CLASS | statin | Statin
medication_drug_classes | PPI | LOCAL_DRUG_CLASS | ppi | PPI
medication_drug_classes | Beta-Blocker | LOCAL_DRUG_CLASS | beta_blocker | Beta-Blocker
medication_drug_classes | Thyroid Hormone | LOCAL_DRUG_CLASS | thyroid_hormone | Thyroid Hormone
medication_drug_classes | Anticonvulsant | LOCAL_DRUG_CLASS | anticonvulsant | Anticonvulsant
medication_drug_classes | Antidepressant | LOCAL_DRUG_CLASS | antidepressant | Antidepressant
medication_drug_classes | Diuretic | LOCAL_DRUG_CLASS | diuretic | Diuretic
medication_drug_classes | Corticosteroid | LOCAL_DRUG_CLASS | corticosteroid | Corticosteroid
medication_drug_classes | Opioid Analgesic | LOCAL_DRUG_CLASS | opioid_analgesic | Opioid Analgesic
medication_drug_classes | Antiplatelet | LOCAL_DRUG_CLASS | antiplatelet | Antiplatelet
medication_safety_tiers | routine | LOCAL_MEDICATION_SAFETY_TIER | routine | Routine
medication_safety_tiers | monitor | LOCAL_MEDICATION_SAFETY_TIER | monitor | Monitor
medication_safety_tiers | high-alert | LOCAL_MEDICATION_SAFETY_TIER | high_alert | High-Alert
patient_risk_tiers | low | LOCAL_RISK_TIER | low | Low
patient_risk_tiers | medium | LOCAL_RISK_TIER | medium | Medium
patient_risk_tiers | high | LOCAL_RISK_TIER | high | High
patient_sex | F | HL7_ADMINISTRATIVE_SEX | F | Female
patient_sex | M | HL7_ADMINISTRATIVE_SEX | M | Male
payer_plan_types | HMO | LOCAL_PAYER_PLAN_TYPE | HMO | HMO
payer_plan_types | PPO | LOCAL_PAYER_PLAN_TYPE | PPO | PPO
payer_plan_types | EPO | LOCAL_PAYER_PLAN_TYPE | EPO | EPO
payer_plan_types | POS | LOCAL_PAYER_PLAN_TYPE | POS | POS
payer_plan_types | HDHP | LOCAL_PAYER_PLAN_TYPE | HDHP | HDHP
payer_plan_types | Government | LOCAL_PAYER_PLAN_TYPE | GOVERNMENT | Government
payer_plan_types | Medicaid Managed Care | LOCAL_PAYER_PLAN_TYPE | MEDICAID_MANAGED_CARE | Medicaid Managed Care
payer_network_tiers | in-network | LOCAL_NETWORK_TIER | in-network | In-Network
payer_network_tiers | out-of-network | LOCAL_NETWORK_TIER | out-of-network | Out-Of-Network
payer_network_tiers | preferred | LOCAL_NETWORK_TIER | preferred | Preferred
provider_specialties | cardiology | NUCC_TAXONOMY_GROUPING | TBD | Cardiology
provider_specialties | internal medicine | NUCC_TAXONOMY_GROUPING | TBD | Internal Medicine
provider_specialties | family medicine | NUCC_TAXONOMY_GROUPING | TBD | Family Medicine
provider_specialties | pulmonology | NUCC_TAXONOMY_GROUPING | TBD | Pulmonology
"""

#: Conditions and symptoms that the graph starts with.
CONDITION_SEEDS = [
    "Hyperkalemia", "Hyperglycemia", "Diabetes Mellitus", "Chronic Kidney Disease", "Acute Myocardial Infarction", "Anemia", "Hyperlipidemia", "Hypothyroidism", "Hyperthyroidism", "Hyponatremia",
    "Hypernatremia", "Infection", "Anticoagulation Concern", "Hypertension", "Heart Failure", "Asthma", "Atrial Fibrillation", "Hypoglycemia", "COPD", "Pancreatitis",
]
SYMPTOM_SEEDS = ["palpitations", "confusion", "cough", "dizziness", "fatigue", "leg cramps", "swelling", "shortness of breath", "nausea", "vomiting", "chest pain", "weight loss", "headache", "blurred vision", "night sweats"]

#: Medications (name, active ingredient, whether the name is a validated trade name).
MEDICATION_SEEDS = """
Warfarin | Warfarin sodium | false
Metformin | Metformin hydrochloride | false
Atorvastatin | Atorvastatin calcium | false
Levothyroxine | Levothyroxine sodium | false
Sertraline | Sertraline hydrochloride | false
Metoprolol | Metoprolol tartrate | false
Lisinopril | Lisinopril | false
Amlodipine | Amlodipine besylate | false
Omeprazole | Omeprazole | false
Clopidogrel | Clopidogrel bisulfate | false
Furosemide | Furosemide | false
Gabapentin | Gabapentin | false
Losartan | Losartan potassium | false
Hydrochlorothiazide | Hydrochlorothiazide | false
Spironolactone | Spironolactone | false
Azithromycin | Azithromycin | false
Albuterol | Albuterol sulfate | false
Prednisone | Prednisone | false
Morphine | Morphine sulfate | false
Heparin | Heparin sodium | false
Insulin Glargine | Insulin glargine | true
Vancomycin | Vancomycin hydrochloride | false
Dexamethasone | Dexamethasone | false
Amoxicillin | Amoxicillin trihydrate | false
Aspirin | Acetylsalicylic acid | false
Fluconazole | Fluconazole | false
"""

#: Limits of laboratory tests (name, least, most, whether the most is abnormal itself).
LAB_LIMITS = [
    ("Potassium", None, 5.5, True), ("Sodium", 135, 145, False), ("Glucose", 70, 180, False), ("Creatinine", None, 1.2, False), ("BUN", None, 25, False), ("HbA1c", None, 6.5, True),
    ("WBC", 4.0, 11.0, False), ("Hemoglobin", 12.0, None, False), ("Platelets", 150, 400, False), ("TSH", 0.5, 4.5, False), ("eGFR", 60, None, False), ("LDL", None, 130, False),
    ("HDL", 40, None, False), ("ALT", None, 56, False), ("AST", None, 40, False), ("Troponin I", None, 0.04, False), ("INR", None, 3.0, False), ("Procalcitonin", None, 0.5, False),
    ("Calcium", 8.5, 10.5, False), ("Magnesium", 1.6, 2.6, False), ("Phosphate", 2.5, 4.5, False), ("C-Reactive Protein", None, 10.0, False), ("ESR", None, 20, False), ("Lactate", None, 2.0, False),
    ("BNP", None, 100, False), ("Total Bilirubin", None, 1.2, False), ("Albumin", 3.5, None, False), ("Alkaline Phosphatase", None, 147, False), ("D-Dimer", None, 0.5, False), ("Ferritin", 30, 400, False),
    ("Uric Acid", None, 7.0, False), ("Creatine Kinase", None, 200, False), ("Arterial pH", 7.35, 7.45, False), ("PaCO2", 35, 45, False), ("PaO2", 80, None, False), ("Serum Osmolality", 275, 295, False),
]


def rows_of(table: str) -> list[list[str]]:
    return [[cell.strip() for cell in line.split("|")] for line in table.strip().splitlines()]


def table(spark: SparkSession, text: str, columns: str) -> DataFrame:
    """A fixed table as a DataFrame of strings; empty cells are null."""
    names = columns.split()
    return spark.createDataFrame([[c or None for c in row] for row in rows_of(text)], ", ".join(f"{n} string" for n in names))


def lab_rules(spark: SparkSession) -> DataFrame:
    """[R01] (rule_id, observation, operator, bound double, unit, condition, reason, severity)."""
    rules = table(spark, LAB_RULES, "rule_id observation operator bound unit condition reason severity")
    return rules.withColumn("bound", F.col("bound").cast("double"))


def claim_rules(spark: SparkSession) -> DataFrame:
    """[R02] (rule_id, claim_type or null, codes array or null, outcome, severity); null matches anything."""
    rules = table(spark, CLAIM_RULES, "rule_id claim_type codes outcome severity")
    return rules.withColumn("codes", F.split("codes", " "))


def interactions(spark: SparkSession) -> DataFrame:
    """[R03, K10]"""
    return table(spark, INTERACTIONS, "drug_a drug_b risk severity mechanism")


def contraindications(spark: SparkSession) -> DataFrame:
    """[R05, K10]"""
    return table(spark, CONTRAINDICATIONS, "medication condition reason severity")


def reactions(spark: SparkSession) -> DataFrame:
    """[R04]"""
    return table(spark, REACTIONS, "medication symptom severity meddra_term")


def outcomes(spark: SparkSession) -> DataFrame:
    """[R06]"""
    return table(spark, OUTCOMES, "code description")


def provenance(spark: SparkSession) -> DataFrame:
    """[R08]"""
    return table(spark, PROVENANCE, "source_type trust_level phi_class retention_class")


def vocabulary(spark: SparkSession) -> DataFrame:
    """[R09, K14] (family, local_code, standard_system, display) and the folded lookup key."""
    words = table(spark, VOCABULARY, "family local_code standard_system display")
    return words.withColumn("lookup", F.lower("local_code"))


def reference_vocabulary(spark: SparkSession) -> DataFrame:
    """[R09, P06] (family, local_code, standard_system, standard_code, display) of reference data, and the lookup key."""
    words = table(spark, REFERENCE_VOCABULARY, "family local_code standard_system standard_code display")
    return words.withColumn("lookup", F.lower("local_code"))


def lab_limits(spark: SparkSession) -> DataFrame:
    """[P36] (name, low, high, closed)."""
    made = [(n, None if low is None else float(low), None if high is None else float(high), closed) for n, low, high, closed in LAB_LIMITS]
    return spark.createDataFrame(made, "name string, low double, high double, closed boolean")


#: What the head of an ontology file must say, and what its status may be.
HEADER = ("version", "status", "owner", "purpose")
STATUSES = ("draft", "accepted", "deprecated")


def rule_packs(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """[S11, S12, R11] Packs (id, rule as JSON) of a directory by file name: YAML or JSON, each an object with a header and a list ``rules``.

    A file that is no object, lacks a header field, has another status, or repeats or lacks a rule's id is an
    error.  A later file of the same name in a subdirectory replaces an earlier one.
    """
    found = {}
    for name, (path, content) in packs.contents(spark, directory).items():
        if missing := [f for f in HEADER if not content.get(f)]:
            raise ValueError(f"{path} lacks {missing}")
        if content["status"] not in STATUSES:
            raise ValueError(f"{path} has status {content['status']}")
        rules = [json.dumps(r, sort_keys=True) for r in content.get("rules") or []]
        made = spark.createDataFrame([(r,) for r in rules], "rule string").select("rule", F.get_json_object("rule", "$.id").alias("id"))
        found[name] = checked_ids(made, "id")
    return found


def rules_from_json(spark: SparkSession, path: str) -> DataFrame:
    """[S11, S12] Lab rules from JSON lines in the same columns; a repeated or missing id is an error."""
    rules = spark.read.schema("rule_id string, observation string, operator string, bound double, unit string, condition string, reason string, severity string").json(path)
    return checked_ids(rules, "rule_id")


def checked_ids(rules: DataFrame, key: str) -> DataFrame:
    """[R11] ``rules``, if every ``key`` is there once; otherwise ValueError with examples."""
    wrong = rules.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).limit(5).collect()
    if wrong:
        raise ValueError(f"missing or repeated {key}: {[r[key] for r in wrong]}")
    return rules


def seed_edges(spark: SparkSession) -> DataFrame:
    """[S13, K13] (kind, src_label, src, dst_label, dst, props) of the safety tables, for the property graph."""
    made = []
    for kind, rows, src, dst_label, dst, props in (
        ("INTERACTS_WITH", interactions(spark), "drug_a", "Medication", "drug_b", ("risk", "severity", "mechanism")),
        ("CONTRAINDICATED_FOR", contraindications(spark), "medication", "Condition", "condition", ("reason", "severity")),
        ("HAS_KNOWN_REACTION", reactions(spark), "medication", "Symptom", "symptom", ("severity", "meddra_term")),
    ):
        packed = F.create_map(*[x for p in props for x in (F.lit(p), F.col(p))])
        made.append(rows.select(F.lit(kind).alias("kind"), F.lit("Medication").alias("src_label"), F.col(src).alias("src"), F.lit(dst_label).alias("dst_label"), F.col(dst).alias("dst"), packed.alias("props")))
    return made[0].unionByName(made[1]).unionByName(made[2])


def seed_nodes(spark: SparkSession) -> DataFrame:
    """[R07, K11] (label, key, props): seeds, outcomes and every end of a seed edge, once each.

    Metadata goes to medications that a seed edge names; others are not there to be matched.
    """
    edges = seed_edges(spark)
    ends = edges.select(F.col("src_label").alias("label"), F.col("src").alias("key")).union(edges.select("dst_label", "dst"))
    seeds = [("Condition", c) for c in CONDITION_SEEDS] + [("Symptom", s) for s in SYMPTOM_SEEDS]
    keys = ends.union(spark.createDataFrame(seeds, "label string, key string")).distinct()
    facts = table(spark, MEDICATION_SEEDS, "key ingredient trade").select(F.lit("Medication").alias("label"), "key", F.create_map(F.lit("activeIngredient"), F.col("ingredient").cast("variant"), F.lit("isValidatedTradeNameUsed"), F.col("trade").cast("boolean").cast("variant")).alias("facts"))
    none = F.create_map().cast("map<string,variant>")
    known = keys.join(facts, ["label", "key"], "left").select("label", "key", F.coalesce("facts", none).alias("props"))
    told = outcomes(spark).select(F.lit("AdverseOutcome").alias("label"), F.col("code").alias("key"), F.create_map(F.lit("description"), F.col("description").cast("variant")).alias("props"))
    return known.unionByName(told)
