"""Identifiers, code lists, labels and texts that outputs must carry exactly."""

from __future__ import annotations

# --- Event constants -------------------------------------------------------------------------
SOURCE_SYSTEM = "GLIMS_SIM"
ORIGIN_SOURCE = "SYNTHEA"
EVENT_CREATED = "LAB_RESULT_CREATED"
EVENT_UPDATED = "LAB_RESULT_UPDATED"
EVENT_VALIDATED = "LAB_RESULT_VALIDATED"
SILVER_EVENT_TYPES = ("LAB_RESULT_CREATED", "LAB_RESULT_UPDATED", "LAB_RESULT")

# --- Topics ----------------------------------------------------------------------------------
TOPIC_PATIENT = "glims.patient"
TOPIC_ORDER = "glims.order"
TOPIC_SPECIMEN = "glims.specimen"
TOPIC_RESULT = "glims.result"
TOPIC_VALIDATION = "glims.validation"

# --- Identifiers -----------------------------------------------------------------------------
ID_NAMESPACE = "edfd8fc0-27fe-4dd0-9345-04878fc56d09"
OBSERVATION_KEY_PREFIX = "SYNTHEA|"
MIN_SECRET_LENGTH = 32

# --- Number found in a free-text value -------------------------------------------------------
NUMBER_PATTERN = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)"

# --- Code lists ------------------------------------------------------------------------------
FLAG_HIGH, FLAG_LOW, FLAG_NORMAL, FLAG_UNKNOWN = "H", "L", "N", "UNKNOWN"
READY_FOR_AI, INCOMPLETE = "READY_FOR_AI", "INCOMPLETE"
AI_DRAFT = "AI_DRAFT"
BIOLOGIST_VALIDATED = "BIOLOGIST_VALIDATED"
REJECTED = "REJECTED"
OUTDATED = "OUTDATED"
FINAL_PDF, DRAFT_PDF = "FINAL_PDF", "DRAFT_PDF"
EXPORT_GENERATED, EXPORT_FAILED = "GENERATED", "FAILED"
ACTION_VALIDATED, ACTION_REJECTED = "VALIDATED", "REJECTED"
REMOTE_PROVIDER = "remote_medgemma"
TEMPLATE_PROVIDER = "mock_medgemma"

STATUS_LABELS = {
    "READY_FOR_AI": "READY FOR AI",
    "AI_DRAFT": "AI DRAFT",
    "BIOLOGIST_VALIDATED": "VALIDATED",
    "REJECTED": "REJECTED",
    "OUTDATED": "OUTDATED",
    "PDF_GENERATED": "PDF GENERATED",
    "UNKNOWN": "UNKNOWN",
}

# --- Reference ranges: code, name, low, high, unit -------------------------------------------
REFERENCE_RANGES = [
    ("2345-7", "Glucose", 70.0, 99.0, "mg/dL"),
    ("2339-0", "Glucose", 70.0, 99.0, "mg/dL"),
    ("718-7", "Hemoglobin", 12.0, 17.5, "g/dL"),
    ("6690-2", "Leukocytes", 4.0, 11.0, "10*3/uL"),
    ("777-3", "Platelets", 150.0, 450.0, "10*3/uL"),
    ("2160-0", "Creatinine", 0.6, 1.3, "mg/dL"),
    ("38483-4", "Creatinine", 0.6, 1.3, "mg/dL"),
    ("2951-2", "Sodium", 135.0, 145.0, "mmol/L"),
    ("2947-0", "Sodium", 135.0, 145.0, "mmol/L"),
    ("2823-3", "Potassium", 3.5, 5.1, "mmol/L"),
    ("6298-4", "Potassium", 3.5, 5.1, "mmol/L"),
    ("2093-3", "Cholesterol", 0.0, 200.0, "mg/dL"),
    ("18262-6", "LDL Cholesterol", 0.0, 130.0, "mg/dL"),
    ("2085-9", "HDL Cholesterol", 40.0, 100.0, "mg/dL"),
    ("4548-4", "Hemoglobin A1c", 4.0, 5.7, "%"),
]

# --- Text limits -----------------------------------------------------------------------------
PROMPT_RESULT_LINES = 40
DRAFT_ABNORMAL_LINES = 8
DRAFT_NORMAL_LINES = 5
SAMPLE_ROWS = 100

# --- Draft report text (%s slots are filled per case, in this order: patient, order, specimen,
#     first time, last time, results, abnormal, normal, unknown, abnormal lines, normal lines) --
DRAFT_TEXT = """AI Draft Biological Report

Patient ID: %s
Order ID: %s
Specimen ID: %s
Result window: %s to %s

Biological summary:
This draft summarizes %s laboratory result(s) from the available GLIMS-like context. The context includes %s abnormal, %s normal, and %s result(s) without rule-based classification.

Abnormal findings:
%s

Normal findings summary:
%s

Suggested interpretation:
The above abnormalities should be reviewed in relation to the clinical context, specimen quality, analytical method, and prior results when available. This mock provider does not establish a diagnosis and should not be used as a final medical conclusion.

Limitations:
- The source data is synthetic and pseudonymized.
- Reference-range logic is simplified for MVP demonstration.
- This report was generated by a mock MedGemma provider, not a validated medical AI model.

Biologist validation reminder:
This is an AI draft requiring review and validation by a qualified biologist before use."""

DRAFT_NO_RESULTS = "- None identified in the available context."
DRAFT_MORE_RESULTS = "- ... %s additional results not shown in this draft section."
PROMPT_MORE_RESULTS = "- ... %s additional result(s) omitted for prompt compactness."

# --- Answer text (slots: question, results, abnormal, normal, unknown) ------------------------
ANSWER_TEXT = (
    "Mock MedGemma answer based on the generated draft report and Gold context.\n\n"
    "Question: %s\n\n"
    "Context-aware answer: This case contains %s result(s), including "
    "%s abnormal result(s), %s normal result(s), and "
    "%s result(s) with unknown flag status. The draft report should be "
    "used as the primary reference, and any interpretation must remain subject to "
    "biologist validation. No definitive diagnosis is provided."
)

# --- Prompt instructions ---------------------------------------------------------------------
REPORT_INSTRUCTIONS = """You are assisting a biologist with a post-analytical laboratory report.
Use only the provided patient/order/specimen context.
Do not invent patient identity, clinical history, symptoms, or diagnosis.
Do not provide a final diagnosis.
Mention abnormal values clearly.
Summarize normal values.
Mention limitations if reference ranges or clinical context are missing.
State clearly that this is an AI-generated draft requiring biologist validation.
Keep output structured and professional.

Use these sections:
AI Draft Biological Report
Case identifiers
Results overview
Abnormal findings
Normal findings summary
Suggested biological interpretation
Limitations
Validation reminder"""

CHAT_INSTRUCTIONS = """Answer only from the generated report and Gold context.
If information is missing, say it is not available in the provided data.
Do not invent data.
Do not provide a definitive diagnosis.
Keep answers useful for a biologist."""

# --- Gate messages ---------------------------------------------------------------------------
MSG_VALIDATE_OUTDATED = "Report is OUTDATED and must be regenerated before validation."
MSG_CHAT_NO_VERSION = "No report version exists for report: %s"
MSG_CHAT_OUTDATED = "Report is OUTDATED and must be regenerated before using chatbot."
MSG_EXPORT_OUTDATED = "Report is OUTDATED and must be regenerated before PDF export."
MSG_EXPORT_NO_VERSION = "Report has no version to export."
MSG_FINAL_DRAFT = "Report must be validated before generating an official final PDF."
MSG_FINAL_REJECTED = "Rejected reports cannot generate official final PDFs."
MSG_FINAL_OTHER = "Only BIOLOGIST_VALIDATED reports can generate official final PDFs."
MSG_DRAFT_BLOCKED = "Rejected or outdated reports cannot generate draft PDFs."
MSG_CASE_MISSING = "Gold context case not found for patient_id=%s, order_id=%s, specimen_id=%s"
MSG_REPORT_MISSING = "Report not found: %s"
MSG_CASE_AMBIGUOUS = "Multiple specimens found for patient/order. Provide specimen_id."
MSG_WRONG_PROVIDER = "Remote provider mismatch: expected remote_medgemma."
MSG_NOT_REAL = "Remote MedGemma response did not include is_real_llm=true."
MSG_NO_MODEL = "Remote MedGemma response did not include model_name."
MSG_NO_TEXT = "Remote MedGemma response did not include %s."
