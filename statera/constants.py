"""Closed vocabularies and fixed values of the reconciliation domain."""

from __future__ import annotations

# Names, patterns and numbers that results depend on.
OEMS = ("meridian", "northstar", "kaizen", "atlas")
SCHEDULES = {
    "parts_statement": "parts_payable",
    "warranty_credit_memo": "warranty_receivable",
    "floorplan_statement": "floorplan_liability",
    "incentive_statement": "incentive_receivable",
}
PRIMARY_REFERENCES = {
    "parts_statement": ("invoice_number",),
    "warranty_credit_memo": ("claim_number",),
    "floorplan_statement": ("vin",),
    "incentive_statement": ("program_code", "vin"),
}
PAYMENT_TYPES = ("warranty_credit_memo", "incentive_statement")
FAMILIES = ("amount", "date", "reference", "text")
TIERS = ("clean_digital", "scan_light", "scan_heavy", "csv", "xlsx", "corrupted")
ROUTES = ("digital_pdf", "scanned_pdf", "csv", "xlsx", "unprocessable")
EXCEPTION_TYPES = ("missing_from_ledger", "missing_from_statement", "amount_mismatch", "duplicate", "short_pay", "timing_difference")
FIELD_FAMILIES = {
    "statement_number": "reference",
    "statement_date": "date",
    "total": "amount",
    "subtotal": "amount",
    "previous_balance": "amount",
    "claim_number": "reference",
    "ro_number": "reference",
    "vin": "reference",
    "invoice_number": "reference",
    "program_code": "reference",
    "line_date": "date",
    "line_amount": "amount",
    "description": "text",
}
REFERENCES = ("claim_number", "ro_number", "vin", "invoice_number", "program_code")
GRAMMARS = {
    "claim_number": {"meridian": r"\d{4}[A-Z]\d{5}", "northstar": r"NS\d{8}", "kaizen": r"K\d{3}-\d{6}", "atlas": r"AT\d{7}"},
    "ro_number": {"meridian": r"RO\d{6}", "northstar": r"\d{6}", "kaizen": r"RO-\d{6}", "atlas": r"R\d{7}"},
    "invoice_number": {"meridian": r"M\d{7}", "northstar": r"INV\d{7}", "kaizen": r"\d{8}", "atlas": r"AX\d{6}"},
    "program_code": {"meridian": r"PGM-\d{4}", "northstar": r"NS-[A-Z]{2}\d{3}", "kaizen": r"KZN\d{4}", "atlas": r"ATLAS-\d{3}"},
}
HEADER_SYNONYMS = {
    "claim_number": ("claim number", "claim_no", "claimnbr", "claim #"),
    "ro_number": ("ro number", "repairorder", "ro #", "ro_no"),
    "vin": ("vin", "vin #", "vehicle id"),
    "invoice_number": ("invoice number", "invoice #", "inv_no", "invoicenbr"),
    "program_code": ("program code", "program", "pgm_cd"),
    "line_date": ("date", "post dt", "post date", "trans date"),
    "description": ("description", "desc", "detail"),
    "line_amount": ("amount", "amt", "net amount", "amount_usd"),
}
# Captions and labels of printed statements, lower case without blanks and punctuation.
COLUMN_LABELS = {
    "line_date": ("date", "postdate", "transdate"),
    "claim_number": ("claim", "claimno", "claimnumber"),
    "ro_number": ("ro", "rono", "ronumber", "repairorder"),
    "vin": ("vin", "unitvin", "vehicleid"),
    "invoice_number": ("invoice", "invoiceno", "invoicenumber"),
    "program_code": ("program", "programcode", "pgmcd"),
    "description": ("description", "desc", "detail"),
    "line_amount": ("amount", "amt", "netamount"),
}
HEADER_LABELS = {
    "statement_date": ("statementdate", "stmtdate", "memodate", "issued", "dated"),
    "statement_number": ("statementno", "statementnumber", "stmtno", "memono", "statement", "memo"),
    "previous_balance": ("previousbalance", "balanceforward"),
    "subtotal": ("subtotal", "purchasesthisperiod", "activitythisperiod"),
    "total": ("totaldue", "amountdue", "balancedue", "endingbalancedue", "memototal", "totalearned", "totalcredit"),
}
VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
VIN_VALUES = {
    "0": 0, "1": 1, "2": 2, "3": 3, "4": 4, "5": 5, "6": 6, "7": 7, "8": 8, "9": 9,
    "A": 1, "B": 2, "C": 3, "D": 4, "E": 5, "F": 6, "G": 7, "H": 8,
    "J": 1, "K": 2, "L": 3, "M": 4, "N": 5, "P": 7, "R": 9,
    "S": 2, "T": 3, "U": 4, "V": 5, "W": 6, "X": 7, "Y": 8, "Z": 9,
}
# List prices in microusd per million tokens: prompt, completion.
PRICES = {
    "gemini-3.5-flash": (300_000, 2_500_000),
    "gemini-3.5-pro": (1_250_000, 10_000_000),
    "llama-3.3-70b-versatile": (590_000, 790_000),
    "nemotron-nano-12b-v2-vl": (100_000, 400_000),
    "mistral-small": (200_000, 600_000),
    "qwen2.5vl": (100_000, 400_000),
    "qwen3-vl": (100_000, 400_000),
}
TARGETS = {"amount": 0.995, "reference": 0.995, "date": 0.99, "text": 0.97}
GRACE_DAYS, DECAY_DAYS = 60, 45
WEIGHTS, FUZZY_LEAST = (0.5, 0.35, 0.15), 0.6
