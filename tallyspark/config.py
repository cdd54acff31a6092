"""Settings of the engine. Word lists, codes and thresholds that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from pathlib import Path

NULL_TOKENS = ["", "null", "none", "nan", "n/a", "na", "-", "--", "nil", "end_of_file"]
INVISIBLE = "​‌‍﻿  ⁠"
ISO_CODES = "AED AUD BHD CAD CHF CNY DKK EUR GBP HKD INR JPY KWD MYR NOK NZD OMR QAR SAR SEK SGD USD ZAR TRY THB PLN PHP PKR BDT LKR IDR KRW MXN BRL RUB ILS CLP COP EGP NGN KES UGX TZS MAD DZD TND JOD LBP IQD".split()
SYMBOLS = [("₹", "INR"), ("€", "EUR"), ("£", "GBP"), ("$", "USD"), ("¥", "JPY"), ("د.إ", "AED"), ("aed", "AED"), ("usd", "USD"), ("eur", "EUR"), ("inr", "INR"), ("gbp", "GBP"), ("jpy", "JPY")]
SUPPORTED = "AED AUD CAD CHF CNY EUR GBP HKD INR JPY KRW MYR SGD USD ZAR NZD SEK NOK DKK PLN THB PHP BHD KWD OMR QAR SAR TRY BRL MXN IDR LKR PKR BDT NPR MUR KES UGX TZS NGN EGP MAD ILS RUB CLP COP".split()
UPPER = "payment_type debit_credit status reconciliation_status channel customer_type settlement_status txn_type confirmation_method dealing_method exception_code currency_code from_currency to_currency".split()
DATES = "txn_date txn_timestamp settlement_date messy_txn_date trade_date value_date trade_timestamp holiday_date opening_date date_of_birth kyc_expiry_date last_transaction_date date_format_local".split()
AMOUNTS = "messy_amount amount_inr processing_charge gst_on_charge fee_amount tax_amount total_cost converted_amount amount_from amount_jpy amount_usd_equiv".split()
IDENTIFIERS = "txn_id settlement_reference utr_number bank_ref_no batch_id destination_ifsc swift_code counterparty_bic primary_account_number source_account destination_account branch_code primary_branch_code reference_number rrn auth_code".split()
ENUMS = "payment_type debit_credit status reconciliation_status channel customer_type settlement_status txn_type confirmation_method dealing_method".split()
UNTOUCHED = "ingestion_timestamp source_file_name processing_batch_id txn_hash checksum_hash checksum comment notes narration".split()
SYNONYMS = {"debit_credit": {"d": "DEBIT", "dr": "DEBIT", "c": "CREDIT", "cr": "CREDIT"}, "status": {"success": "SUCCESS", "failed": "FAILED", "pending": "PENDING", "settled": "SETTLED"}}
RENAMES = {"processing_batch_id_2": "secondary_processing_batch_id"}
ALLOWED = {
    "status": ("enum_invalid_transaction_status", "SUCCESS FAILED PENDING SETTLED REVERSED CANCELLED UNKNOWN".split()),
    "reconciliation_status": ("enum_invalid_reconciliation_status", "FULL_MATCH PARTIAL_MATCH UNMATCHED BREAK PENDING".split()),
    "channel": ("enum_invalid_payment_channel", "BRANCH ATM MOBILE ONLINE POS API SWIFT RTGS NEFT IMPS CARD TREASURY TRADER CUSTOMER BRANCH_OPS".split()),
    "debit_credit": ("enum_invalid_debit_credit", "DEBIT CREDIT".split()),
}
PLACEHOLDERS = "END_OF_FILE <NA> N/A NULL TBD".split()


@dataclass(frozen=True)
class Config:
    """Thresholds; as_of stands for the present wherever a rule needs it, so results repeat."""

    as_of: str = "2024-06-30 00:00:00"
    reject_from: int = 4
    max_amount: float = 1e15
    years: tuple[int, int] = (1900, 2100)
    min_branch: int = 4
    null_density: float = 0.85
    retry_seconds: int = 300
    fuzzy_seconds: int = 86_400
    fuzzy_relative: float = 0.005
    fuzzy_cap: int = 2000
    abs_tolerance: float = 0.01
    pct_tolerance: float = 0.001
    match_hours: float = 72.0
    fx_tolerance: float = 0.02
    stale_days: int = 90
    null_identifier_token: str | None = None
    renames: dict = field(default_factory=lambda: dict(RENAMES))


def load(path: str | None = None, **changes) -> Config:
    """A Config with changes from a YAML file (if any) and from keywords."""
    found = {}
    if path:
        import yaml

        found = yaml.safe_load(Path(path).read_text()) or {}
    return replace(Config(), **{**found, **changes})
