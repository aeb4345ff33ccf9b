"""Dataset registry (S-07): staging schemas, keys and junk columns.

Schemas follow the reference's staging model classes.  Type mapping:
CharField -> string, IntegerField/SmallIntegerField -> int,
BigIntegerField/foreign key -> bigint, FloatField -> double.
Four text attributes that the reference types as float (and so loses) are
declared as strings here (SURVEY D11).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import StructField, StructType, _parse_datatype_string


def _cols(text: str) -> list[tuple[str, str]]:
    out = []
    for item in text.replace("\n", " ").split(","):
        item = item.strip()
        if item:
            name, typ = item.split()
            out.append((name, typ))
    return out


# ---- fixed values: building / social attribute names of the application file ----
BUILDING_BASES = (
    "apartments", "basementarea", "years_beginexpluatation", "years_build",
    "commonarea", "elevators", "entrances", "floorsmax", "floorsmin", "landarea",
    "livingapartments", "livingarea", "nonlivingapartments", "nonlivingarea",
)
BUILDING_SUFFIXES = ("avg", "mode", "medi")
BUILDING_TEXT_MODES = ("fondkapremont_mode", "housetype_mode", "totalarea_mode",
                       "wallsmaterial_mode", "emergencystate_mode")
SOCIAL_CIRCLE = ("obs_30_cnt_social_circle", "def_30_cnt_social_circle",
                 "obs_60_cnt_social_circle", "def_60_cnt_social_circle")

# Keys of the building/social JSON pack, in the reference's order: every
# base x suffix (suffix-major), then the five "_mode" extras, then social circle.
BUILDING_SOCIAL_KEYS = tuple(
    [f"{b}_{s}" for s in BUILDING_SUFFIXES for b in BUILDING_BASES]
    + list(BUILDING_TEXT_MODES) + list(SOCIAL_CIRCLE)
)
DOCUMENT_FLAGS = tuple(f"flag_document_{i}" for i in range(2, 22))

_APP_HEAD = _cols("""
sk_id_curr bigint, target int, name_contract_type string, code_gender string,
flag_own_car string, flag_own_realty string, cnt_children int, amt_income_total double,
amt_credit double, amt_annuity double, amt_goods_price double, name_type_suite string,
name_income_type string, name_education_type string, name_family_status string,
name_housing_type string, region_population_relative double, days_birth int,
days_employed double, days_registration double, days_id_publish int, own_car_age double,
flag_mobil int, flag_emp_phone int, flag_work_phone int, flag_cont_mobile int,
flag_phone int, flag_email int, occupation_type string, cnt_fam_members double,
region_rating_client int, region_rating_client_w_city int,
weekday_appr_process_start string, hour_appr_process_start double,
reg_region_not_live_region int, reg_region_not_work_region int,
live_region_not_work_region int, reg_city_not_live_city int, reg_city_not_work_city int,
live_city_not_work_city int, organization_type string, ext_source_1 double,
ext_source_2 double, ext_source_3 double""")
_TEXT_MODES = {"fondkapremont_mode", "housetype_mode", "wallsmaterial_mode", "emergencystate_mode"}
_APP_BUILDING = [(k, "string" if k in _TEXT_MODES else "double") for k in BUILDING_SOCIAL_KEYS]
_APP_TAIL = ([("days_last_phone_change", "double")]
             + [(d, "int") for d in DOCUMENT_FLAGS]
             + _cols("""amt_req_credit_bureau_hour double, amt_req_credit_bureau_day double,
amt_req_credit_bureau_week double, amt_req_credit_bureau_mon double,
amt_req_credit_bureau_qrt double, amt_req_credit_bureau_year double"""))


@dataclass(frozen=True)
class DatasetSpec:
    key: str
    filename: str
    table: str
    columns: tuple[tuple[str, str], ...]
    keys: tuple[str, ...]
    junk: tuple[str, ...] = field(default=())

    @property
    def data_columns(self) -> list[str]:
        return [c for c, _ in self.columns if c not in self.junk]

    def struct(self, include_junk: bool = True) -> StructType:
        return StructType([
            StructField(c, _parse_datatype_string(t), True)
            for c, t in self.columns if include_junk or c not in self.junk
        ])

    def types(self) -> dict[str, str]:
        return dict(self.columns)


_APP_TRAIN = tuple(_APP_HEAD + _APP_BUILDING + _APP_TAIL
                   + [("legacy_amt_income_text", "string"), ("internal_sync_token", "string")])
_APP_TEST = tuple([c for c in _APP_HEAD + _APP_BUILDING + _APP_TAIL if c[0] != "target"]
                  + [("export_batch_label", "string")])

DATASETS: dict[str, DatasetSpec] = {
    "application_train": DatasetSpec(
        "application_train", "application_train.csv", "src_application_train",
        _APP_TRAIN, ("sk_id_curr",), ("legacy_amt_income_text", "internal_sync_token")),
    "application_test": DatasetSpec(
        "application_test", "application_test.csv", "src_application_test",
        _APP_TEST, ("sk_id_curr",), ("export_batch_label",)),
    "bureau": DatasetSpec(
        "bureau", "bureau.csv", "src_bureau", tuple(_cols("""
sk_id_bureau bigint, sk_id_curr bigint, credit_active string, credit_currency string,
days_credit int, credit_day_overdue int, days_credit_enddate double, days_enddate_fact double,
amt_credit_max_overdue double, cnt_credit_prolong int, amt_credit_sum double,
amt_credit_sum_debt double, amt_credit_sum_limit double, amt_credit_sum_overdue double,
credit_type string, days_credit_update int, amt_annuity double, old_sys_bureau_ref string""")),
        ("sk_id_bureau",), ("old_sys_bureau_ref",)),
    "bureau_balance": DatasetSpec(
        "bureau_balance", "bureau_balance.csv", "src_bureau_balance", tuple(_cols("""
sk_id_bureau bigint, months_balance int, status string, raw_status_dump string""")),
        ("sk_id_bureau", "months_balance"), ("raw_status_dump",)),
    "previous_application": DatasetSpec(
        "previous_application", "previous_application.csv", "src_previous_application",
        tuple(_cols("""
sk_id_prev bigint, sk_id_curr bigint, name_contract_type string, amt_annuity double,
amt_application double, amt_credit double, amt_down_payment double, amt_goods_price double,
weekday_appr_process_start string, hour_appr_process_start double,
flag_last_appl_per_contract string, nflag_last_appl_in_day int, rate_down_payment double,
rate_interest_primary double, rate_interest_privileged double, name_cash_loan_purpose string,
name_contract_status string, days_decision int, name_payment_type string,
code_reject_reason string, name_type_suite string, name_client_type string,
name_goods_category string, name_portfolio string, name_product_type string,
channel_type string, sellerplace_area int, name_seller_industry string, cnt_payment double,
name_yield_group string, product_combination string, days_first_drawing double,
days_first_due double, days_last_due_1st_version double, days_last_due double,
days_termination double, nflag_insured_on_approval int""")),
        ("sk_id_prev",)),
    "installments_payments": DatasetSpec(
        "installments_payments", "installments_payments.csv", "src_installments_payments",
        tuple(_cols("""
sk_id_prev bigint, num_instalment_version int, num_instalment_number int,
days_instalment int, days_entry_payment double, amt_instalment double, amt_payment double,
source_file_row_no double""")),
        ("sk_id_prev", "num_instalment_version", "num_instalment_number"),
        ("source_file_row_no",)),
    "credit_card_balance": DatasetSpec(
        "credit_card_balance", "credit_card_balance.csv", "src_credit_card_balance",
        tuple(_cols("""
sk_id_prev bigint, sk_id_curr bigint, months_balance int, amt_balance double,
amt_credit_limit_actual double, amt_drawings_atm_current double, amt_drawings_current double,
amt_drawings_other_current double, amt_drawings_pos_current double,
amt_inst_min_regularity double, amt_payment_current double, amt_payment_total_current double,
amt_receivable_principal double, amt_recivable double, amt_total_receivable double,
cnt_drawings_atm_current double, cnt_drawings_current double, cnt_drawings_other_current double,
cnt_drawings_pos_current double, cnt_instalment_mature_cum double,
name_contract_status string, sk_dpd int, sk_dpd_def int""")),
        ("sk_id_prev", "months_balance")),
    "pos_cash_balance": DatasetSpec(
        "pos_cash_balance", "POS_CASH_balance.csv", "src_pos_cash_balance", tuple(_cols("""
sk_id_prev bigint, sk_id_curr bigint, months_balance int, cnt_instalment double,
cnt_instalment_future double, name_contract_status string, sk_dpd int, sk_dpd_def int,
abs_operator_note string""")),
        ("sk_id_prev", "months_balance"), ("abs_operator_note",)),
}

# staging adapter name (sources.fixtures) -> dataset key
ADAPTER_DATASET = {
    "stg_application": "application_train",
    "stg_bureau": "bureau",
    "stg_bureau_balance": "bureau_balance",
    "stg_previous_application": "previous_application",
    "stg_installments_payments": "installments_payments",
    "stg_credit_card_balance": "credit_card_balance",
    "stg_pos_cash_balance": "pos_cash_balance",
}


def supported_datasets() -> list[str]:
    return list(DATASETS)


def get_dataset_spec(key: str) -> DatasetSpec:
    if key not in DATASETS:
        raise KeyError(f"unknown dataset: {key}")
    return DATASETS[key]


# Foreign keys of each dataset: read as integer text when numeric, raw text otherwise (P-05).
FOREIGN_KEYS = {
    "bureau": ("sk_id_curr",),
    "bureau_balance": ("sk_id_bureau",),
    "previous_application": ("sk_id_curr",),
    "installments_payments": ("sk_id_prev",),
    "credit_card_balance": ("sk_id_prev", "sk_id_curr"),
    "pos_cash_balance": ("sk_id_prev", "sk_id_curr"),
}


def staging_types() -> dict[str, str]:
    """Declared staging type of every column name (names mean the same thing
    in every dataset, so the first declaration is taken)."""
    out: dict[str, str] = {}
    for spec in DATASETS.values():
        for c, t in spec.columns:
            out.setdefault(c, t)
    return out
