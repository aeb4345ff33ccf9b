"""Targets of the credit Data Vault, one spec each (C-01 .. C-05).

Fixed values below (table names, column lists, hashdiff inputs, record
sources, vault column types) follow the reference's vault DDL and loader.
Targets with DDL but no loader in the reference (previous application,
instalments, card, POS) get the same generic treatment; their hashdiff
inputs are our choice and marked so.
"""

from __future__ import annotations

from ..operators.vault import HubSpec, KeyRef, LinkSpec, SatSpec
from ..schemas import BUILDING_SOCIAL_KEYS, DOCUMENT_FLAGS, DATASETS

# ---- fixed values: record sources ----
RS_APP = "etl:postgres:application_train"
RS_BUREAU = "etl:postgres:bureau"
RS_BUREAU_BAL = "etl:postgres:bureau_balance"
RS_PREV = "kaggle:previous_application"
RS_INST = "kaggle:installments_payments"
RS_CARD = "kaggle:credit_card_balance"
RS_POS = "kaggle:POS_CASH_balance"

APP = KeyRef("hk_application", "application", ("sk_id_curr",))
BUREAU = KeyRef("hk_bureau_credit", "bureau", ("sk_id_bureau",))
PREV = KeyRef("hk_prev_application", "prev_application", ("sk_id_prev",))


def _same(*pairs: str) -> tuple[tuple[str, str, str], ...]:
    """'name type' strings -> (name, type, staging column = name)."""
    out = []
    for p in pairs:
        n, t = p.split()
        out.append((n, t, n))
    return tuple(out)


D18_2, D12_2, D12_6, D8_2 = "decimal(18,2)", "decimal(12,2)", "decimal(12,6)", "decimal(8,2)"

HUB_APPLICATION = HubSpec("dv_hub_application", APP, RS_APP)
HUB_BUREAU = HubSpec("dv_hub_bureau_credit", BUREAU, RS_BUREAU)
HUB_PREV = HubSpec("dv_hub_prev_application", PREV, RS_PREV)

LINK_APP_BUREAU = LinkSpec("dv_link_application_bureau", "hk_link_application_bureau",
                           "link_app_bureau", ("sk_id_curr", "sk_id_bureau"), (APP, BUREAU), RS_BUREAU)
LINK_APP_PREV = LinkSpec("dv_link_application_prev_application", "hk_link_application_prev_application",
                         "link_app_prev", ("sk_id_curr", "sk_id_prev"), (APP, PREV), RS_PREV)

SAT_CONTRACT = SatSpec(
    "dv_sat_app_contract", APP,
    _same(f"name_contract_type string", f"amt_credit {D18_2}", f"amt_annuity {D18_2}",
          f"amt_goods_price {D18_2}", f"amt_income_total {D18_2}"),
    hashdiff=("name_contract_type", "amt_credit", "amt_annuity", "amt_goods_price", "amt_income_total"),
    record_source=RS_APP)
SAT_PROFILE = SatSpec(
    "dv_sat_app_client_profile", APP,
    _same("code_gender string", "cnt_children int", f"cnt_fam_members {D8_2}",
          "name_type_suite string", "name_income_type string", "name_education_type string",
          "name_family_status string", "name_housing_type string", "days_birth int",
          f"days_employed {D12_2}", f"days_registration {D12_2}", "days_id_publish int",
          "occupation_type string", "organization_type string", f"own_car_age {D8_2}",
          "flag_own_car string", "flag_own_realty string"),
    hashdiff=("code_gender", "cnt_children", "days_birth"), record_source=RS_APP)
SAT_PROCESS = SatSpec(
    "dv_sat_app_process", APP,
    _same("weekday_appr_process_start string", f"hour_appr_process_start {D8_2}",
          "region_population_relative decimal(12,6)", "region_rating_client int",
          "region_rating_client_w_city int", "reg_region_not_live_region int",
          "reg_region_not_work_region int", "live_region_not_work_region int",
          "reg_city_not_live_city int", "reg_city_not_work_city int", "live_city_not_work_city int"),
    hashdiff=("region_rating_client", "hour_appr_process_start"), record_source=RS_APP)
SAT_CONTACT = SatSpec(
    "dv_sat_app_contact_flags", APP,
    _same("flag_mobil int", "flag_emp_phone int", "flag_work_phone int", "flag_cont_mobile int",
          "flag_phone int", "flag_email int", "days_last_phone_change int"),
    hashdiff=("flag_mobil", "flag_email"), record_source=RS_APP)
SAT_SCORES = SatSpec(
    "dv_sat_app_external_scores", APP,
    _same(f"ext_source_1 {D12_6}", f"ext_source_2 {D12_6}", f"ext_source_3 {D12_6}"),
    hashdiff=("ext_source_1", "ext_source_2", "ext_source_3"), record_source=RS_APP)
SAT_ENQUIRIES = SatSpec(
    "dv_sat_app_credit_bureau_enquiries", APP,
    _same(*[f"amt_req_credit_bureau_{p} {D8_2}" for p in ("hour", "day", "week", "mon", "qrt", "year")]),
    hashdiff=("amt_req_credit_bureau_hour", "amt_req_credit_bureau_year"), record_source=RS_APP)
SAT_DOCUMENTS = SatSpec(
    "dv_sat_app_documents", APP, (), packs=(("document_flags", DOCUMENT_FLAGS),),
    hashdiff_pack="document_flags", record_source=RS_APP)
SAT_BUILDING = SatSpec(
    "dv_sat_app_building_social", APP, (), packs=(("building_social_attrs", BUILDING_SOCIAL_KEYS),),
    hashdiff_pack="building_social_attrs", record_source=RS_APP)
SAT_TARGET = SatSpec(
    "dv_sat_app_target", APP, _same("target int"), hashdiff=("target",),
    where="target IS NOT NULL", record_source=RS_APP)

SAT_BUREAU = SatSpec(
    "dv_sat_bureau_credit", BUREAU,
    _same("credit_active string", "credit_currency string", "days_credit int",
          "credit_day_overdue int", f"days_credit_enddate {D12_2}", f"days_enddate_fact {D12_2}",
          f"amt_credit_max_overdue {D18_2}", "cnt_credit_prolong int", f"amt_credit_sum {D18_2}",
          f"amt_credit_sum_debt {D18_2}", f"amt_credit_sum_limit {D18_2}",
          f"amt_credit_sum_overdue {D18_2}", "credit_type string", "days_credit_update int",
          f"amt_annuity {D18_2}"),
    hashdiff=("credit_active", "amt_credit_sum"), record_source=RS_BUREAU)
SAT_BUREAU_BALANCE = SatSpec(
    "dv_sat_bureau_balance", BUREAU, _same("status string"), hashdiff=("status",),
    subkeys=(("months_balance", "int"),), hashdiff_subkeys=True, record_source=RS_BUREAU_BAL)

_PREV_COLS = _same(
    "name_contract_type string", f"amt_annuity {D18_2}", f"amt_application {D18_2}",
    f"amt_credit {D18_2}", f"amt_down_payment {D18_2}", f"amt_goods_price {D18_2}",
    "name_contract_status string", "days_decision int", "name_payment_type string",
    "code_reject_reason string", "name_client_type string", "name_portfolio string",
    "name_product_type string", "channel_type string", f"cnt_payment {D12_2}",
    "name_yield_group string")


def _rest(dataset: str, taken: set[str]) -> tuple[str, ...]:
    return tuple(c for c in DATASETS[dataset].data_columns if c not in taken)


# hashdiff inputs of the four DDL-only satellites: our choice (no reference loader)
SAT_PREV = SatSpec(
    "dv_sat_prev_application", PREV, _PREV_COLS,
    hashdiff=("name_contract_status", "amt_application", "amt_credit"),
    packs=(("prev_application_attrs",
            _rest("previous_application", {n for n, _, _ in _PREV_COLS} | {"sk_id_prev", "sk_id_curr"})),),
    record_source=RS_PREV)
SAT_INSTALLMENT = SatSpec(
    "dv_sat_installment_payment", PREV,
    _same("days_instalment int", f"days_entry_payment {D12_2}", f"amt_instalment {D18_2}",
          f"amt_payment {D18_2}"),
    hashdiff=("amt_instalment", "amt_payment"),
    subkeys=(("num_instalment_version", "int"), ("num_instalment_number", "int")),
    record_source=RS_INST)
SAT_CARD = SatSpec(
    "dv_sat_credit_card_balance", PREV,
    ((f"balance", D18_2, "amt_balance"), ("balance_limit", D18_2, "amt_credit_limit_actual"),
     ("sk_dpd_def", "int", "sk_dpd_def"), ("sk_dpd", "int", "sk_dpd")),
    hashdiff=("amt_balance", "amt_credit_limit_actual", "sk_dpd"),
    subkeys=(("months_balance", "int"),),
    packs=(("card_balance_attrs",
            _rest("credit_card_balance", {"sk_id_prev", "sk_id_curr", "months_balance", "amt_balance",
                                          "amt_credit_limit_actual", "sk_dpd_def", "sk_dpd"})),),
    record_source=RS_CARD)
SAT_POS = SatSpec(
    "dv_sat_pos_cash_balance", PREV,
    _same(f"cnt_instalment {D12_2}", f"cnt_instalment_future {D12_2}", "name_contract_status string",
          "sk_dpd_def int", "sk_dpd int"),
    hashdiff=("cnt_instalment", "name_contract_status", "sk_dpd"),
    subkeys=(("months_balance", "int"),),
    packs=(("pos_cash_attrs", ()),),
    record_source=RS_POS)

APPLICATION_SATS = (SAT_CONTRACT, SAT_PROFILE, SAT_PROCESS, SAT_CONTACT, SAT_SCORES,
                    SAT_ENQUIRIES, SAT_DOCUMENTS, SAT_BUILDING, SAT_TARGET)


# ---- CRM vault (C-07) and score / explanation satellites (C-06) ----
# DDL only in the reference; hash prefixes and hashdiff inputs are our choice.
# The CRM application hub is a separate table from the credit-file hub (D12).
RS_WEBAPP = "webapp"
RS_ML = "mlservice"
RS_AGENT = "agentservice"

CRM_CLIENT = KeyRef("hk_client", "client", ("client_id",))
CRM_APP = KeyRef("hk_application", "crm_application", ("application_id",))
HUB_CRM_CLIENT = HubSpec("crm_hub_client", CRM_CLIENT, RS_WEBAPP)
HUB_CRM_APPLICATION = HubSpec("crm_hub_application", CRM_APP, RS_WEBAPP)
LINK_CRM = LinkSpec("crm_link_client_application", "hk_link_client_application", "link_client_app",
                    ("client_id", "application_id"), (CRM_CLIENT, CRM_APP), RS_WEBAPP)
SAT_CRM_CLIENT = SatSpec(
    "crm_sat_client_profile", CRM_CLIENT,
    _same("education string", "sex string", "age int", "car boolean", "car_type boolean",
          "income decimal(12,2)", "foreign_passport boolean"),
    hashdiff=("education", "sex", "age", "car", "car_type", "income", "foreign_passport"), record_source=RS_WEBAPP)
SAT_CRM_FINANCIAL = SatSpec(
    "crm_sat_financial_profile", CRM_CLIENT,
    _same("decline_app_cnt int", "good_work boolean", "bki_request_cnt int", "region_rating decimal(5,2)"),
    hashdiff=("decline_app_cnt", "good_work", "bki_request_cnt"), record_source=RS_WEBAPP)
SAT_CRM_BEHAVIOR = SatSpec(
    "crm_sat_behavioral_context", CRM_CLIENT,
    _same("home_address string", "work_address string", "sna string", "first_time boolean"),
    hashdiff=("home_address", "first_time"), record_source=RS_WEBAPP)
SAT_CRM_APP = SatSpec(
    "crm_sat_application_details", CRM_APP, _same("app_date date"),
    packs=(("features", ("req_income", "debt_to_income")),),
    hashdiff=("app_date", "req_income", "debt_to_income"), record_source=RS_WEBAPP)
SAT_SCORING = SatSpec(
    "dv_sat_scoring_result", CRM_APP,
    _same("default_probability decimal(8,6)", "model_version string", "confidence decimal(8,6)"),
    packs=(("scoring_payload", ("default_probability", "model_version", "confidence")),),
    hashdiff=("default_probability", "model_version", "confidence"), record_source=RS_ML)
SAT_EXPLANATION = SatSpec(
    "dv_sat_agent_explanation", CRM_APP, _same("mode string"),
    packs=(("explanation_payload", ("decision", "confidence", "mode")),),
    hashdiff_pack="explanation_payload", record_source=RS_AGENT)
