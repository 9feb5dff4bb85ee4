"""SQL text of the test-table adapters, for the DuckDB oracle.

Each body is the relational twin of a method of
:class:`wardlens.sources.fixtures.Fixtures`.  :func:`with_fixtures` prepends
the bodies an oracle query needs as CTEs.
"""

from __future__ import annotations

import re

ROW_ID = ("concat_ws('-', cast(l_orderkey as varchar), cast(l_linenumber as varchar), "
          "cast(l_partkey as varchar), cast(cast(round(l_extendedprice * 100) as bigint) as varchar))")

BODIES: dict[str, str] = {
    "f_encounter": """
select o.o_orderkey as encounter_id, 'R' || cast(o.o_orderkey as varchar) as record_number,
  r.r_name as entity, o.o_orderpriority as patient_setting, cu.c_mktsegment as service_line,
  cast(o.o_orderdate as date) as discharge_date, cast(year(o.o_orderdate) as int) as fiscal_year,
  cast(o.o_custkey % 3 as int) as source_system_id, cast(o.o_custkey % 11 as int) as attend_physician_id,
  case when o.o_totalprice > 5000 then 'Yes' else 'No' end as has_charge,
  cast(o.o_custkey % 90 as int) as age, cast(o.o_orderkey % 15 as int) as los,
  case o.o_orderstatus when 'O' then 0 else 1 end as primary_qvi_id,
  lpad(cast(o.o_orderkey % 1000 as varchar), 3, '0') as msdrg_code,
  o.o_custkey as entity_key, cu.c_nationkey as orgpin, n.n_regionkey as stratum_id,
  cast(o.o_custkey % 2 as int) as gender_id, cast(o.o_orderkey % 60 as int) as apr_drg_id,
  cast(o.o_custkey % 90 // 10 as int) as age_cohort_id, cast(o.o_custkey % 90 // 10 as int) as age_rollup,
  'C' || lpad(cast(o.o_orderkey % 50 + 1 as varchar), 3, '0') as primary_cpt_code,
  'D' || cast(o.o_custkey % 300 as varchar) as primary_icd10dx_code
from orders o join customer cu on cu.c_custkey = o.o_custkey
  join nation n on n.n_nationkey = cu.c_nationkey join region r on r.r_regionkey = n.n_regionkey""",
    "f_line": f"""
select {ROW_ID} as row_id,
  l_orderkey as encounter_id, l_partkey as charge_code_id, l_suppkey as physician_id, p_size as cpt_id,
  cast(l_shipdate as date) as service_date, l_shipdate as service_ts, cast(year(l_shipdate) as int) as line_year,
  cast(l_quantity as decimal(18,2)) as units, l_linenumber as seq,
  cast(l_suppkey % 25 as int) as ub_revenue_code_id
from lineitem join part on p_partkey = l_partkey""",
    "f_cost": f"""
select {ROW_ID} as row_id, l_orderkey as encounter_id,
  case when l_tax = 0 then cast(0 as decimal(18,2)) else cast(p_retailprice as decimal(18,2)) end as unit_cost
from lineitem join part on p_partkey = l_partkey where l_discount > 0""",
    "f_charge_code": """
select p_partkey as charge_code_id, p_name as name, p_name || ' ' || p_brand as description, p_brand as rollup_name,
  case p_type when 'SMALL' then 'Excluded' else p_type end as cost_driver from part""",
    "f_ub_revenue_code": """
select cast(n_nationkey as int) as ub_revenue_code_id,
  case n_nationkey when 11 then 'Excluded' when 23 then 'excluded ' else r_name end as cost_driver
from nation join region on r_regionkey = n_regionkey""",
    "f_gender": """
select distinct cast(c_custkey % 2 as int) as gender_id, case c_custkey % 2 when 0 then 'Female' else 'Male' end as description
from customer""",
    "f_apr_drg": """
select distinct cast(o_orderkey % 60 as int) as apr_drg_id, cast(o_orderkey % 60 % 4 + 1 as int) as aprrom,
  cast(o_orderkey % 60 // 15 + 1 as int) as aprsoi from orders""",
    "f_age_cohort": """
select distinct cast(c_custkey % 90 // 10 as int) as age_cohort_id,
  cast(c_custkey % 90 // 10 * 10 as varchar) || '-' || cast(c_custkey % 90 // 10 * 10 + 9 as varchar) as name from customer""",
    "f_msdrg": """
select distinct lpad(cast(o_orderkey % 1000 as varchar), 3, '0') as msdrg_code,
  'Stay ' || lpad(cast(o_orderkey % 1000 as varchar), 3, '0')
    || case when o_orderkey % 1000 % 3 = 0 then ' with CC' else ' without CC' end as name from orders""",
    "f_icd10px": """
select 'PX' || cast(p_partkey % 500 as varchar) as code, max(p_name) as name from part group by p_partkey % 500""",
    "f_icd10dx": """
select 'D' || cast(c_custkey % 300 as varchar) as code, 'Disorder ' || max(c_mktsegment) as name
from customer group by c_custkey % 300""",
    "f_cpt": """
select distinct p_size as cpt_id, 'C' || lpad(cast(p_size as varchar), 3, '0') as cpt_code,
  'Procedure C' || lpad(cast(p_size as varchar), 3, '0') as cpt_name from part""",
    "f_physician": """
select s_suppkey as physician_id, s_name as full_name, s_nationkey as specialty_id, n_name as specialty
from supplier join nation on n_nationkey = s_nationkey""",
    "f_source_system": """
select distinct cast(c_custkey % 3 as int) as source_system_id,
  cast(case when c_custkey % 3 = 2 then 2 else 1 end as int) as category_id,
  case when c_custkey % 3 = 2 then 'Professional Billing' else 'Hospital Billing' end as category_name
from customer""",
    "f_qvi": """
select o_orderkey as encounter_id, case when o_orderkey % 2 = 0 then 'VAP' else 'FALL' end as qvi_name
from orders where o_orderstatus = 'F'""",
    "f_indicator": """
select o_orderkey as encounter_id, 'CI_A' as name from orders where o_orderkey % 3 = 0
union all select o_orderkey, 'CI_B' from orders where o_orderkey % 6 = 0""",
    "f_usage": """
select user_id as encounter_id, 'R' || cast(user_id as varchar) as record_number, event_type as cpt_code,
  cast(ts as date) as service_date, ts as service_ts, cast(1 + event_id % 2 as int) as uos,
  case when event_id % 97 = 0 then cast(0 as decimal(18,2)) else cast(value as decimal(18,2)) end as unit_cost,
  case when event_id % 97 = 0 then cast(0 as decimal(18,2))
       else cast((1 + event_id % 2) * cast(value as decimal(18,2)) as decimal(18,2)) end as vdc, event_id
from events""",
    "f_system_criteria": """
select n_nationkey as orgpin, n_regionkey as stratum_id, n_name as client, 'T' || cast(n_nationkey % 3 as varchar) as clienttype,
  r_name as censusregion, 'X' || cast(n_nationkey % 4 as varchar) as opex
from nation join region on r_regionkey = n_regionkey""",
    "f_entity_criteria": """
select c_nationkey as orgpin, n_regionkey as stratum_id, c_custkey as entity_key, c_name as alias, c_mktsegment as entitytype,
  'E' || cast(c_custkey % 5 as varchar) as censusregion,
  'X' || cast(c_custkey % 4 as varchar) as opex, cast(c_custkey % 2 as int) as isurban, cast(c_custkey % 5 as int) as isamc,
  case when c_acctbal < 0 then 'small' when c_acctbal < 5000 then 'medium' else 'large' end as bedsize
from customer join nation on n_nationkey = c_nationkey""",
    "f_pcs_map": """
select p_partkey % 500 as k, 'PX' || cast(p_partkey % 500 as varchar) as code, 'Medical' as labelone,
  min(p_type) as labeltwo, min(p_name) as labelfour
from part where (p_partkey % 500) % 7 <> 0 group by p_partkey % 500""",
    "f_procedure": """
select l_orderkey as encounter_id, 'PX' || cast(l_partkey % 500 as varchar) as px_code, l_linenumber as seq from lineitem""",
    "f_ctf_map": """
select distinct c_mktsegment as ctf, lpad(cast(o_orderkey % 1000 as varchar), 3, '0') as msdrg_code,
  'Z' || cast(o_orderkey % 1000 % 97 as varchar) as icd10_code,
  cast(1 + o_orderkey % 2 as int) as version_id
from orders join customer on c_custkey = o_custkey""",
    "f_ctf_cpt_map": """
select distinct cu.c_mktsegment as ctf, 'C' || lpad(cast(p.p_size as varchar), 3, '0') as cpt_code,
  cast(1 + p.p_size % 2 as int) as version_id
from lineitem l join part p on p.p_partkey = l.l_partkey join orders o on o.o_orderkey = l.l_orderkey
  join customer cu on cu.c_custkey = o.o_custkey""",
    "f_donor": """
select l_orderkey as donor_key, l_linenumber as donor_line,
  cast(10 + l_partkey % 70 as double) as age,
  cast(year(l_shipdate) as int) as tx_year,
  case when l_linestatus = 'O' then '' else cast(null as varchar) end as tx_hrt,
  case when l_partkey % 17 = 0 then 'Y' when l_partkey % 2 = 0 then '' else cast(null as varchar) end as tx_kid,
  case when l_suppkey % 19 = 0 then 'Y' else '' end as tx_lng,
  cast(null as varchar) as tx_int,
  case when l_orderkey % 29 = 0 then 'Y' else cast(null as varchar) end as tx_pan,
  case when l_suppkey % 23 = 0 then '2000-01-01' else cast(null as varchar) end as tx_retxdate,
  case l_returnflag when 'R' then 'Y' else 'N' end as prev_tx,
  case when l_orderkey % 31 = 0 then cast(null as varchar) else cast(cast(l_shipdate as date) as varchar) end as tx_date,
  cast(l_quantity + 10 as double) as age_don,
  case when l_linenumber = 7 then cast(null as double) else 15 + l_quantity / 2 end as bmi_don,
  case when l_linenumber = 1 then 'Y' else 'N' end as cdc_risk_hiv_don,
  cast(l_linenumber % 4 as int) as cod_cad_don,
  l_discount * 60 as creat_don,
  cast(l_partkey % 5 as int) as ethcat_don,
  case when l_partkey % 2 = 0 then 'F' else 'M' end as gender_don,
  case when l_suppkey % 3 = 0 then 'P' else 'N' end as hbv_core_don,
  case when l_suppkey % 4 = 0 then 'P' else 'N' end as hep_c_anti_don,
  140 + l_quantity as hgt_cm_don_calc,
  case when l_linenumber = 6 then cast(null as int) else l_linenumber % 3 + 1 end as hist_diabetes_don,
  case when l_partkey % 3 = 0 then 'Y' when l_partkey % 3 = 1 then 'N' else cast(null as varchar) end as hist_hypertens_don,
  l_extendedprice / 150 as sgot_don,
  l_extendedprice / 100 as sgpt_don,
  l_quantity / 4 as tbili_don,
  case when l_orderkey % 5 = 0 then 'Y' else 'N' end as controlled_don,
  cast(10 + l_partkey % 20 as int) as lityp,
  cast(l_suppkey % 5 + 1 as int) as share_ty,
  l_linestatus as gstatus
from lineitem""",
}

# f_billing and f_enc_drg build on other adapters.
BODIES["f_billing"] = """
select l.encounter_id as encounterid, e.orgpin, e.stratum_id, l.service_date as servicedate,
  cast(year(l.service_date) * 10000 + month(l.service_date) * 100 + day(l.service_date) as int) as servicedateid,
  l.cpt_id as billedcptid, c.cpt_code as billedcptcode, c.cpt_name as billedcptdescription,
  cc.cost_driver as chargecodecostdriver, l.units as totalunitsofservice,
  cast(l.units * k.unit_cost as decimal(38,4)) as variabledirectcost
from f_line l join f_encounter e on e.encounter_id = l.encounter_id
  join f_cpt c on c.cpt_id = l.cpt_id join f_charge_code cc on cc.charge_code_id = l.charge_code_id
  left join f_cost k on k.row_id = l.row_id"""

ORDER = ["f_ub_revenue_code", "f_gender", "f_apr_drg", "f_age_cohort", "f_msdrg", "f_icd10px", "f_icd10dx",
         "f_encounter", "f_line", "f_cost", "f_charge_code", "f_cpt", "f_physician", "f_source_system",
         "f_qvi", "f_indicator", "f_usage", "f_system_criteria", "f_entity_criteria", "f_pcs_map",
         "f_procedure", "f_ctf_map", "f_ctf_cpt_map", "f_donor", "f_billing"]

_DEPS = {"f_billing": ["f_line", "f_encounter", "f_cpt", "f_charge_code", "f_cost"]}


def with_fixtures(sql: str) -> str:
    """Prepend the adapter CTEs that ``sql`` references (and their inputs)."""
    used = {n for n in ORDER if re.search(rf"\b{n}\b", sql)}
    for n in list(used):
        used.update(_DEPS.get(n, []))
    ctes = [f"{n} AS ({BODIES[n]}\n)" for n in ORDER if n in used]
    body = sql.strip()
    if re.match(r"(?is)^with\s", body):
        body = re.sub(r"(?is)^with\s", "", body, count=1)
        return "WITH " + ",\n".join(ctes + [body]) if ctes else "WITH " + body
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body
