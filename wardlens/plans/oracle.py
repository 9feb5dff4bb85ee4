"""DuckDB oracle SQL for every registered query.

Written over the adapter CTEs of :mod:`wardlens.plans.fixture_sql`; bins,
DRG ranges and flags share their constants with the operators.  Money stays DECIMAL, counts BIGINT,
rounded ratios go through :func:`sql_ratio` (exact integer rounding).
"""

from __future__ import annotations

from wardlens.functions.bins import COMPAT_SUBSTRINGS, DONOR_AGE_COMPAT, DONOR_BINS, DONOR_BMI, sql_bin_label
from wardlens.functions.drg import sql_mdc_group
from wardlens.functions.exact import sql_int_avg, sql_ratio
from wardlens.operators.cohort import DONOR_FLAGS, FEATURES, POPULATED_COLUMNS
from wardlens.plans.fixture_sql import with_fixtures

ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = with_fixtures(sql)


# ----------------------------------------------------------- opportunity
OPP_CODES = """
select charge_code_id, name as full_description, cost_driver, rollup_name
from f_charge_code where (name ilike '%widget%' or name ilike '%bolt%') and cost_driver = 'PROMO'"""
oracle("opp_codes", OPP_CODES)

OPP_SUMMARY = f"""
select l.line_year as fiscal_year, c.full_description, l.encounter_id,
  cast(sum(l.units) as decimal(38,2)) as uos, cast(sum(l.units * k.unit_cost) as decimal(38,4)) as vdc
from f_line l join ({OPP_CODES}) c on c.charge_code_id = l.charge_code_id
  left join f_cost k on k.row_id = l.row_id
where l.line_year in (1996, 1997)
group by l.line_year, c.full_description, l.encounter_id"""
oracle("opp_summary", OPP_SUMMARY)

oracle("opp_rollup", f"""
select cast(fiscal_year as int) as fiscalyear, 'Widget and bolt review' as opportunity_name,
  'reduction' as opportunity_type, 'PROMO' as category, full_description as additional_info,
  cast(count(distinct encounter_id) as int) as total_cases,
  cast(sum(uos) as decimal(20,2)) as total_uos, cast(sum(vdc) as decimal(20,2)) as total_vdc
from ({OPP_SUMMARY}) s group by fiscal_year, full_description""")

OPP_SPECS_SQL = """(values ('Widget reduction', 'reduction', 'PROMO', 'widget'),
  ('Fastener substitution', 'substitution', 'ECONOMY', 'bolt'),
  ('Fastener substitution', 'substitution', 'ECONOMY', 'gear'),
  ('Ring review', 'reduction', 'PROMO', 'ring'),
  ('Ring review', 'reduction', 'PROMO', 'red')) as sp(spec_name, spec_type, category, keyword)"""


def _opp_multi(specs_sql: str, years: str) -> str:
    return f"""
select cast(fiscal_year as int) as fiscalyear, spec_name as opportunity_name, spec_type as opportunity_type,
  category, full_description as additional_info, cast(count(distinct encounter_id) as int) as total_cases,
  cast(sum(uos) as decimal(20,2)) as total_uos, cast(sum(vdc) as decimal(20,2)) as total_vdc
from (
  select p.spec_name, p.spec_type, p.category, l.line_year as fiscal_year, p.full_description, l.encounter_id,
    sum(l.units) as uos, sum(l.units * k.unit_cost) as vdc
  from f_line l
    join (select distinct cc.charge_code_id, cc.name as full_description, sp.spec_name, sp.spec_type, sp.category
          from f_charge_code cc join {specs_sql} on cc.cost_driver = sp.category
          where cc.name ilike '%' || sp.keyword || '%') p on p.charge_code_id = l.charge_code_id
    left join f_cost k on k.row_id = l.row_id
  where l.line_year in ({years})
  group by all) s
group by fiscal_year, spec_name, spec_type, category, full_description"""


oracle("opp_multi", _opp_multi(OPP_SPECS_SQL, "1996, 1997"))
oracle("opp_replace", f"""
select * from ({_opp_multi(OPP_SPECS_SQL, "1996, 1997")}) r where opportunity_name <> 'Widget reduction'
union all
select * from ({_opp_multi("(values ('Widget reduction', 'reduction', 'PROMO', 'widget')) as sp(spec_name, spec_type, category, keyword)", "1996")}) n""")

oracle("opp_replace_on_disk", f"""
select * from ({_opp_multi("(values ('Widget reduction', 'reduction', 'PROMO', 'widget')) as sp(spec_name, spec_type, category, keyword)", "1996")}) r
union all
select * from ({_opp_multi("(values ('Ring review', 'reduction', 'PROMO', 'ring'), ('Ring review', 'reduction', 'PROMO', 'red')) as sp(spec_name, spec_type, category, keyword)", "1997")}) n""")

DICTIONARY = """
select distinct rollup_name as spec_name, 'dictionary' as spec_type, cost_driver as category,
  upper(substring(description, 3, length(description) - 3)) as keyword
from f_charge_code
union all
select s.spec_name, 'short', d.cost_driver, s.keyword
from (select distinct cost_driver from f_charge_code) d,
  (values ('Two letters', 'OT'), ('Two letters', '#7'), ('Wildcards', 'b_lt%#1'), ('Wildcards', 'r%g'), ('No such text', 'qqq')) as s(spec_name, keyword)"""
DICTIONARY_CODES = f"""
select distinct cc.charge_code_id, cc.description as full_description, k.spec_name, k.spec_type, k.category
from f_charge_code cc join ({DICTIONARY}) k on cc.cost_driver = k.category
where cc.description ilike '%' || k.keyword || '%'"""
oracle("opp_codes_dictionary", DICTIONARY_CODES)
oracle("opp_multi_dictionary", f"""
select cast(fiscal_year as int) as fiscalyear, spec_name as opportunity_name, spec_type as opportunity_type,
  category, full_description as additional_info, cast(count(distinct encounter_id) as int) as total_cases,
  cast(sum(uos) as decimal(20,2)) as total_uos, cast(sum(vdc) as decimal(20,2)) as total_vdc
from (
  select p.spec_name, p.spec_type, p.category, l.line_year as fiscal_year, p.full_description, l.encounter_id,
    sum(l.units) as uos, sum(l.units * k.unit_cost) as vdc
  from f_line l join ({DICTIONARY_CODES}) p on p.charge_code_id = l.charge_code_id
    left join f_cost k on k.row_id = l.row_id
  where l.line_year in (1996, 1997)
  group by all) s
group by fiscal_year, spec_name, spec_type, category, full_description""")
oracle("collated_units", """
select lower(cost_driver) as cost_driver, lower(name) as name, cast(sum(l.units) as decimal(38,2)) as uos, count(*) as n_lines
from f_line l join f_charge_code c on c.charge_code_id = l.charge_code_id
where lower(name) in ('red widget', 'blue bolt', 'hot gear')
group by all""")


# ------------------------------------------------------------ redundancy
oracle("ctf_map", """
select c.ctf, m.msdrg_code, m.icd10_code, cast(null as varchar) as cpt_code
from (select distinct c_mktsegment as ctf from customer) c
  left join f_ctf_map m on m.ctf = c.ctf and m.version_id = 2
union all
select c.ctf, cast(null as varchar), cast(null as varchar), m.cpt_code
from (select distinct c_mktsegment as ctf from customer) c
  left join f_ctf_cpt_map m on m.ctf = c.ctf and m.version_id = 2""")

oracle("src_filter", "select distinct source_system_id from f_source_system where category_id = 1")

oracle("enc_usage", """
select e.encounter_id, e.record_number, e.service_line, e.patient_setting, e.entity, l.service_date, l.service_ts,
  md.full_name as ordering_md_name, md.specialty as ordering_md_spec, c.cpt_code, c.cpt_name as cpt_description,
  k.unit_cost, cast(sum(l.units) as decimal(38,2)) as uos, cast(sum(l.units * k.unit_cost) as decimal(38,4)) as vdc
from f_encounter e
  join f_line l on l.encounter_id = e.encounter_id
  left join f_cost k on k.row_id = l.row_id
  join f_charge_code cc on cc.charge_code_id = l.charge_code_id
  join f_cpt c on c.cpt_id = l.cpt_id
  join f_physician md on md.physician_id = l.physician_id
where c.cpt_code in ('C007', 'C011', 'C023') and e.fiscal_year = 1996
  and cc.cost_driver in ('PROMO', 'ECONOMY', 'STANDARD')
  and e.patient_setting in ('1-URGENT', '2-HIGH', '3-MEDIUM')
  and e.source_system_id in (select source_system_id from f_source_system where category_id = 1)
group by all""")

USAGE_CLEAN = """
select * from f_usage where encounter_id not in (select encounter_id from f_usage where uos <= 0 or vdc <= 0)"""
oracle("enc_clean", USAGE_CLEAN)

RANKED = f"""
select u.*, case cpt_code when 'purchase' then 'A' when 'click' then 'B' else 'NA' end as cc_rank
from ({USAGE_CLEAN}) u"""
oracle("code_rank", RANKED)

USAGE_ORDER = "service_date, cc_rank, service_ts, cpt_code, unit_cost, event_id"
oracle("row_index", f"""
select r.*, cast(row_number() over (partition by encounter_id order by {USAGE_ORDER}) as bigint) as row_num
from ({RANKED}) r""")
oracle("row_index_whole_table", f"""
select r.*, cast(row_number() over (order by encounter_id, {USAGE_ORDER}) as bigint) as row_num
from ({RANKED}) r""")

ADJ_ALL = f"""
select r.*,
  case when lag(service_date) over w = service_date then 'same day' else 'NA' end as same_day,
  cast(coalesce(date_diff('day', lag(service_date) over w, service_date), 99999) as int) as date_diff
from ({RANKED}) r
window w as (partition by encounter_id order by {USAGE_ORDER})"""
oracle("adjacent_rows", f"select * from ({ADJ_ALL}) a where service_ts is not null")

SAME_DAY = f"""
select a.*,
  cast(case when same_day = 'same day' then vdc when same_day = 'NA' and uos > 1 then (uos - 1) * unit_cost
       else 0 end as decimal(38,4)) as same_day_excess_vdc,
  case when same_day = 'same day' then uos else uos - 1 end as same_day_excess_uos
from ({ADJ_ALL}) a
where service_ts is not null and record_number in
  (select record_number from ({ADJ_ALL}) x where same_day = 'same day' or (same_day = 'NA' and uos > 1))"""
oracle("same_day_excess", SAME_DAY)

NEXT_DAY = f"""
select a.*,
  cast(case when date_diff = 1 then unit_cost else 0 end as decimal(38,4)) as subseq_day_excess_vdc,
  case when date_diff = 1 then 1 else 0 end as subseq_day_excess_uos
from ({ADJ_ALL}) a
where service_ts is not null and record_number in (select record_number from ({ADJ_ALL}) x where date_diff = 1)"""
oracle("next_day_excess", NEXT_DAY)

oracle("savings", f"""
with sd as (select sum(same_day_excess_uos) u, sum(same_day_excess_vdc) v from ({SAME_DAY}) s),
     nd as (select sum(subseq_day_excess_uos) u, sum(subseq_day_excess_vdc) v from ({NEXT_DAY}) n)
select cast(2024 as int) as fiscalyear, cast(sd.u as int) as same_day_excess_tests,
  cast(sd.v as double) as same_day_excess_vdc, cast(nd.u as int) as consecutive_daily_tests,
  cast(nd.v as double) as consecutive_daily_vdc, cast(sd.u + nd.u as int) as total_excess_tests,
  cast(sd.v + nd.v as double) as total_excess_vdc, cast(sd.v * 0.75 as double) as same_day_savings_75,
  cast(nd.v * 0.5 as double) as consecutive_daily_savings_50,
  cast(sd.v * 0.75 + nd.v * 0.5 as double) as total_savings
from sd, nd""")


# ------------------------------------------------------- entity compare
ENT_ENC = """
select e.encounter_id, e.record_number, e.entity, e.patient_setting, e.service_line,
  md.full_name as primary_md, md.specialty as primary_md_spec
from f_encounter e join f_physician md on md.physician_id = e.attend_physician_id
where e.fiscal_year in (1996) and e.has_charge = 'Yes'
  and e.source_system_id in (select source_system_id from f_source_system where category_id = 1)"""
oracle("ent_enc", ENT_ENC)

oracle("service_line", f"""
select e.encounter_id, n.n_name as service_line
from ({ENT_ENC}) e join f_encounter fe on fe.encounter_id = e.encounter_id
  join nation n on n.n_nationkey = fe.orgpin""")

ENT_BILL = f"""
select e.*, cc.cost_driver, cc.rollup_name as cc_rollup, cc.name as full_charge_code_description,
  cast(sum(l.units) as decimal(38,2)) as uos, cast(sum(l.units * k.unit_cost) as decimal(38,4)) as vdc
from ({ENT_ENC}) e join f_line l on l.encounter_id = e.encounter_id
  join f_cost k on k.row_id = l.row_id
  join f_charge_code cc on cc.charge_code_id = l.charge_code_id
where cc.cost_driver not in ('Excluded', '')
group by all"""
oracle("ent_bill", ENT_BILL)
oracle("ent_bill_co_located", ENT_BILL)

ENT_BILL_ENC = f"""
select encounter_id, entity, patient_setting, service_line, sum(vdc) as vdc
from ({ENT_BILL}) b group by encounter_id, entity, patient_setting, service_line"""
oracle("ent_bill_enc", ENT_BILL_ENC)


def _worklist(sql_filter: str = "") -> str:
    return f"""
select entity, patient_setting, service_line, count(distinct encounter_id) as cases, sum(vdc) as vdc
from ({ENT_BILL_ENC}) be group by entity, patient_setting, service_line
having sum(vdc) > 10000
order by vdc desc, cases desc, entity, patient_setting, service_line limit 100"""


ENT_WORKLIST = _worklist()
oracle("ent_worklist", ENT_WORKLIST)
ENT_WORKLIST_COMPAT = f"""
select entity, patient_setting, service_line, cases, vdc from (
  select w.*, row_number() over (partition by entity, service_line order by vdc desc, cases desc, patient_setting) rn
  from ({ENT_WORKLIST}) w) x where rn = 1"""

ENT_VOL = f"""
select entity, patient_setting, service_line, count(distinct encounter_id) as tot_cases
from ({ENT_ENC}) e group by entity, patient_setting, service_line"""
oracle("ent_volumes", ENT_VOL)
oracle("ent_volumes_merged", " union all ".join(f"""
select cast({n} as int) as level, {', '.join(f'{c if i < n else "cast(null as varchar)"} as {c}' for i, c in enumerate(('entity', 'patient_setting', 'service_line')))},
  count(distinct encounter_id) as tot_cases
from ({ENT_ENC}) e {'group by ' + ', '.join(('entity', 'patient_setting', 'service_line')[:n]) if n else ''}""" for n in (3, 2, 1, 0)))

ENT_USAGE = f"""
select u.*, {sql_ratio('u.vdc', 4, 'u.cases', 0, 6)} as vdc_per_case from (
  select b.full_charge_code_description, b.cost_driver, b.cc_rollup, b.entity, b.patient_setting, b.service_line,
    count(distinct b.encounter_id) as cases, sum(b.vdc) as vdc, v.tot_cases
  from ({ENT_BILL}) b join ({ENT_VOL}) v
    on v.entity = b.entity and v.patient_setting = b.patient_setting and v.service_line = b.service_line
  group by b.full_charge_code_description, b.cost_driver, b.cc_rollup, b.entity, b.patient_setting,
    b.service_line, v.tot_cases) u"""
oracle("ent_usage", ENT_USAGE)


def _pairs(worklist: str) -> str:
    return f"""
select distinct a.full_charge_code_description as full_cc_description, a.cost_driver, a.cc_rollup,
  b.cc_rollup as comparison_cc_rollup, a.patient_setting, a.service_line, a.entity as entity_of_interest,
  b.entity as comparison_entity, a.vdc_per_case - b.vdc_per_case as cost_per_case_diff,
  a.vdc_per_case as eoi_vdc_per_case, coalesce(b.vdc_per_case, 0) as other_entity_vdc_per_case,
  {sql_ratio('a.cases', 0, 'a.tot_cases', 0, 6)} as eoi_case_vol_perc,
  {sql_ratio('b.cases', 0, 'b.tot_cases', 0, 6)} as other_entities_case_vol_perc,
  a.cases as eoi_cases, a.tot_cases as eoi_tot_cases, coalesce(b.cases, 0) as other_entity_cases,
  coalesce(b.tot_cases, 0) as other_entity_tot_cases, a.vdc as eoi_vdc, coalesce(b.vdc, 0) as other_entity_vdc
from (select u.* from ({ENT_USAGE}) u join ({worklist}) w
        on w.entity = u.entity and w.patient_setting = u.patient_setting and w.service_line = u.service_line) a
  left join ({ENT_USAGE}) b
    on b.full_charge_code_description = a.full_charge_code_description and b.cost_driver = a.cost_driver
   and b.service_line = a.service_line and b.patient_setting = a.patient_setting and b.entity <> a.entity"""


ENT_GROUPS = ENT_WORKLIST[:ENT_WORKLIST.rindex("order by")]
ENT_PAIRS = _pairs(ENT_GROUPS)
oracle("ent_pairs", ENT_PAIRS)

oracle("ent_unique", f"""
select charge_codes_unique_to_entity_of_interest, cost_driver, charge_code_rollup, entity_of_interest,
  patient_setting, service_line, cast(eoi_case_vol_perc as decimal(20,2)) as eoi_case_perc,
  cast(eoi_cases as int) as eoi_cases, cast(eoi_tot_cases as int) as eoi_tot_cases,
  cast(eoi_vdc as decimal(20,2)) as eoi_vdc, cast(eoi_vdc_per_case as decimal(20,2)) as eoi_vdc_per_case
from (select distinct full_cc_description as charge_codes_unique_to_entity_of_interest, cost_driver,
        cc_rollup as charge_code_rollup, entity_of_interest, patient_setting, service_line, eoi_case_vol_perc,
        eoi_cases, eoi_tot_cases, eoi_vdc, eoi_vdc_per_case
      from ({ENT_PAIRS}) p where comparison_entity is null and eoi_vdc > 0) d""")


def _overlap(pairs: str) -> str:
    avg_diff = sql_ratio("s_diff", 6, "n", 0, 6)
    avg_perc = sql_ratio("s_perc", 6, "n_perc", 0, 6)
    return f"""
select full_cc_description as overlapping_charge_codes,
  cast({avg_diff} * eoi_cases as decimal(20,2)) as impact_dollars,
  case when eoi_case_vol_perc - {avg_perc} > 0.05 then 'Over 5% Higher Utilization than other entities'
       when eoi_case_vol_perc - {avg_perc} < -0.05 then 'Over 5% Lower Utilization than other entities'
       else 'Within 5% Utilization of other entities' end as utilization_comparison,
  cost_driver, cc_rollup as charge_code_rollup, patient_setting, service_line, entity_of_interest,
  cast(n_ent as int) as num_other_entities,
  cast({avg_diff} as decimal(20,2)) as avg_cost_per_case_diff,
  cast(eoi_vdc_per_case as decimal(20,2)) as eoi_vdc_per_case,
  cast({sql_ratio('s_vpc', 6, 'n', 0, 6)} as decimal(20,2)) as avg_other_entity_vdc_per_case,
  cast(eoi_case_vol_perc as decimal(20,2)) as eoi_case_perc,
  cast({avg_perc} as decimal(20,2)) as avg_other_entity_case_perc,
  cast(eoi_cases as int) as eoi_cases,
  {sql_int_avg('s_cases', 'n')} as avg_other_entity_cases,
  cast(eoi_tot_cases as int) as eoi_tot_cases,
  {sql_int_avg('s_tot', 'n')} as avg_other_entity_tot_cases
from (
  select full_cc_description, cost_driver, cc_rollup, patient_setting, service_line, entity_of_interest,
    eoi_case_vol_perc, eoi_tot_cases, eoi_cases, eoi_vdc_per_case,
    count(*) as n, sum(cost_per_case_diff) as s_diff, sum(other_entity_vdc_per_case) as s_vpc,
    sum(other_entities_case_vol_perc) as s_perc, count(other_entities_case_vol_perc) as n_perc,
    sum(other_entity_cases) as s_cases, sum(other_entity_tot_cases) as s_tot,
    count(distinct comparison_entity) as n_ent
  from ({pairs}) p
  where comparison_entity is not null and cost_per_case_diff > 0
  group by full_cc_description, cost_driver, cc_rollup, patient_setting, service_line, entity_of_interest,
    eoi_case_vol_perc, eoi_tot_cases, eoi_cases, eoi_vdc_per_case) g"""


oracle("ent_overlap", _overlap(ENT_PAIRS))
oracle("ent_overlap_top100", _overlap(_pairs(ENT_WORKLIST)))
oracle("ent_overlap_compat", _overlap(_pairs(ENT_WORKLIST_COMPAT)))
oracle("ent_report_sorted", _overlap(ENT_PAIRS))
ORACLE["ent_report_unique_sorted"] = ORACLE["ent_unique"]


# --------------------------------------------------------------- quality
def _qa_enc(pop_filter: str, names: str) -> str:
    return f"""
select distinct e.encounter_id, e.service_line as msdrg_case_type_family, pop.patient_population, e.fiscal_year,
  s.category_name as source_system_category, e.patient_setting, md.full_name as attend_physician_name,
  md.specialty as attend_physician_specialty, e.entity, ac.name as age_cohort, e.age,
  ge.description as gender, ap.aprrom as risk_of_mortality, ap.aprsoi as severity_of_illness, e.los, e.primary_qvi_id
from f_encounter e
  join f_age_cohort ac on ac.age_cohort_id = e.age_cohort_id
  join f_gender ge on ge.gender_id = e.gender_id
  join f_apr_drg ap on ap.apr_drg_id = e.apr_drg_id
  join f_source_system s on s.source_system_id = e.source_system_id
  join f_physician md on md.physician_id = e.attend_physician_id
  {pop_filter} (select encounter_id, max(name) as patient_population from f_indicator
             where name in ({names}) group by encounter_id) pop on pop.encounter_id = e.encounter_id
where e.fiscal_year = 1996 and s.category_name = 'Hospital Billing' and e.has_charge = 'Yes'
  and e.patient_setting in ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') and e.attend_physician_id <> 0"""


QA_ENC = _qa_enc("left join", "'MACHINERY', 'BUILDING', 'FURNITURE'") + \
    " and e.service_line in ('MACHINERY', 'BUILDING', 'FURNITURE')"
oracle("qa_encounters", QA_ENC)
oracle("qa_population", _qa_enc("join", "'CI_A'"))

PROC_DATES = f"""
select distinct l.encounter_id, l.service_date, l.service_ts
from f_line l join f_cpt c on c.cpt_id = l.cpt_id
where c.cpt_code in ('C007', 'C011', 'C023', 'C031', 'C042')
  and l.encounter_id in (select encounter_id from ({QA_ENC}) qe)"""
oracle("proc_dates", PROC_DATES)
PROC_ORDER = f"""
select p.*, cast(row_number() over (partition by encounter_id order by service_date, service_ts) as int) as proc_order
from ({PROC_DATES}) p"""
oracle("proc_order", PROC_ORDER)
SINGLE = f"select encounter_id, cast(count(*) as int) as maxproc from ({PROC_DATES}) p group by encounter_id having count(*) = 1"
oracle("single_proc", SINGLE)


def _phase(proc: str, charge: str) -> str:
    d = f"date_diff('day', cast({proc} as date), cast({charge} as date))"
    return (f"case when {d} < 0 then 'Before Proc' when {d} > 0 then 'After Proc' "
            f"when {d} = 0 then 'Day of Proc' else 'NA' end")


oracle("phase_label", f"""
select l.row_id, l.encounter_id, p.service_ts as proc_date, l.service_ts as charge_service_date,
  {_phase('p.service_ts', 'l.service_ts')} as date_of_service
from f_line l join ({PROC_DATES}) p on p.encounter_id = l.encounter_id
  join ({SINGLE}) s on s.encounter_id = l.encounter_id""")


def _group(label: str, qvi_join: str, where: str) -> str:
    return f"""
select {label} as qvi, e.fiscal_year, e.entity, e.encounter_id, e.msdrg_case_type_family, e.patient_population,
  e.attend_physician_name, e.attend_physician_specialty, e.age_cohort, e.age, e.gender, e.risk_of_mortality,
  e.severity_of_illness, e.los, e.patient_setting, {_phase('p.service_ts', 'l.service_ts')} as date_of_service,
  s.maxproc as total_proc, p.service_ts as proc_date, l.service_ts as charge_service_date, ub.cost_driver,
  cc.description as charge_code_desc, cast(sum(k.unit_cost * l.units) as decimal(38,4)) as vdc
from ({QA_ENC}) e
  join ({SINGLE}) s on s.encounter_id = e.encounter_id
  join ({PROC_ORDER}) p on p.encounter_id = e.encounter_id
  join f_line l on l.encounter_id = e.encounter_id
  join f_charge_code cc on cc.charge_code_id = l.charge_code_id
  join f_ub_revenue_code ub on ub.ub_revenue_code_id = l.ub_revenue_code_id
  left join f_cost k on k.row_id = l.row_id
  {qvi_join}
where upper(trim(ub.cost_driver)) <> 'EXCLUDED' {where}
group by all"""


QVI_GROUP = _group("q.qvi_name", "join f_qvi q on q.encounter_id = e.encounter_id", "and q.qvi_name in ('VAP')")
CONTROL_GROUP = _group("'Control'", "", "and e.primary_qvi_id = 0")
oracle("qvi_group", QVI_GROUP)
oracle("control_group", CONTROL_GROUP)
QA_GROUPS = f"select * from ({QVI_GROUP}) a union all select * from ({CONTROL_GROUP}) b"



def _driver_summary(events: str) -> str:
    return " union all ".join(f"""
select '{label}' as event_group, cost_driver, count(distinct encounter_id) as cases,
  (select count(distinct encounter_id) from ({src}) t) as totcases,
  {sql_ratio('sum(vdc)', 4, 'count(distinct encounter_id)', 0, 6)} as vdc_per_case
from ({src}) g group by cost_driver""" for label, src in (("Quality event", events), ("Control", CONTROL_GROUP)))


oracle("driver_summary", _driver_summary(QVI_GROUP))
oracle("driver_summary_two_events", _driver_summary(_group(
    "q.qvi_name", "join f_qvi q on q.encounter_id = e.encounter_id", "and q.qvi_name in ('VAP', 'FALL')")))

CHI_BASE = f"""
select coalesce(c.cost_driver, q.cost_driver) as cost_driver, cast(coalesce(q.n, 0) as bigint) as qvi_trmt,
  cast(t.qvi_tot as bigint) as qvi_tot, cast(coalesce(c.n, 0) as bigint) as con_trmt, cast(t.con_tot as bigint) as con_tot
from (select cost_driver, count(distinct encounter_id) as n from ({QA_GROUPS}) g where qvi <> 'Control' group by cost_driver) q
  full outer join (select cost_driver, count(distinct encounter_id) as n from ({QA_GROUPS}) g
                   where qvi = 'Control' group by cost_driver) c on c.cost_driver = q.cost_driver
  cross join (select count(distinct case when qvi <> 'Control' then encounter_id end) as qvi_tot,
                     count(distinct case when qvi = 'Control' then encounter_id end) as con_tot
              from ({QA_GROUPS}) g) t"""
oracle("chi_base", CHI_BASE)

CHI_ROWS = f"""
select cost_driver, qvi_trmt, qvi_tot - qvi_trmt as qvi_no_trmt, qvi_tot,
  {sql_ratio('qvi_trmt * 100', 0, 'qvi_tot', 0, 2, 19)} as qvi_trmt_perc,
  con_trmt, con_tot - con_trmt as con_no_trmt, con_tot,
  {sql_ratio('con_trmt * 100', 0, 'con_tot', 0, 2, 19)} as con_trmt_perc
from ({CHI_BASE}) b"""
oracle("chi_rows", CHI_ROWS)
oracle("chi_cols", f"""
select cost_driver, cast(qvi_trmt + con_trmt as decimal(19,2)) as trmt_tot,
  cast(qvi_no_trmt + con_no_trmt as decimal(19,2)) as no_trmt_tot, cast(qvi_tot + con_tot as decimal(19,2)) as grand_tot
from ({CHI_ROWS}) r""")


def _exp(a: str, b: str) -> str:
    return sql_ratio(f"({a}) * ({b})", 0, "qvi_tot + con_tot", 0, 2, 19)


CHI_EXP = f"""
select cost_driver,
  {_exp('qvi_tot', 'qvi_trmt + con_trmt')} as exp_qvi_trmt, {_exp('qvi_tot', 'qvi_no_trmt + con_no_trmt')} as exp_qvi_no_trmt,
  {_exp('con_tot', 'qvi_trmt + con_trmt')} as exp_con_trmt, {_exp('con_tot', 'qvi_no_trmt + con_no_trmt')} as exp_con_no_trmt
from ({CHI_ROWS}) r"""
oracle("chi_expected", CHI_EXP)


def _cell(o: str) -> str:
    dev = f"abs(r.{o} - e.exp_{o})"
    return f"coalesce({sql_ratio(f'{dev} * {dev}', 4, f'e.exp_{o}', 2, 6)}, cast(0 as decimal(38,6))) as diff_{o}"


CHI_DIFF = f"""
select r.cost_driver, {_cell('qvi_trmt')}, {_cell('qvi_no_trmt')}, {_cell('con_trmt')}, {_cell('con_no_trmt')}
from ({CHI_ROWS}) r join ({CHI_EXP}) e on e.cost_driver = r.cost_driver"""
oracle("chi_diff", CHI_DIFF)
oracle("chi_label", f"""
select d.cost_driver, d.diff_qvi_trmt + d.diff_qvi_no_trmt + d.diff_con_trmt + d.diff_con_no_trmt as chi_square,
  case when d.diff_qvi_trmt + d.diff_qvi_no_trmt + d.diff_con_trmt + d.diff_con_no_trmt > 3.841
            and r.qvi_trmt_perc > r.con_trmt_perc then 'Statistically Higher Utilization'
       when d.diff_qvi_trmt + d.diff_qvi_no_trmt + d.diff_con_trmt + d.diff_con_no_trmt > 3.841
            and r.qvi_trmt_perc < r.con_trmt_perc then 'Statistically Lower Utilization'
       else 'Not Statistical Difference' end as significance
from ({CHI_DIFF}) d join ({CHI_ROWS}) r on r.cost_driver = d.cost_driver""")


# ----------------------------------------------------------- contingency
DEIDENT = f"""
select qvi, fiscal_year, encounter_id, msdrg_case_type_family, attend_physician_specialty, age_cohort, age, gender,
  risk_of_mortality, severity_of_illness, los, patient_setting, date_of_service, total_proc, proc_date,
  charge_service_date, cost_driver, charge_code_desc, vdc
from ({QA_GROUPS}) g"""
oracle("deidentify", DEIDENT)
CLEAN = f"""
select * from (
  select qvi, fiscal_year, cast(encounter_id as varchar) as encounter_id, msdrg_case_type_family,
    attend_physician_specialty, age_cohort, age, gender, risk_of_mortality, severity_of_illness, los,
    patient_setting, date_of_service, total_proc, proc_date, charge_service_date, cost_driver, charge_code_desc,
    coalesce(try_cast(cast(vdc as varchar) as double), 0.0) as vdc
  from ({DEIDENT}) d) c where vdc > 0"""
oracle("clean_cost", CLEAN)


def _contingency(src: str, x: str, y: str, groups: list[str]) -> str:
    g = "".join(f"{c}, " for c in groups)
    on = lambda a, b, extra: " and ".join([f"{a}.{c} = {b}.{c}" for c in groups + extra]) or "true"
    term = sql_ratio("t.n_total * c.n * c.n", 0, "r.n_x * k.n_y", 0, 9)
    return f"""
with cells as (select {g}{x}, {y}, count(*) as n from ({src}) s group by all),
  rws as (select {g}{x}, cast(sum(n) as bigint) as n_x from cells group by all),
  cls as (select {g}{y}, cast(sum(n) as bigint) as n_y from cells group by all),
  tab as (select {g}cast(sum(n) as bigint) as n_total, count(distinct {x}) as r_, count(distinct {y}) as c_ from cells
          {'group by ' + ', '.join(groups) if groups else ''}),
  j as (select c.*, r.n_x, k.n_y, t.n_total, t.r_, t.c_, {term} as term
        from cells c join rws r on {on('r', 'c', [x])} join cls k on {on('k', 'c', [y])} join tab t on {on('t', 'c', [])}),
  st as (select {g}sum(term) as s_ from j {'group by ' + ', '.join(groups) if groups else ''})
select {''.join(f'j.{c}, ' for c in groups)}j.{x}, j.{y}, j.n, j.n_y as n_bar,
  {sql_ratio('j.n * 100', 0, 'j.n_y', 0, 2)} as pct,
  cast(st.s_ - j.n_total as decimal(20,6)) as chi_square, cast((j.r_ - 1) * (j.c_ - 1) as int) as dof
from j join st on {on('st', 'j', [])}"""


oracle("assoc_overall", _contingency(CLEAN, "qvi", "cost_driver", []))

SIG = f"""
select cost_driver, n, cast({sql_ratio('k * ss - n * n', 0, 'n', 0, 6)} as decimal(20,6)) as chi_square,
  cast(k - 1 as int) as dof,
  {sql_ratio('k * ss - n * n', 0, 'n', 0, 6)} > 3.841458820694124 as significant
from (select cost_driver, cast(sum(o) as bigint) as n, sum(o * o) as ss from
        (select cost_driver, qvi, count(*) as o from ({CLEAN}) c group by all) a group by cost_driver) p
  cross join (select count(distinct qvi) as k from ({CLEAN}) c) kk"""
oracle("sig_drivers", SIG)
SIG_SUBSET = f"select * from ({CLEAN}) c where cost_driver in (select cost_driver from ({SIG}) s where significant)"
ASSOC_BY_DRIVER = _contingency(SIG_SUBSET, "qvi", "date_of_service", ["cost_driver"])
oracle("assoc_by_driver", ASSOC_BY_DRIVER)


def _pvalues(tests: str, groups: str) -> str:
    # 1 - P(dof/2, chi/2), with the positive series of the lower incomplete gamma function; its terms fall
    # geometrically beyond twice the argument.
    a, x = "(dof / 2.0)", "(cast(chi_square as double) / 2)"
    term = f"exp(n * ln({x}) + {a} * ln({x}) - {x} - lgamma({a} + n + 1))"
    lower = f"list_sum(list_transform(range(0, cast(4 * {x} + 4 * {a} + 200 as bigint)), lambda n: {term}))"
    return f"""
select {groups}chi_square, dof, case when dof <= 0 then null when chi_square <= 0 then 1.0
  else cast(round(greatest(0.0, 1 - {lower}), 6) as double) end as p_value
from (select distinct {groups}chi_square, dof from ({tests}) t) d"""


oracle("assoc_pvalues", _pvalues(ASSOC_BY_DRIVER, "cost_driver, "))
oracle("assoc_overall_p", _pvalues(_contingency(CLEAN, "qvi", "cost_driver", []), ""))


# ------------------------------------------------------------- benchmark
COHORT = """
select distinct s.client as client_name, s.clienttype, s.censusregion as client_region, s.opex as client_opex,
  ec.alias as entity_name, ec.censusregion as entity_region, ec.isamc as entity_amc, ec.isurban as entity_urban, ec.entitytype,
  ec.opex as entity_opex, ec.bedsize as entity_bedsize, e.orgpin, e.stratum_id, e.msdrg_code, e.primary_cpt_code,
  e.discharge_date as dischargedate, cast(year(e.discharge_date) as int) as dc_year, e.primary_icd10dx_code,
  e.age_rollup, e.encounter_id,
  case when s.client ilike '%NATION_7%' then 1 else 0 end as clientofinterest,
  case when ec.entity_key = 7 then 'Alpha Hospital' when ec.entity_key = 32 then 'Beta Hospital'
       else 'Other Entities' end as entities_of_interest
from f_encounter e
  join f_system_criteria s on s.orgpin = e.orgpin and s.stratum_id = e.stratum_id
  join f_entity_criteria ec on ec.orgpin = e.orgpin and ec.stratum_id = e.stratum_id and ec.entity_key = e.entity_key
where e.source_system_id in (select source_system_id from f_source_system where category_name = 'Hospital Billing')
  and e.patient_setting in ('1-URGENT', '2-HIGH', '3-MEDIUM') and year(e.discharge_date) = 1996
  and (s.clienttype = 'T0' or s.censusregion = 'ASIA' or ec.entitytype = 'MACHINERY')"""
oracle("peer_cohort", COHORT)
oracle("peer_flags", f"select orgpin, stratum_id, encounter_id, clientofinterest, entities_of_interest from ({COHORT}) c")
PEER_BILLING = f"""
select c.*, b.servicedateid, b.servicedate, b.billedcptid, b.billedcptcode, b.billedcptdescription,
  b.chargecodecostdriver, cast(sum(b.totalunitsofservice) as decimal(38,2)) as units_of_service,
  cast(sum(b.variabledirectcost) as decimal(38,4)) as variable_direct_cost
from f_billing b join ({COHORT}) c on c.encounter_id = b.encounterid and c.orgpin = b.orgpin and c.stratum_id = b.stratum_id
where b.billedcptcode = 'C007'
group by all"""
oracle("peer_billing", PEER_BILLING)
oracle("peer_checks", f"""
select clientofinterest, count(distinct client_name) as clients, max(dischargedate) as max_discharge_date
from ({COHORT}) c group by clientofinterest""")
oracle("peer_billing_checks", f"""
select clientofinterest, billedcptcode, billedcptdescription, count(distinct client_name) as clients,
  max(dischargedate) as max_discharge_date
from ({PEER_BILLING}) b group by all""")

CLIENT_DIMS = [("clienttype", "clientofinterest", "'T0'"), ("client_region", "clientofinterest", "'ASIA'"),
               ("client_opex", "clientofinterest", "'X1'")]
ENTITY_DIMS = [("entitytype", "entities_of_interest", "'MACHINERY'"),
               ("entity_opex", "entities_of_interest", "'X1', 'X2'"),
               ("entity_bedsize", "entities_of_interest", "'small', 'large'"),
               ("entity_urban", "entities_of_interest", None)]


def _stack(src: str, dims, extra: str) -> str:
    parts = []
    for dim, flag, allowed in dims:
        cond = f"{dim} is not null" if allowed is None else f"cast({dim} as varchar) in ({allowed})"
        parts.append(f"select '{dim}' as dimension, cast({flag} as varchar) as flag, cast({dim} as varchar) as dim_value, "
                     f"{extra} from ({src}) s where {cond}")
    return " union all ".join(parts)


def _metrics(src: str, keys: list[str], with_uos: bool = True, top: int | None = None,
             case_key: tuple = ("orgpin", "stratum_id", "encounter_id")) -> str:
    k = ", ".join(keys)
    enc = ", ".join(c for c in case_key if c not in keys)
    tail = f" order by cases desc, {k} limit {top}" if top else ""
    if not with_uos:
        return f"select {k}, count(*) as cases from (select distinct {k}, {enc} from ({src}) s) d group by {k}{tail}"
    return f"""
select {k}, count(*) as cases, cast(sum(u) as decimal(38,2)) as uos, cast(sum(d) as bigint) as patient_days,
  {sql_ratio('sum(u)', 2, 'count(*)', 0, 1)} as uos_per_case, {sql_ratio('sum(u)', 2, 'sum(d)', 0, 1)} as uos_per_patientday
from (select {k}, {enc}, sum(units_of_service) as u, count(distinct servicedateid) as d from ({src}) s group by all) e
group by {k}{tail}"""


BILL_EXTRA = "orgpin, stratum_id, encounter_id, servicedateid, units_of_service"
oracle("util_client_dims", _metrics(_stack(PEER_BILLING, CLIENT_DIMS, BILL_EXTRA), ["dimension", "flag", "dim_value"]))
oracle("util_entity_dims", _metrics(_stack(PEER_BILLING, ENTITY_DIMS, BILL_EXTRA), ["dimension", "flag", "dim_value"]))
oracle("util_all_dims", _metrics(_stack(PEER_BILLING, CLIENT_DIMS + ENTITY_DIMS, BILL_EXTRA),
                                 ["dimension", "flag", "dim_value"]))
oracle("volume_dims", _metrics(_stack(COHORT, CLIENT_DIMS + ENTITY_DIMS, "orgpin, stratum_id, encounter_id"),
                               ["dimension", "flag", "dim_value"], with_uos=False))


def _side(sql: str, side: str, with_orgpin: bool, with_uos: bool = True) -> str:
    org = "orgpin" if with_orgpin else "cast(null as int) as orgpin"
    rest = ("uos, patient_days, uos_per_case, uos_per_patientday" if with_uos else
            "cast(null as decimal(38,2)) as uos, cast(null as bigint) as patient_days, "
            "cast(null as decimal(38,1)) as uos_per_case, cast(null as decimal(38,1)) as uos_per_patientday")
    return f"select '{side}' as side, msdrg_code, {org}, cases, {rest} from ({sql}) t"


COI_B = f"select * from ({PEER_BILLING}) b where clientofinterest = 1"
CMP_B = f"select * from ({PEER_BILLING}) b where clientofinterest = 0"
COI_TOP = _metrics(COI_B, ["msdrg_code", "orgpin"], top=5)
oracle("top_drg_coi", _side(COI_TOP, "coi", True) + " union all " + _side(
    _metrics(f"select * from ({CMP_B}) c where msdrg_code in (select msdrg_code from ({COI_TOP}) t)", ["msdrg_code"], top=5),
    "comparator", False))
COI_DRGS = f"select msdrg_code from ({COI_TOP}) t"
oracle("top_drg_coi_total", _side(
    _metrics(f"select * from ({COHORT}) c where clientofinterest = 1 and msdrg_code in ({COI_DRGS})",
             ["msdrg_code", "orgpin"], with_uos=False, top=5), "coi_total", True, False) + " union all " + _side(
    _metrics(f"select * from ({COHORT}) c where clientofinterest = 0 and msdrg_code in ({COI_DRGS})",
             ["msdrg_code"], with_uos=False, top=5), "comparator_total", False, False))
CMP_TOP = _metrics(f"select * from ({CMP_B}) c where msdrg_code <> '000'", ["msdrg_code"], top=5)
CMP_DRGS = f"select msdrg_code from ({CMP_TOP}) t"
oracle("top_drg_cohort", " union all ".join([
    _side(CMP_TOP, "comparator", False),
    _side(_metrics(f"select * from ({COI_B}) c where msdrg_code in ({CMP_DRGS})", ["msdrg_code", "orgpin"], top=5),
          "coi", True),
    _side(_metrics(f"select * from ({COHORT}) c where clientofinterest = 0 and msdrg_code in ({CMP_DRGS})",
                   ["msdrg_code"], with_uos=False, top=5), "comparator_total", False, False),
    _side(_metrics(f"select * from ({COHORT}) c where clientofinterest = 1 and msdrg_code in ({CMP_DRGS})",
                   ["msdrg_code", "orgpin"], with_uos=False, top=5), "coi_total", True, False)]))


# ------------------------------------------------------------------- drg

oracle("client_db_name", "select orgpin, client, 'P_' || replace(client, '_', '') as db_name from f_system_criteria")
oracle("client_entities", "select orgpin, entity_key, alias, entitytype, bedsize from f_entity_criteria where orgpin in (2, 3, 7, 11, 16, 20)")
oracle("mdc_group", f"""
select encounter_id, msdrg_code, try_cast(msdrg_code as int) as msdrg_numeric, {sql_mdc_group('msdrg_code')} as msdrg_groupings
from f_encounter""")
oracle("mdc_group_ranges", f"""
select encounter_id, msdrg_code, try_cast(msdrg_code as int) as msdrg_numeric, {sql_mdc_group('msdrg_code')} as msdrg_groupings
from f_encounter""")
PX_DETAIL = f"""
select e.encounter_id, e.record_number, dx.name as prim_icd10dx_description, ms.name as msdrg_fulldescription,
  try_cast(e.msdrg_code as int) as msdrg_numeric, {sql_mdc_group('e.msdrg_code')} as msdrg_groupings,
  px.name as icd10px_fulldescription, p.seq as sequence_number, m.labelone as section,
  m.labeltwo || '-' || m.labelfour as body_system_part, m.labeltwo as body_system, m.labelfour as body_part
from f_encounter e join f_procedure p on p.encounter_id = e.encounter_id
  join f_icd10px px on px.code = p.px_code join f_icd10dx dx on dx.code = e.primary_icd10dx_code
  join f_msdrg ms on ms.msdrg_code = e.msdrg_code
  left join f_pcs_map m on m.code = p.px_code
where e.fiscal_year = 1996"""
oracle("px_detail", PX_DETAIL)
oracle("px_by_encounter", f"select encounter_id, sequence_number, msdrg_groupings, body_system_part from ({PX_DETAIL}) d")
oracle("px_pattern", f"select * from ({PX_DETAIL}) d where msdrg_fulldescription ilike '% 98%'")
oracle("mdc_body_part", f"""
select msdrg_groupings, body_system_part, count(distinct encounter_id) as cases, count(*) as icd10px_codes
from ({PX_DETAIL}) d group by msdrg_groupings, body_system_part""")


# ---------------------------------------------------------------- cohort

oracle("csv_load", "select count(*) as n_rows, 31 as n_cols from f_donor")
oracle("csv_rows", "select * from f_donor where donor_key % 40 <> 7")
oracle("csv_rejects", "select donor_key, donor_line, 'n/a' as age from f_donor where donor_key % 40 = 7")


def _blank(c: str) -> str:
    return f"({c} is null or trim(cast({c} as varchar)) = '')"


DONORS = f"""
select * from f_donor
where age >= 18 and tx_year >= 1998 and {_blank('tx_hrt')} and {_blank('tx_kid')} and {_blank('tx_lng')}
  and {_blank('tx_int')} and {_blank('tx_pan')} and {_blank('tx_retxdate')} and prev_tx is distinct from 'Y'
  and not {_blank('tx_date')} and age_don >= 10"""
oracle("cohort_filter", DONORS)
oracle("populated_pct", " union all ".join(
    f"select '{c}' as column_name, cast(count({c}) as double) / cast(count(*) as double) * 100 as pct_populated "
    f"from ({DONORS}) d" for c in POPULATED_COLUMNS))
oracle("bin_generic", f"""
select donor_key, donor_line, bmi_don, {sql_bin_label('bmi_don', DONOR_BMI)} as donor_bmi_categories from ({DONORS}) d""")
BINNED = "select d.*, " + ", ".join(f"{sql_bin_label(src, spec)} as {label}" for src, label, spec in DONOR_BINS) + \
    f" from ({DONORS}) d"
oracle("bin_specs", "select donor_key, donor_line, " + ", ".join(b[1] for b in DONOR_BINS) + f" from ({BINNED}) b")
ONE_HOT = "select b.*, " + ", ".join(f"case when {label} = '{r[2]}' then 1 else 0 end as {r[2]}"
                                     for _, label, spec in DONOR_BINS for r in spec) + f" from ({BINNED}) b"
oracle("one_hot", "select donor_key, donor_line, " + ", ".join(r[2] for b in DONOR_BINS for r in b[2]) +
       f" from ({ONE_HOT}) o")


def _flag(name, c, op, v):
    lit_ = f"'{v}'" if isinstance(v, str) else str(v)
    cond = f"{c} is distinct from {lit_}" if op == "!=" else f"{c} {'=' if op == '==' else op} {lit_}"
    return f"case when {cond} then 1 else 0 end as {name}"


FLAGGED = "select o.*, " + ", ".join(_flag(*f) for f in DONOR_FLAGS) + f" from ({ONE_HOT}) o"
oracle("flags", "select donor_key, donor_line, " + ", ".join(f[0] for f in DONOR_FLAGS) + f" from ({FLAGGED}) f")
oracle("feature_matrix", "select " + ", ".join(FEATURES) + f" from ({FLAGGED}) f")


# ------------------------------------- redundancy over the billing lines
ENC_USAGE = ORACLE["enc_usage"]
LINE_RANKED = f"""
select u.*, case cpt_code when 'C007' then 'A' when 'C011' then 'B' else 'NA' end as cc_rank
from (select * from ({ENC_USAGE}) x
      where encounter_id not in (select encounter_id from ({ENC_USAGE}) y where uos <= 0 or vdc <= 0)) u"""
LINE_ORDER = ("service_date, cc_rank, service_ts, cpt_code, unit_cost nulls first, ordering_md_name, "
              "ordering_md_spec")
LINE_ADJ_ALL = f"""
select r.*,
  case when lag(service_date) over w = service_date then 'same day' else 'NA' end as same_day,
  cast(coalesce(date_diff('day', lag(service_date) over w, service_date), 99999) as int) as date_diff
from ({LINE_RANKED}) r
window w as (partition by encounter_id order by {LINE_ORDER})"""
oracle("adjacent_lines", f"select * from ({LINE_ADJ_ALL}) a where service_ts is not null")
_LSD = f"""
select a.*,
  cast(case when same_day = 'same day' then vdc when same_day = 'NA' and uos > 1 then (uos - 1) * unit_cost
       else 0 end as decimal(38,4)) as same_day_excess_vdc,
  case when same_day = 'same day' then uos else uos - 1 end as same_day_excess_uos
from ({LINE_ADJ_ALL}) a
where service_ts is not null and record_number in
  (select record_number from ({LINE_ADJ_ALL}) x where same_day = 'same day' or (same_day = 'NA' and uos > 1))"""
_LND = f"""
select a.*,
  cast(case when date_diff = 1 then unit_cost else 0 end as decimal(38,4)) as subseq_day_excess_vdc,
  case when date_diff = 1 then 1 else 0 end as subseq_day_excess_uos
from ({LINE_ADJ_ALL}) a
where service_ts is not null and record_number in (select record_number from ({LINE_ADJ_ALL}) x where date_diff = 1)"""
oracle("savings_lines", f"""
with sd as (select sum(same_day_excess_uos) u, sum(same_day_excess_vdc) v from ({_LSD}) s),
     nd as (select sum(subseq_day_excess_uos) u, sum(subseq_day_excess_vdc) v from ({_LND}) n)
select cast(1996 as int) as fiscalyear, cast(sd.u as int) as same_day_excess_tests,
  cast(sd.v as double) as same_day_excess_vdc, cast(nd.u as int) as consecutive_daily_tests,
  cast(nd.v as double) as consecutive_daily_vdc, cast(sd.u + nd.u as int) as total_excess_tests,
  cast(sd.v + nd.v as double) as total_excess_vdc, cast(sd.v * 0.75 as double) as same_day_savings_75,
  cast(nd.v * 0.5 as double) as consecutive_daily_savings_50,
  cast(sd.v * 0.75 + nd.v * 0.5 as double) as total_savings
from sd, nd""")


# ----------------------------------------- literal (compat) behaviours

oracle("qa_encounters_fanout", f"""
select distinct e.encounter_id, e.service_line as msdrg_case_type_family, pop.patient_population, e.fiscal_year,
  s.category_name as source_system_category, e.patient_setting, md.full_name as attend_physician_name,
  md.specialty as attend_physician_specialty, e.entity, ac.name as age_cohort, e.age,
  ge.description as gender, ap.aprrom as risk_of_mortality, ap.aprsoi as severity_of_illness, e.los, e.primary_qvi_id
from f_encounter e
  join f_age_cohort ac on ac.age_cohort_id = e.age_cohort_id
  join f_gender ge on ge.gender_id = e.gender_id
  join f_apr_drg ap on ap.apr_drg_id = e.apr_drg_id
  join f_source_system s on s.source_system_id = e.source_system_id
  join f_physician md on md.physician_id = e.attend_physician_id
  left join (select distinct encounter_id,
               case when name in ('MACHINERY', 'BUILDING', 'FURNITURE', 'CI_A') then name end as patient_population
             from f_indicator) pop on pop.encounter_id = e.encounter_id
where e.fiscal_year = 1996 and s.category_name = 'Hospital Billing' and e.has_charge = 'Yes'
  and e.patient_setting in ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') and e.attend_physician_id <> 0
  and e.service_line in ('MACHINERY', 'BUILDING', 'FURNITURE', 'CI_A')""")

oracle("single_proc_by_date", f"""
select encounter_id, cast(count(*) as int) as maxproc
from (select encounter_id, service_date, min(service_ts) as service_ts
      from (select l.encounter_id, l.service_date, l.service_ts
            from f_line l join f_cpt c on c.cpt_id = l.cpt_id
            where c.cpt_code in ('C007', 'C011', 'C023', 'C031', 'C042')
              and l.encounter_id in (select encounter_id from ({QA_ENC}) qe)) p
      group by encounter_id, service_date) d
group by encounter_id having count(*) = 1""")


def _cell_compat(o: str) -> str:
    first = "abs(r.qvi_trmt - e.exp_qvi_trmt)"
    dev = f"abs(r.{o} - e.exp_{o})"
    return f"coalesce({sql_ratio(f'{dev} * {first}', 4, f'e.exp_{o}', 2, 6)}, cast(0 as decimal(38,6))) as diff_{o}"


oracle("chi_diff_compat", f"""
select r.cost_driver, {_cell_compat('qvi_trmt')}, {_cell_compat('qvi_no_trmt')}, {_cell_compat('con_trmt')},
  {_cell_compat('con_no_trmt')}
from ({CHI_ROWS}) r join ({CHI_EXP}) e on e.cost_driver = r.cost_driver""")

oracle("util_literal_cases", _metrics(_stack(PEER_BILLING, CLIENT_DIMS + ENTITY_DIMS, BILL_EXTRA),
                                      ["dimension", "flag", "dim_value"], case_key=("encounter_id",)))

oracle("one_hot_compat", "select donor_key, donor_line, " + ", ".join(
    f"case when strpos({label}, '{COMPAT_SUBSTRINGS[r[2]]}') > 0 then 1 else 0 end as {r[2]}"
    for _, label, spec in DONOR_BINS for r in spec) + f" from ({BINNED}) b")

oracle("bin_specs_compat_age", f"""
select donor_key, donor_line, age_don, {sql_bin_label('age_don', DONOR_AGE_COMPAT)} as donor_age_categories
from ({DONORS}) d""")
