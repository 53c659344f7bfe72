"""DuckDB counterparts of the derived inputs, as named sub-queries."""

from __future__ import annotations

LAB = """b as (
  select *, substr(cast(ts as varchar),1,10) as d,
    replace(substr(cast(ts as varchar),1,19),' ','T') || 'Z' as t,
    case event_type when 'click' then '2345-7' when 'view' then '718-7'
      when 'error' then '6690-2' when 'signup' then '777-3' else '99999-9' end as code
  from events),
l as (
  select 'EVT-' || cast(event_id as varchar) as event_id,
    case when event_id%20=1 then ' lab_result_updated ' when event_id%20=18 then 'ORDER_CREATED'
      when event_id%20=19 then 'LAB_RESULT_VALIDATED' else 'LAB_RESULT_CREATED' end as event_type,
    case when event_id%97=0 then '  ' else 'PAT-' || cast(user_id as varchar) end as patient_id,
    'ORD-' || cast(user_id as varchar) || '-' || d as order_id,
    'SPC-' || cast(user_id as varchar) || '-' || d || '-' || cast(event_id%2 as varchar) as specimen_id,
    code as test_code,
    case when event_type='signup' then null else code end as loinc_code,
    event_type as test_name,
    case when event_id%10=7 then 'yellow'
      when event_id%10=3 then '> ' || cast(value as varchar) || ' mg/dL'
      else cast(value as varchar) end as value,
    'mg/dL' as unit, cast(null as varchar) as reference_range, cast(null as varchar) as abnormal_flag,
    case when event_id%4=0 then ' preliminary' else 'final' end as validation_status,
    case when event_id%101=0 then 'bad' else t end as result_datetime,
    case when event_id%3=0 then null when event_id%3=1 then ''
      else 'RES-' || cast(user_id as varchar) || '-' || code || '-' || d end as result_id,
    case when event_id%5=0 then null else t end as modified_at,
    event_id*2 as seq
  from b),
lab as (
  select * from l
  union all
  select * replace (seq+1 as seq) from l where event_id like '%7')"""

RANGES = """ranges(code, low, high) as (values
  ('2345-7',70.0,99.0),('2339-0',70.0,99.0),('718-7',12.0,17.5),('6690-2',4.0,11.0),('777-3',150.0,450.0),
  ('2160-0',0.6,1.3),('38483-4',0.6,1.3),('2951-2',135.0,145.0),('2947-0',135.0,145.0),('2823-3',3.5,5.1),
  ('6298-4',3.5,5.1),('2093-3',0.0,200.0),('18262-6',0.0,130.0),('2085-9',40.0,100.0),('4548-4',4.0,5.7))"""

TYPED = """typed as (
  select * replace (
    upper(trim(event_type)) as event_type,
    upper(trim(validation_status)) as validation_status,
    try_cast(replace(result_datetime,'Z','') as timestamp) as result_datetime,
    coalesce(try_cast(replace(modified_at,'Z','') as timestamp),
             try_cast(replace(result_datetime,'Z','') as timestamp)) as modified_at)
  from lab)"""

DEDUP = """accepted as (
  select * from typed
  where event_type in ('LAB_RESULT_CREATED','LAB_RESULT_UPDATED','LAB_RESULT')
    and trim(patient_id) <> '' and trim(order_id) <> '' and trim(specimen_id) <> ''),
unique_events as (
  select * from accepted
  qualify row_number() over (partition by event_id order by modified_at desc nulls last, value, seq) = 1)"""

SILVER = """keyed as (
  select * replace (
    case when trim(result_id) <> '' then result_id
      else 'RES-' || sha256(concat_ws('|', patient_id, order_id, specimen_id, test_code, cast(result_datetime as varchar)))
    end as result_id)
  from unique_events),
latest as (
  select *, value as value_raw,
    try_cast(nullif(regexp_extract(value, '[-+]?(?:\\d+(?:\\.\\d*)?|\\.\\d+)'),'') as double) as value_numeric
  from keyed
  qualify row_number() over (partition by result_id order by modified_at desc nulls last, event_id desc) = 1),
silver as (
  select latest.* replace (
      case when value_numeric is null or r.code is null then 'UNKNOWN'
        when value_numeric < r.low then 'L' when value_numeric > r.high then 'H' else 'N' end as abnormal_flag),
    case when value_numeric is null then value end as value_text
  from latest left join ranges r on r.code = coalesce(loinc_code, test_code))"""

GOLD = """gold as (
  select *, sha256(concat_ws('|', patient_id, order_id, specimen_id, hash_json)) as context_hash,
    'READY_FOR_AI' as status
  from (
    select patient_id, order_id, specimen_id,
      count(*) as results_count,
      count(*) filter (abnormal_flag in ('H','L')) as abnormal_results_count,
      count(*) filter (abnormal_flag = 'N') as normal_results_count,
      count(*) filter (abnormal_flag = 'UNKNOWN') as unknown_flag_results_count,
      min(result_datetime) as first_result_datetime,
      max(result_datetime) as last_result_datetime,
      string_agg(distinct validation_status, ',' order by validation_status) as validation_status_summary,
      '[' || string_agg('{' || concat_ws(',',
          '"result_id":' || to_json(result_id), '"test_code":' || to_json(test_code),
          '"value_raw":' || to_json(value_raw), '"unit":' || to_json(unit),
          '"abnormal_flag":' || to_json(abnormal_flag), '"validation_status":' || to_json(validation_status),
          '"modified_at":' || to_json(cast(modified_at as varchar))) || '}', ',' order by result_id) || ']' as hash_json
    from silver group by all))"""

LAB_CTE = "with " + LAB
TYPED_CTE = ",\n".join(["with " + LAB, TYPED])
DEDUP_CTE = ",\n".join([TYPED_CTE, DEDUP])
SILVER_CTE = ",\n".join([DEDUP_CTE, RANGES, SILVER])
GOLD_CTE = ",\n".join([SILVER_CTE, GOLD])
