"""The FIXTURES.md recipes as ANSI SQL CTE bodies, for the DuckDB oracle
(``__spark_entry__.oracle_sql``). The Spark side builds the same inputs
with the DataFrame API in ``fixtures.py``; keeping the two independent is
what makes the comparison meaningful."""

ID = "concat('ORD-', lpad(cast(o_orderkey as varchar), 9, '0'))"

F1_SOURCE = f"""
select case when o_orderkey % 1009 = 1 then null else {ID} end as txn_id,
       o_totalprice as amount, o_orderpriority as dept from orders
union all select {ID}, o_totalprice, o_orderpriority from orders where o_orderkey % 89 = 0
"""

F1_TARGET = f"""
select case when o_orderkey % 1009 = 1 then null
            when o_orderkey % 3 = 0 then concat('  ', lower({ID}), ' ') else {ID} end as txn_id,
       case when o_orderkey % 113 = 0 then null
            when o_orderkey % 50 = 3 then o_totalprice + 0.01 else o_totalprice end as amount,
       o_orderpriority as dept
from orders where o_orderkey % 20 <> 7
union all select {ID}, o_totalprice, o_orderpriority from orders where o_orderkey % 97 = 0
union all select concat('ORD-', lpad(cast(o_orderkey + 100000000 as varchar), 9, '0')), o_totalprice, o_orderpriority
          from orders where o_orderkey % 41 = 0
"""

F2_CURRENT = """
select cast(event_id as varchar) as record_id, value, event_type as segment, ts
from events where ts >= timestamp '2024-01-25 00:00:00'
"""

F2_HISTORY = """
select value, event_type as segment, ts from events where ts < timestamp '2024-01-25 00:00:00'
"""

# with one cold segment, for the queries that are about it
F2_HISTORY_COLD = """
select value, event_type as segment, ts from events
where ts < timestamp '2024-01-25 00:00:00' and not (event_type = 'signup' and event_id >= 100)
"""

F2_HISTORY_CONTAMINATED = """
select case when event_id % 50 = 0 then value * 100 else value end as value, event_type as segment, ts
from events where ts < timestamp '2024-01-25 00:00:00'
"""

F3_GL = f"select {ID} as txn_id, o_totalprice as amount from orders"
F3_PROC = f"""
select {ID} as txn_id, case when o_orderkey % 211 = 2 then o_totalprice + 5 else o_totalprice end as amount
from orders where o_orderkey % 101 <> 5 and o_orderkey % 307 <> 11
"""
F3_WH = f"""
select {ID} as txn_id, case when o_orderkey % 50 = 3 then o_totalprice + 0.01 else o_totalprice end as amount
from orders where o_orderkey % 103 <> 9 and o_orderkey % 307 <> 11
"""

F4_QUEUE = """
select concat('EXC-', lpad(cast(o_orderkey as varchar), 9, '0')) as exception_id, 'orders' as source,
       concat('order ', cast(o_orderkey as varchar)) as description,
       case o_orderpriority when '1-URGENT' then 'critical' when '2-HIGH' then 'high' when '3-MEDIUM' then 'medium'
                            when '5-LOW' then 'low' else 'unknown' end as severity,
       case o_orderkey % 4 when 0 then 'open' when 1 then 'assigned' when 2 then 'escalated' else 'resolved' end as status,
       o_orderdate as created_at,
       cast(null as varchar) as assigned_to,
       case when o_orderkey % 4 = 3 then o_orderdate + interval '10' hour end as resolved_at,
       cast(null as varchar) as resolution_notes
from orders
"""

F6_REGISTRY = """
select p_brand as name,
       cast(row_number() over (partition by p_brand order by p_partkey) as int) as version,
       p_name as description,
       case when p_size % 7 = 0 then '' else concat('SUM(', p_type, ')') end as formula,
       case when p_size % 11 = 0 then '' else 'finance' end as owner,
       case p_partkey % 4 when 0 then 'public' when 1 then 'internal' when 2 then 'confidential' else 'restricted' end
         as sensitivity,
       'erp' as source_system, 'daily' as refresh_frequency, 24.0 as sla_hours,
       case when p_size % 5 = 0 then cast([] as varchar[]) else ['part', p_type] end as lineage
from part
"""


def with_(**ctes: str) -> str:
    """``WITH a AS (...), b AS (...)`` prefix."""
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + "\n"
