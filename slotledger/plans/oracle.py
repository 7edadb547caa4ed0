"""The same queries in SQL over the test tables, for checking results against a second engine."""

from __future__ import annotations

# White space as str.strip and the library's strip understand it, by code point.
_SPACES = [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
_CHARS = " || ".join(f"chr({code})" for code in _SPACES)

# Inputs, as in fixtures.py. Each may use the ones named before it.
VIEWS = {
    "commands": """
select event_id as seq, cast(ts as date) as date,
  case when isodow(ts) >= 6 then 'weekend' when hour(ts) < 8 then 'night'
       when hour(ts) < 16 then 'day' else 'evening' end as shift,
  case when k % 3 = 0 then 'parking' else 'desks' end as kind,
  cast(case when k % 3 = 0 then k % 10 + 1 else k % 28 + 1 end as varchar) as slot,
  case when event_type = 'error' then 'unbook' else 'book' end as op,
  case when event_type = 'error' and k % 4 = 1 then null else 'e_' || (user_id % 40) end as user_id,
  (event_type = 'error' and k % 5 = 0) as is_admin
from (select *, cast(json_extract_string(props, '$.k') as int) as k from events)""",
    "commands_raw": """
select seq, case when seq % 11 = 0 then null else date end as date,
  case when seq % 13 = 0 then 'noon' else shift end as shift,
  case when seq % 17 = 0 then 'bike' else kind end as kind,
  case when seq % 19 = 0 then '' else slot end as slot, op,
  case when seq % 23 = 0 then null else user_id end as user_id, is_admin
from commands""",
    "bookings": """
select date, shift, kind, slot, 'e_' || min(o_custkey) as user_id from (
  select cast(l_shipdate as date) as date,
    case when isodow(l_shipdate) >= 6 and l_linenumber < 6 then 'weekend'
         when l_linenumber % 3 = 0 then 'day' when l_linenumber % 3 = 1 then 'evening'
         else 'night' end as shift,
    case when l_linestatus = 'O' then 'desks' else 'parking' end as kind,
    cast(case when l_linestatus = 'O' then l_partkey % 28 + 1 else l_suppkey % 10 + 1 end as varchar) as slot,
    o_custkey
  from lineitem join orders on l_orderkey = o_orderkey) t
group by date, shift, kind, slot""",
    "bookings_raw": """
select case when user_id like '%7' then null else date end as date,
  case when user_id like '%7' then strftime(date, '%Y/%m/%d') else strftime(date, '%Y-%m-%d') end as date_raw, shift, kind, slot, user_id
from bookings""",
    "employees": """
select 'e_' || c_custkey as id, c_custkey as ordinal, c_name as name, c_mktsegment as department,
  case c_custkey % 4 when 0 then 'day' when 1 then 'evening' when 2 then 'night' else 'weekend' end as shift,
  case when c_custkey % 5 = 0 then null else cast(1 + c_custkey % 4 as bigint) end as target_days
from customer where c_mktsegment <> 'MACHINERY'""",
    "config_cmds": """
select 2 * p_partkey as seq,
  case p_partkey % 6 when 0 then 'desks' when 1 then 'parking' when 2 then 'targetDays' when 3 then 'year'
       when 4 then 'unavailableDesks' else 'unavailableParking' end as key,
  case when p_partkey % 6 >= 4 then p_size || ', ' || p_brand || ',' || (p_partkey % 10) || ', '
       when p_partkey % 5 = 0 then p_brand else cast(p_size as varchar) end as raw_value
from part""",
    "employee_cmds": """
select 2 * c_custkey + 1 as seq, 'e_' || c_custkey as id, 'add' as op, '  ' || c_name || ' ' as name,
  c_mktsegment as department,
  case c_custkey % 3 when 0 then 'day, night' when 1 then 'bogus' else 'evening,evening' end as shifts,
  cast(null as varchar) as shift,
  case when c_custkey % 4 = 0 then null else cast(1 + c_custkey % 5 as varchar) end as target_days,
  cast(null as boolean) as remote, cast(null as boolean) as has_car
from customer
union all
select 1000000000000 + o_orderkey, 'e_' || o_custkey,
  case when o_orderstatus = 'F' and o_orderkey % 50 = 0 then 'delete' else 'update' end,
  null, case when o_orderpriority = '3-MEDIUM' then o_orderstatus end,
  case when o_orderpriority = '1-URGENT' then
    case o_orderkey % 3 when 0 then 'night,day' when 1 then 'nope' else 'weekend' end end,
  case when o_orderpriority = '2-HIGH' then
    case o_orderkey % 3 when 0 then 'evening' when 1 then 'nope' else 'night' end end,
  case when o_orderpriority = '4-NOT SPECIFIED' then
    case when o_orderkey % 3 = 0 then 'x' else cast(o_orderkey % 6 as varchar) end end,
  case when o_orderpriority = '5-LOW' then o_orderkey % 2 = 0 end,
  case when o_orderpriority = '5-LOW' and o_orderkey % 4 < 2 then o_orderkey % 4 = 0 end
from orders""",
    "add_requests": """
select p_partkey as seq,
  case when p_partkey % 3 = 0 then [p_name, ' ' || chr(9), '  ' || p_brand || ' ', null] end as names,
  case p_partkey % 9 when 1 then ' ' || p_name when 4 then '   ' when 7 then '' end as name
from part""",
    "feedback_cmds": """
select 10 * (conv_id * 100 + turn) as seq, 'submit' as op, conv_id * 100 + turn as fb_id,
  case when turn = 0 then null when turn = 1 then '   ' else '  ' || role || conv_id || ' ' end as name,
  case when conv_id % 6 = 0 and turn = 1 then '   ' else text end as message,
  case when turn % 2 = 0 then role end as category
from conversations
union all
select 10 * (conv_id * 100 + turn) + 5, case when conv_id % 3 = 0 then 'delete' else 'read' end,
  case when conv_id % 9 = 0 then -1 else conv_id * 100 end, null, null, null
from conversations where turn > 0""",
    # ---- the request log, one row per request; what each body means is written out by hand ----
    "parts": "select p_partkey as p from part",
    "settings_sent": """
select p * 10 + 1 as seq, unnest(case p % 11
  when 1 then [{'k': 'desks', 'v': p::varchar}]
  when 2 then [{'k': 'desks', 'v': p::varchar}, {'k': 'parking', 'v': '7'}]
  when 3 then [{'k': 'unavailableDesks', 'v': '1,3'}]
  when 4 then [{'k': 'unavailableParking', 'v': '1,2'}, {'k': 'year', 'v': '2027'}]
  when 6 then [{'k': 'targetDays', 'v': null::varchar}, {'k': 'desks', 'v': '1'}]
  when 7 then [{'k': 'targetDays', 'v': '3'}]
  else [{'k': null::varchar, 'v': null::varchar}] end) as e from parts where p % 11 <> 8""",
    "settings_after": """
select seq, coalesce(last_value(d ignore nulls) over w, '28') as desks, coalesce(last_value(k ignore nulls) over w, '10') as parking,
  coalesce(last_value(t ignore nulls) over w, '2') as target, coalesce(last_value(y ignore nulls) over w, '2026') as yr,
  coalesce(last_value(ud ignore nulls) over w, '') as ud, coalesce(last_value(up ignore nulls) over w, '') as up
from (select seq, max(e.v) filter (e.k = 'desks') as d, max(e.v) filter (e.k = 'parking') as k,
  max(e.v) filter (e.k = 'targetDays') as t, max(e.v) filter (e.k = 'year') as y,
  max(e.v) filter (e.k = 'unavailableDesks') as ud, max(e.v) filter (e.k = 'unavailableParking') as up
  from settings_sent group by seq)
window w as (order by seq rows between unbounded preceding and current row)""",
    "added": """
select p, p * 10 + 2 as seq, 'e_' || lpad(lower(to_hex(p * 10 + 2)), 8, '0') || e.x as id, e.n as name,
  case when p % 8 = 2 then 'ops' else '' end as department,
  case p % 8 when 2 then 'night' when 4 then 'evening' else 'day' end as shift,
  case when p % 8 = 4 then 4 end as target
from (select p, unnest(case p % 8 when 0 then [{'x': '', 'n': 'A ' || p}, {'x': '_1', 'n': 'B'}]
  when 2 then [{'x': '', 'n': 'N ' || p}] when 4 then [{'x': '', 'n': 'New Employee'}] end) as e from parts where p % 8 in (0, 2, 4))""",
    "submitted": """
select p, p * 10 + 4 as seq, 'fb_' || lpad(lower(to_hex(p * 10 + 4)), 8, '0') as fb_id,
  case p % 6 when 0 then 'Anonymous' when 1 then '' else 'a' end as name, 'm ' || p as message,
  case p % 6 when 0 then null when 1 then 'general' else 'bug' end as category,
  (p * 10 + 5) % 3 <> 0 as deleted
from parts where p % 6 in (0, 1, 3)""",
    "booked": """
select p * 10 + 6 as seq, case when p % 10 = 5 then '5' else '2026-01-05' end as date,
  case when p % 10 = 3 then '["day"]' else 'day' end as shift,
  case when p % 10 in (4, 5) then 'parking' else 'desks' end as kind,
  case p % 10 when 0 then p::varchar when 1 then 'None' when 2 then '' when 3 then '1' when 4 then 'True' when 5 then 'x'
    when 6 then '1.0' when 7 then '1.5' else '{}' end as slot,
  case p % 10 when 0 then 'u' || p when 1 then 'u' || p when 4 then null when 5 then '7' when 6 then 'v' || p when 7 then 'w' || p
    when 8 then 'x' || p else 'u' end as user_id,
  case p % 10 when 2 then 'Invalid request' when 3 then 'Invalid request' when 4 then 'No user selected' end as error
from parts where p % 10 <> 9""",
    # ---- steps shared by several queries ----
    "worked": """
select * from bookings
where case when isodow(date) >= 6 then shift = 'weekend' else shift in ('day', 'evening', 'night') end""",
    "config_ints": """
select seq, key, try_cast(raw_value as bigint) as value from config_cmds
where key in ('desks', 'parking', 'targetDays', 'year') and regexp_full_match(raw_value, '[+-]?[0-9]+')""",
    "adds": """
select a.*, coalesce(c.value, 2) as default_target
from (select * from employee_cmds where op = 'add') a
asof left join (select seq, value from config_ints where key = 'targetDays') c on a.seq >= c.seq""",
    "ends": """
select d.id, min(d.seq) as ended from employee_cmds d join adds a on a.id = d.id and d.seq > a.seq
where d.op = 'delete' group by d.id""",
    "judged": """
select c.*, a.seq as added, e.ended,
  case when c.op = 'add' or (a.seq is not null and c.seq > a.seq and (e.ended is null or c.seq <= e.ended)) then null
       else 'Employee not found' end as error
from employee_cmds c left join adds a on a.id = c.id left join ends e on e.id = c.id""",
    "submissions": f"""
select seq, fb_id, substring(trim(coalesce(nullif(name, ''), 'Anonymous'), {_CHARS}), 1, 80) as name,
  substring(trim(coalesce(message, ''), {_CHARS}), 1, 1000) as message, coalesce(category, 'general') as category,
  case when trim(coalesce(message, ''), {_CHARS}) = '' then 'Message required' end as error
from feedback_cmds where op = 'submit'""",
    "histories": """
select s.fb_id, s.seq as submitted, min(e.seq) filter (where e.op = 'delete') as deleted,
  min(e.seq) filter (where e.op = 'read') as first_read
from submissions s left join feedback_cmds e on e.fb_id = s.fb_id and e.op <> 'submit' and e.seq > s.seq
where s.error is null group by s.fb_id, s.seq""",
    "feedback_counts": """
select seq, fb_id, op, cast(sum(step) over (order by seq) as bigint) as count from (
  select submitted as seq, fb_id, 'submit' as op, 1 as step from histories
  union all select deleted, fb_id, 'delete', -1 from histories where deleted is not null)""",
    "numbered": """
select *, row_number() over (partition by date, shift, kind order by seq) as rn from commands""",
    "replayed": """
select date, shift, kind, cast(0 as bigint) as rn, cast(null as bigint) as seq, cast(null as varchar) as slot,
  cast(null as varchar) as user_id, cast(null as varchar) as outcome, cast(null as varchar) as "by",
  cast(map([]::varchar[], []::varchar[]) as map(varchar, varchar)) as st
from (select distinct date, shift, kind from commands)
union all
select date, shift, kind, rn, seq, slot, user_id, outcome,
  case when outcome = 'booked' then user_id else owner end,
  case outcome
    when 'booked' then map_from_entries(list_append(map_entries(st), {'key': slot, 'value': user_id}))
    when 'freed' then map_from_entries(list_filter(map_entries(st), lambda x: x.key <> slot))
    else st end
from (
  select n.date, n.shift, n.kind, n.rn, n.seq, n.slot, n.user_id, r.st, r.st[n.slot] as owner,
    case when n.op = 'book' then
        case when r.st[n.slot] <> n.user_id then 'taken' when r.st[n.slot] = n.user_id then 'rebook'
             when list_contains(map_values(r.st), n.user_id) then 'already_booked' else 'booked' end
      when r.st[n.slot] is null then 'noop'
      when n.user_id is not null and n.user_id <> r.st[n.slot] and not n.is_admin then 'not_yours'
      else 'freed' end as outcome
  from replayed r join numbered n on n.date = r.date and n.shift = r.shift and n.kind = r.kind and n.rn = r.rn + 1)""",
    "outcomes": """select date, shift, kind, seq, slot, user_id, outcome, "by" from replayed where rn > 0""",
    "moves": """
select *, lead(seq) over (partition by date, shift, kind, slot order by seq) as valid_to
from outcomes where outcome in ('booked', 'freed')""",
    "spots": """
select kind as type, slot as id, max(seq) as seq,
  arg_max({'v': case when op = 'book' then user_id end}, seq).v as reserved_by
from commands group by kind, slot""",
}

# Which views a view is built from.
NEEDS = {
    "bookings_raw": ["bookings"],
    "commands_raw": ["commands"],
    "worked": ["bookings"],
    "config_ints": ["config_cmds"],
    "adds": ["employee_cmds", "config_ints"],
    "ends": ["adds"],
    "judged": ["ends"],
    "submissions": ["feedback_cmds"],
    "histories": ["submissions"],
    "feedback_counts": ["histories"],
    "numbered": ["commands"],
    "replayed": ["numbered"],
    "outcomes": ["replayed"],
    "moves": ["outcomes"],
    "spots": ["commands"],
    "config_after": ["config_cmds"],
    "settings_sent": ["parts"],
    "settings_after": ["settings_sent"],
    "added": ["parts"],
    "submitted": ["parts"],
    "booked": ["parts"],
}


def _add_config_view() -> None:
    """Every setting after each command of the settings log, which sends one setting at a time."""
    numbers = {"desks": ("desks", 28), "parking": ("parking", 10), "targetDays": ("target", 2), "year": ("yr", 2026)}
    lists = {"unavailableDesks": "ud", "unavailableParking": "up"}
    after = "coalesce(last_value(case when key = '{key}' then {value} end ignore nulls) over w, '{default}') as {name}"
    readable = "case when regexp_full_match(raw_value, '[+-]?[0-9]+') then cast(try_cast(raw_value as bigint) as varchar) end"
    columns = [after.format(key=k, value=readable, default=d, name=n) for k, (n, d) in numbers.items()]
    columns += [after.format(key=k, value=_INT_ITEMS, default="", name=n) for k, n in lists.items()]
    VIEWS["config_after"] = f"""
select seq, {", ".join(columns)} from config_cmds window w as (order by seq rows between unbounded preceding and current row)"""


def with_views(body: str, *views: str) -> str:
    """A statement over the named views, with everything they need before them."""
    order: list[str] = []

    def add(view: str) -> None:
        for need in NEEDS.get(view, []):
            add(need)
        if view not in order:
            order.append(view)

    for view in views:
        add(view)
    ctes = ",\n".join(f"{view} as ({VIEWS[view].strip()})" for view in order)
    return f"with recursive {ctes}\n{body.strip()}" if order else body.strip()


def calendar(start: str, end: str) -> str:
    """The date and shift cells of a period."""
    return f"""(
  select d as date, unnest(case when isodow(d) >= 6 then ['weekend'] else ['day', 'evening', 'night'] end) as shift
  from (select unnest(cast(generate_series(date {start}, date {end}, interval 1 day) as date[])) as d))"""


def counts(start: str, end: str) -> str:
    """Bookings per cell of a period."""
    return f"""(
  select c.date, c.shift, coalesce(b.desks, 0) as desks, coalesce(b.parking, 0) as parking
  from {calendar(start, end)} c left join (
    select date, shift, count(*) filter (where kind = 'desks') as desks,
      count(*) filter (where kind = 'parking') as parking
    from worked where date between date {start} and date {end} group by date, shift) b
  on b.date = c.date and b.shift = c.shift)"""


MEANS = """round(sum(desks)::double / (28 * count(*))::double, 6) as desk_util,
  round(sum(parking)::double / (10 * count(*))::double, 6) as parking_util"""


def summary(label: str, start: str, end: str) -> str:
    return with_views(
        f"""
, f as (select sum(desks)::bigint as desks, sum(parking)::bigint as parking, count(*) as cells
        from {counts(start, end)})
select 1 as ordinal, 'Period' as metric, '{label}' as value_text, cast(null as double) as value_num
union all select 2, 'Range', {start} || ' to ' || {end}, null
union all select 3, 'Total desks', null, 28
union all select 4, 'Total parking', null, 10
union all select 5, 'Employees', null, (select count(*) from employees)
union all select 6, 'Desk bookings', null, desks from f
union all select 7, 'Parking bookings', null, parking from f
union all select 8, 'Avg desk utilization', null, round(desks::double / (28 * cells)::double, 6) from f
union all select 9, 'Avg parking utilization', null, round(parking::double / (10 * cells)::double, 6) from f""",
        "worked",
        "employees",
    )


def attainment(start: str, end: str, weeks: int) -> str:
    return with_views(
        f"""
, p as (select user_id, count(distinct date) as n from worked
        where date between date {start} and date {end} group by user_id)
select id, ordinal, name, coalesce(n, 0) as total, coalesce(target_days, 2) * {weeks} as target,
  case when coalesce(n, 0) >= coalesce(target_days, 2) * {weeks} then 'Yes' else 'No' end as met
from employees left join p on user_id = id""",
        "worked",
        "employees",
    )


def matrix(dates: list[str], shift: str, weeks: int) -> str:
    names = [f"d_{date.replace('-', '')}" for date in dates]
    marks = ",\n  ".join(f"max(case when date = date '{d}' then 'X' end) as {n}" for d, n in zip(dates, names))
    shown = ", ".join(f"coalesce({n}, '') as {n}" for n in names)
    total = " + ".join(f"({n} is not null)::bigint" for n in names)
    return with_views(
        f"""
, p as (select user_id, {marks}
  from worked where date between date '{dates[0]}' and date '{dates[-1]}' group by user_id)
select id, ordinal, name, {shift}{shown}, {total} as total, coalesce(target_days, 2) * {weeks} as target,
  case when {total} >= coalesce(target_days, 2) * {weeks} then 'Yes' else 'No' end as met
from employees left join p on user_id = id""",
        "worked",
        "employees",
    )


def monthly(start: str, end: str) -> str:
    return with_views(
        f"""
select strftime(month_start, '%B %Y') as month, month_start, desk_util, parking_util from (
  select cast(date_trunc('month', date) as date) as month_start, {MEANS} from {counts(start, end)} group by 1)""",
        "worked",
    )


WEEK = ("'1998-02-09'", "'1998-02-15'")
MONTH = ("'1998-02-01'", "'1998-02-28'")
LONG_MONTH = ("'1998-03-01'", "'1998-03-31'")
QUARTER = ("'1998-01-01'", "'1998-03-31'")
YEAR = ("'1998-01-01'", "'1998-12-31'")
WEEK_DATES = [f"1998-02-{day:02d}" for day in range(9, 16)]
MONTH_DATES = [f"1998-02-{day:02d}" for day in range(1, 29)]

_INT_ITEMS = f"""array_to_string(list_transform(list_filter(
  list_transform(string_split(raw_value, ','), lambda x: trim(x, {_CHARS})),
  lambda x: regexp_full_match(x, '[+-]?[0-9]+')), lambda x: cast(cast(x as bigint) as varchar)), ',')"""
_CONFIG_JSON = """'{"desks":' || desks || ',"parking":' || parking || ',"targetDays":' || target || ',"year":' || yr
  || ',"unavailableDesks":[' || ud || '],"unavailableParking":[' || up || ']}'"""
_SHIFT_ITEMS = f"""list_filter(list_transform(string_split(shifts, ','), lambda x: trim(x, {_CHARS})),
  lambda x: x in ('day', 'evening', 'night', 'weekend'))"""
_SHIFTS = f"case when len({_SHIFT_ITEMS}) > 0 then {_SHIFT_ITEMS} else ['day'] end"
_add_config_view()

_OUTCOMES = with_views("select seq, date, shift, kind, slot, outcome, \"by\" from outcomes", "outcomes")

SQL = {
    "bookings_flatten": with_views(
        "select date, date_raw, shift, kind, slot, user_id from bookings_raw", "bookings_raw"
    ),
    "snapshot_round_trip": with_views(
        """select source, date, date_raw, shift, kind, slot, user_id
from bookings_raw, (select unnest(['tables', 'days', 'parts']) as source)""",
        "bookings_raw",
    ),
    "bookings_applicable": with_views("select date, shift, kind, slot, user_id from worked", "worked"),
    "bookings_dangling": with_views(
        """select date, shift, kind, slot, user_id from bookings
where not exists (select 1 from employees where id = user_id)""",
        "bookings",
        "employees",
    ),
    "day_grid": with_views(
        """select g.date, g.shift, g.kind, count(b.slot) as held
from (select date, shift, kind from (select distinct date from bookings),
  (select unnest(['day', 'evening', 'night', 'weekend']) as shift), (select unnest(['desks', 'parking']) as kind)) g
left join bookings b on b.date = g.date and b.shift = g.shift and b.kind = g.kind group by all""",
        "bookings",
    ),
    "day_image": with_views(
        """select date_raw as day, shift, kind, 0 as part, string_agg(slot || '=' || user_id, ',' order by slot) as image
from bookings_raw group by date_raw, shift, kind""",
        "bookings_raw",
    ),
    "calendar_shifts": """select d as date,
  unnest(case when isodow(d) >= 6 then ['weekend'] else ['day', 'evening', 'night'] end) as shift
from (select unnest(cast(generate_series(cast(min(o_orderdate) as date), cast(max(o_orderdate) as date),
  interval 1 day) as date[])) as d from orders)""",
    "period_bounds": """
with r as (select distinct cast(o_orderdate as date) as d from orders),
p as (select d, unnest(['week', 'month', 'quarter', 'year', 'Week']) as period from r)
select period, strftime(d, '%Y-%m-%d') as ref,
  cast(case period when 'week' then date_trunc('week', d) when 'month' then date_trunc('month', d)
    when 'quarter' then date_trunc('quarter', d) else date_trunc('year', d) end as date) as start_date,
  cast(case period when 'week' then date_trunc('week', d) + interval 6 day
    when 'month' then date_trunc('month', d) + interval 1 month - interval 1 day
    when 'quarter' then date_trunc('quarter', d) + interval 3 month - interval 1 day
    else date_trunc('year', d) + interval 1 year - interval 1 day end as date) as end_date
from p""",
    "util_shift": with_views(
        """
, c as (select d as date, unnest(case when isodow(d) >= 6 then ['weekend'] else ['day', 'evening', 'night'] end)
    as shift from (select unnest(cast(generate_series(min(date), max(date), interval 1 day) as date[])) as d
    from bookings))
select c.date, c.shift, round(count(*) filter (where kind = 'desks')::double / 28, 6) as desk_util,
  round(count(*) filter (where kind = 'parking')::double / 10, 6) as parking_util
from c left join worked w on w.date = c.date and w.shift = c.shift group by c.date, c.shift""",
        "worked",
    ),
    "summary_week": summary("Week", *WEEK),
    "summary_month": summary("Month", *MONTH),
    "summary_quarter": summary("Quarter", *QUARTER),
    "summary_year": summary("Year", *YEAR),
    "daily_week": with_views(
        f"""select date, strftime(date, '%a') as day, shift,
  case shift when 'day' then '09:00-18:00' when 'evening' then '16:00-24:00' when 'night' then '23:00-07:00'
    else '19:00-03:00' end as hours,
  round(desks::double / 28, 6) as desk_util, round(parking::double / 10, 6) as parking_util
from {counts(*WEEK)}""",
        "worked",
    ),
    "daily_month": with_views(
        f"select date, strftime(date, '%a') as day, {MEANS} from {counts(*MONTH)} group by date", "worked"
    ),
    "weekly_agg": with_views(
        f"""select 'Week ' || (row_number() over (order by week_start)) as week, week_start, desk_util, parking_util
from (select cast(date_trunc('week', date) as date) as week_start, {MEANS} from {counts(*MONTH)} group by 1)""",
        "worked",
    ),
    "monthly_agg_quarter": monthly(*QUARTER),
    "monthly_agg_year": monthly(*YEAR),
    "presence_days": with_views(
        f"""
, y as (select * from worked where date between date {YEAR[0]} and date {YEAR[1]}),
p as (select user_id, date from y where kind = 'desks' union select user_id, date from y where kind = 'parking')
select id, count(date) as days_present from employees left join p on user_id = id group by id""",
        "worked",
        "employees",
    ),
    "presence_marks": with_views(
        "select distinct user_id, date from worked where user_id in (select id from employees)", "worked", "employees"
    ),
    "presence_long": with_views(
        f"""
, d as (select unnest(cast(generate_series(date {MONTH[0]}, date {MONTH[1]}, interval 1 day) as date[])) as date),
p as (select distinct user_id, date from worked)
select e.id, e.ordinal, e.name, d.date, case when p.date is null then '' else 'X' end as mark
from employees e cross join d left join p on p.user_id = e.id and p.date = d.date""",
        "worked",
        "employees",
    ),
    "attainment_week": attainment(*WEEK, 1),
    "attainment_month": attainment(*MONTH, 4),
    "attainment_long_month": attainment(*LONG_MONTH, 5),
    "presence_matrix_week": matrix(WEEK_DATES, "shift, ", 1),
    "presence_matrix_month": matrix(MONTH_DATES, "", 4),
    "command_validate": with_views(
        """select seq, op, case
    when date is null or shift not in ('day', 'evening', 'night', 'weekend') or kind not in ('desks', 'parking')
      or slot = '' then 'Invalid request'
    when op = 'book' and user_id is null then 'No user selected' end as error
from commands_raw""",
        "commands_raw",
    ),
    "command_authority": with_views(
        """select seq, id, op,
  case when op in ('add', 'delete') and seq % 4 = 0 then 'Admin access required' end as error
from employee_cmds""",
        "employee_cmds",
    ),
    "booking_outcomes": _OUTCOMES,
    "booking_outcomes_stream": _OUTCOMES,
    "bookings_settled": with_views(
        """select date, shift, kind, slot, user_id, seq as booked_seq from moves
where outcome = 'booked' and valid_to is null""",
        "moves",
    ),
    "occupancy_intervals": with_views(
        """select date, shift, kind, slot, user_id, seq as valid_from, valid_to from moves
where outcome = 'booked'""",
        "moves",
    ),
    "util_shift_live": with_views(
        """select date, shift, kind, sum(case outcome when 'booked' then 1 else -1 end)::bigint as held
from outcomes where outcome in ('booked', 'freed') group by date, shift, kind""",
        "outcomes",
    ),
    "change_feed": with_views(
        f"""select 'bookings' as log, seq, 'booking' as action,
  strftime(date, '%Y-%m-%d') || '|' || shift || '|' || kind || '|' || slot as ref,
  case when outcome <> 'freed' then user_id end as detail
from outcomes where outcome in ('booked', 'rebook', 'freed')
union all select 'settings', seq, 'config', null, {_CONFIG_JSON} from config_after
union all select 'employees', seq, 'employees', id, op from judged where error is null
union all select 'feedback', seq, 'feedback_count', fb_id::varchar, count::varchar from feedback_counts""",
        "outcomes",
        "config_after",
        "judged",
        "feedback_counts",
    ),
    "change_feed_requests": with_views(
        f"""select 'bookings' as log, seq, 'booking' as action, date || '|' || shift || '|' || kind || '|' || slot as ref, user_id as detail
from (select *, row_number() over (partition by slot order by seq) as n from booked where error is null)
where slot not in ('None', '1.0', '1.5', '{{}}') or n = 1
union all select 'settings', seq, 'config', null, {_CONFIG_JSON} from settings_after
union all select 'employees', seq, 'employees', string_agg(id, ',' order by id), 'add' from added group by seq
union all select 'employees', p * 10 + 2, 'employees', '', 'add' from parts where p % 8 = 1
union all select 'employees', p * 10 + 3, 'employees', id, 'update' from added where right(id, 2) <> '_1'
union all select 'feedback', seq, 'feedback_count', fb_id, cast(sum(step) over (order by seq) as varchar) from (
  select seq, fb_id, 1 as step from submitted union all select seq + 1, fb_id, -1 from submitted where deleted)""",
        "booked",
        "settings_after",
        "added",
        "submitted",
    ),
    "request_bookings": with_views("select seq, date, shift, kind, slot, user_id, error from booked", "booked"),
    "request_settings": with_views("select seq, e.k as key, e.v as value from settings_sent", "settings_sent"),
    "request_employees": with_views(
        """select id, seq as ordinal, case when own and p % 5 = 0 then null when own and p % 5 = 4 then '12' else name end as name,
  case when own and p % 5 in (1, 4) then 'day' when own and p % 5 = 2 then 'weekend' else shift end as shift,
  case when own and p % 5 = 1 then 'day' when own and p % 5 = 4 then 'day,night' else shift end as shifts,
  case when own and p % 5 = 1 then null else department end as department,
  cast(case when own and p % 5 = 2 then 5 else coalesce(target, 2) end as bigint) as target_days,
  case when own and p % 5 = 3 then false end as remote, case when own and p % 5 = 3 then true end as has_car
from (select *, right(id, 2) <> '_1' as own from added)""",
        "added",
    ),
    "request_feedback": with_views(
        "select seq, fb_id, name, message, category, false as read from submitted where not deleted", "submitted"
    ),
    "client_state": with_views("select type, id, reserved_by, seq from spots", "spots"),
    "slot_status": with_views(
        """select type, id, case when reserved_by is null then 'free' when reserved_by = 'e_7' then 'mine'
    else 'taken' end as status,
  case when reserved_by is null then 'Available' when reserved_by = 'e_7' then 'You' else reserved_by end as shown,
  cast(id as bigint) as position
from spots""",
        "spots",
    ),
    "config_effective": with_views(
        """select key, coalesce(arg_max(value, seq) filter (where seq >= 0), max(value)) as value from (
  select key, seq, value from config_ints
  union all select unnest(['desks', 'parking', 'targetDays', 'year']), -1, unnest([28, 10, 2, 2026]))
group by key""",
        "config_ints",
    ),
    "config_lists": with_views(
        f"""select key, {_INT_ITEMS} as numbers from (
  select key, arg_max(raw_value, seq) as raw_value from config_cmds
  where key in ('unavailableDesks', 'unavailableParking') group by key)""",
        "config_cmds",
    ),
    "shifts_normalized": with_views(
        f"select seq, id, array_to_string({_SHIFTS}, ',') as shifts from employee_cmds where shifts is not null",
        "employee_cmds",
    ),
    "employee_adds": with_views(
        f"""select seq, name from (
  select seq, unnest(list_filter(list_transform(names, lambda x: trim(x, {_CHARS})), lambda x: x <> '')) as name
  from add_requests where names is not null
  union all
  select seq, coalesce(nullif(trim(coalesce(nullif(name, ''), 'New Employee'), {_CHARS}), ''), 'New Employee')
  from add_requests where names is null)""",
        "add_requests",
    ),
    "employee_target_asof": with_views("select seq, id, default_target from adds", "adds"),
    "employee_rejects": with_views("select seq, id, op, error from judged where error is not null", "judged"),
    "employees_current": with_views(
        f"""
, s as (
  select id, seq, case when op = 'add' then trim(name, {_CHARS}) else name end as name, department,
    case when shifts is not null then array_to_string({_SHIFTS}, ',') end as shifts,
    case when shifts is not null then ({_SHIFTS})[1]
      when shift in ('day', 'evening', 'night', 'weekend') then shift end as shift,
    case when regexp_full_match(target_days, '[+-]?[0-9]+') then try_cast(target_days as bigint) end as target_days,
    remote, has_car
  from judged where error is null and ended is null),
f as (
  select id, arg_max(name, seq) as name, arg_max(department, seq) as department, arg_max(shift, seq) as shift,
    arg_max(shifts, seq) as shifts, arg_max(target_days, seq) as target_days, arg_max(remote, seq) as remote,
    arg_max(has_car, seq) as has_car
  from s group by id)
select f.id, a.seq as ordinal, f.name, f.shift, f.shifts, f.department,
  coalesce(f.target_days, a.default_target) as target_days, f.remote, f.has_car
from f join adds a on a.id = f.id""",
        "judged",
    ),
    "feedback_clean": with_views("select seq, fb_id, name, message, category, error from submissions", "submissions"),
    "feedback_current": with_views(
        """select s.seq, s.fb_id, s.name, s.message, s.category, h.first_read is not null as read
from submissions s join histories h on h.fb_id = s.fb_id where s.error is null and h.deleted is null""",
        "histories",
    ),
    "feedback_rejects": with_views(
        """select seq, 'submit' as op, fb_id, error from submissions where error is not null
union all
select d.seq, d.op, d.fb_id, 'Not found' from feedback_cmds d left join histories h on h.fb_id = d.fb_id
where d.op = 'delete' and (h.deleted is null or h.deleted <> d.seq)""",
        "histories",
    ),
    "feedback_count_feed": with_views("select seq, fb_id, op, count from feedback_counts", "feedback_counts"),
}

SQL["booking_event_images"] = with_views(
    """, e as (select seq, date from outcomes where outcome in ('booked', 'rebook', 'freed')),
t as (select date, seq, valid_to, shift || '|' || kind || '|' || slot || '=' || user_id as held from moves where outcome = 'booked')
select e.seq, e.date, coalesce(string_agg(t.held, ',' order by t.held), '') as image
from e left join t on t.date = e.date and t.seq <= e.seq and (t.valid_to is null or t.valid_to > e.seq) group by e.seq, e.date""",
    "moves",
)
SQL["summary_requests"] = with_views(
    f"""
, r as ({SQL["period_bounds"]}),
d as (select date, count(*) filter (where kind = 'desks') as desks, count(*) filter (where kind = 'parking') as parking
  from worked group by date),
c as (select date, case when isodow(date) >= 6 then 1 else 3 end as cells
  from (select unnest(cast(generate_series(min(start_date), max(end_date), interval 1 day) as date[])) as date from r)),
b as (select distinct start_date, end_date from r),
n as (select start_date, end_date, sum(cells) as cells, coalesce(sum(desks), 0) as desks, coalesce(sum(parking), 0) as parking
  from b join c on c.date between start_date and end_date left join d on d.date = c.date group by start_date, end_date)
select period, ref, start_date, end_date, cells::bigint as cells, desks::bigint as desks, parking::bigint as parking,
  round(desks::double / (28 * cells)::double, 6) as desk_util, round(parking::double / (10 * cells)::double, 6) as parking_util
from r join n using (start_date, end_date)""",
    "worked",
)

# A log in halves gives what the whole log gives.
SQL["booking_outcomes_resumed"] = SQL["booking_outcomes_cut"] = SQL["booking_outcomes"]
SQL["bookings_settled_resumed"] = SQL["bookings_settled"]
SQL["employees_resumed"] = SQL["employees_current"]
SQL["feedback_resumed"] = SQL["feedback_current"]
SQL["feedback_count_resumed"] = SQL["feedback_count_feed"]
SQL["config_resumed"] = SQL["config_effective"]
SQL["booking_outcomes_batches"] = SQL["booking_outcomes"]
SQL["change_feed_stream"] = SQL["change_feed_requests"]
SQL["store_after_log"] = f'select date, shift, kind, slot, user_id from ({SQL["bookings_settled"]})'
SQL["config_lists_resumed"] = SQL["config_lists"]
SQL["occupancy_intervals_resumed"] = SQL["occupancy_intervals"]
SQL["change_feed_resumed"] = SQL["change_feed"]


def from_logs(start: str, end: str, body: str) -> str:
    """A report over what the logs leave: bookings, employees and settings."""
    return f"""with held as ({SQL["bookings_settled"]}),
people as ({SQL["employees_current"]}),
n as (select max(value) filter (key = 'desks') as d, max(value) filter (key = 'parking') as p,
  max(value) filter (key = 'targetDays') as t from ({SQL["config_effective"]})),
w as (select * from held where date between date {start} and date {end}
  and case when isodow(date) >= 6 then shift = 'weekend' else shift in ('day', 'evening', 'night') end),
f as (select count(*) filter (kind = 'desks') as desks, count(*) filter (kind = 'parking') as parking from w),
c as (select count(*) as cells from {calendar(start, end)})
{body}"""


SQL["report_from_logs_month"] = from_logs(
    "'2024-01-01'",
    "'2024-01-31'",
    """select 1 as ordinal, 'Period' as metric, 'Month' as value_text, cast(null as double) as value_num
union all select 2, 'Range', '2024-01-01 to 2024-01-31', null
union all select 3, 'Total desks', null, d from n
union all select 4, 'Total parking', null, p from n
union all select 5, 'Employees', null, (select count(*) from people)
union all select 6, 'Desk bookings', null, desks from f
union all select 7, 'Parking bookings', null, parking from f
union all select 8, 'Avg desk utilization', null, round(desks::double / (d * cells)::double, 6) from f, n, c
union all select 9, 'Avg parking utilization', null, round(parking::double / (p * cells)::double, 6) from f, n, c""",
)
SQL["attainment_from_logs_quarter"] = from_logs(
    "'2024-01-01'",
    "'2024-03-31'",
    """, a as (select user_id, count(distinct date) as days from w group by user_id)
select id, ordinal, name, coalesce(days, 0) as total, coalesce(target_days, t) * 13 as target,
  case when coalesce(days, 0) >= coalesce(target_days, t) * 13 then 'Yes' else 'No' end as met
from people cross join n left join a on user_id = id""",
)
