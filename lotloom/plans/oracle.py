"""The same results in DuckDB SQL, written from the rules and not from the Spark plans."""

from __future__ import annotations

_CENTS = "cast(floor({0} * 100 + 0.5) as bigint)"

_LOTS = f"""
lots as materialized (
  select s_suppkey as supplier, s_name as supplier_name, n_name as country, p_partkey as part,
         x.quantity, cast(x.total // x.quantity as bigint) as price_cents, x.seen_at, x.grade,
         p_brand as brand, p_type as category, p_name as description, p_size as capacity_gb
  from (select l_suppkey, l_partkey, cast(sum(cast(l_quantity as bigint)) as bigint) as quantity,
               cast(sum({_CENTS.format('l_extendedprice')}) as bigint) as total, max(l_shipdate) as seen_at, min(l_returnflag) as grade
        from lineitem group by 1, 2) x
  join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey left join nation on n_nationkey = s_nationkey
)"""

_REQ = f"""
req as materialized (
  select o_custkey as buyer, p_partkey as part, wanted, {_CENTS.format('p_retailprice')} as limit_cents, asked_at, p_brand as brand, p_type as category
  from (select o_custkey, l_partkey, 3 * cast(sum(cast(l_quantity as bigint)) as bigint) as wanted, max(o_orderdate) as asked_at
        from orders join lineitem on o_orderkey = l_orderkey group by 1, 2) x
  join part on p_partkey = l_partkey
)"""

_CAND = """
cand as materialized (
  select r.*, l.supplier, l.country, l.quantity, l.price_cents, l.seen_at,
         row_number() over (partition by r.buyer, r.part order by l.price_cents, l.supplier) as place
  from req r join lots l on l.part = r.part where l.supplier <> r.buyer and l.quantity > 0
)"""

_TAKEN = """
taken as (
  select *, greatest(0, least(quantity, wanted - coalesce(sum(quantity) over (partition by buyer, part order by place rows between unbounded preceding and 1 preceding), 0))) as take
  from cand {0}
)"""

_FILL = """
fill as (
  select buyer, part, wanted, limit_cents, cast(sum(take) as bigint) as filled, count(*) as suppliers, cast(sum(take * price_cents) as bigint) as cost, max(seen_at) as seen_at
  from taken where take > 0 group by 1, 2, 3, 4
)"""

# Every option of a requirement, scored in 80,000ths of a cent: 5 % off for each further supplier,
# 10 % for several countries, 15 % for a shortfall. A supplier has one lot of a part, so the sweep over
# at most three suppliers takes the three cheapest lots.
_OPTIONS = """
pool as materialized (
  select * from cand where place <= 8 and (buyer, part) in (select (buyer, part) from cand group by buyer, part having max(quantity) < any_value(wanted))
), two as materialized (
  select a.buyer, a.part, a.wanted, a.limit_cents, a.place as i, b.place as j, a.quantity as qa, b.quantity as qb, a.price_cents as pa, b.price_cents as pb,
         a.supplier as sa, b.supplier as sb, a.country as ca, b.country as cb, greatest(a.seen_at, b.seen_at) as seen
  from pool a join pool b on a.buyer = b.buyer and a.part = b.part and a.place < b.place
), three as materialized (
  select t.*, c.place as k, c.quantity as qc, c.price_cents as pc, c.supplier as sc, c.country as cc, greatest(t.seen, c.seen_at) as last
  from two t join pool c on c.buyer = t.buyer and c.part = t.part and c.place > t.j
  where qa + qb < t.wanted and qa + c.quantity < t.wanted and qb + c.quantity < t.wanted and qa + qb + c.quantity >= t.wanted
), swept as (
  select *, greatest(0, least(quantity, wanted - coalesce(sum(quantity) over (partition by buyer, part order by place rows between unbounded preceding and 1 preceding), 0))) as take from pool where place <= 3
), opt as materialized (
  select buyer, part, wanted, limit_cents, 0 as kind, place as ord, [supplier] as who, least(quantity, wanted) as filled, least(quantity, wanted) * price_cents as cost, 4000 as factor, seen_at from cand
  union all
  select buyer, part, wanted, limit_cents, 1, i * 8 + j, [sa, sb], wanted, qa * pa + (wanted - qa) * pb, case when ca <> cb then 3420 else 3800 end, seen from two where qa + qb >= wanted
  union all
  select buyer, part, wanted, limit_cents, 2, (i * 8 + j) * 8 + k, [sa, sb, sc], wanted, qa * pa + qb * pb + (wanted - qa - qb) * pc, case when ca <> cb or ca <> cc or cb <> cc then 3249 else 3610 end, last from three
  union all
  select buyer, part, wanted, limit_cents, 3, 0, list(supplier order by place), sum(take), sum(take * price_cents),
         case count(*) when 3 then 361 else 380 end * case when count(distinct country) > 1 then 9 else 10 end, max(seen_at)
  from swept where take > 0 group by 1, 2, 3, 4 having count(*) > 1
), ranked as (
  select *, row_number() over (partition by buyer, part order by (limit_cents * filled - cost) * factor * case when filled < wanted then 17 else 20 end desc, kind, ord) as turn from opt {0}
), chosen as materialized (
  select buyer, part, limit_cents, wanted, cast(filled as bigint) as filled, cast(len(who) as bigint) as suppliers, cast(limit_cents * filled - cost as bigint) as total_margin, seen_at from ranked where turn = 1
)"""

_BOARD = f"""
board as materialized (
  select r.buyer, r.part, r.brand, r.category, r.wanted,
         case when f.filled is null then 'no_supply' when f.filled < r.wanted then 'short' else 'filled' end as state,
         coalesce(f.filled, 0) as filled, coalesce(f.suppliers, 0) as suppliers, f.total_margin,
         case when f.filled is not null then greatest(r.asked_at, f.seen_at) end as matched_at
  from req r left join chosen f on f.buyer = r.buyer and f.part = r.part
)"""

_BOARDS = f"with {_LOTS}, {_REQ}, {_CAND}, {_OPTIONS.format('')}, {_BOARD} "
_BEST = "case state when 'filled' then 0 when 'short' then 1 else 3 end, coalesce(total_margin, 0) desc, filled desc, buyer, part"

_SNAP = f"""
snap as (
  select l_suppkey as supplier, l_partkey as part, year(l_shipdate) % 2 as odd, cast(sum(cast(l_quantity as bigint)) as bigint) as quantity,
         cast(sum({_CENTS.format('l_extendedprice')}) // sum(cast(l_quantity as bigint)) as bigint) as price_cents
  from lineitem group by 1, 2, 3
), old as (select * from snap where odd = 0), new as (select * from snap where odd = 1),
size as (
  select n.supplier, b.n is null or n.n >= 0.5 * b.n as closes
  from (select supplier, count(*) as n from new group by 1) n left join (select supplier, count(*) as n from old group by 1) b on n.supplier = b.supplier
), side as (
  select coalesce(o.supplier, n.supplier) as supplier, coalesce(o.part, n.part) as part, o.part is not null as was, n.part is not null as here,
         o.quantity as old_quantity, n.quantity as new_quantity, o.price_cents as old_price, n.price_cents as new_price
  from old o full join new n on o.supplier = n.supplier and o.part = n.part
), act as (
  select s.supplier, s.part,
         case when not was then 'insert' when not here then case when closes then 'close' else 'keep' end
              when old_quantity is distinct from new_quantity or old_price is distinct from new_price then 'update' else 'refresh' end as kind,
         old_quantity, new_quantity, old_price, new_price,
         coalesce(old_price > 0 and new_price > 0 and (new_price >= 5 * old_price or old_price >= 5 * new_price), false) as needs_review
  from side s left join size z on z.supplier = s.supplier
)"""

_DIFF = """
diff as (
  select supplier, part, case when not was then 'appeared' when not here then 'vanished' when old_price is distinct from new_price then 'price'
                              when old_quantity is distinct from new_quantity then 'quantity' else 'unchanged' end as kind
  from side
)"""

_LEGS = f"""
legs as (
  select l_orderkey, l_partkey, l_suppkey, cast(l_quantity as bigint) as q, {_CENTS.format('l_extendedprice')} as sell, {_CENTS.format('p_retailprice')} as unit_cost
  from lineitem join part on p_partkey = l_partkey
)"""

_MONEY = _CENTS.format("p_retailprice")
_COMPOSED = f"""
composed as (
  select p_partkey, p_name, p_brand, p_size, {_MONEY} as c, cast({_MONEY} // 100 as varchar) || '.' || lpad(cast({_MONEY} % 100 as varchar), 2, '0') as money,
         case when p_partkey % 3 = 0 then lpad(cast(p_partkey as varchar), 13, '4') when p_partkey % 3 = 1 then '0' || lpad(cast(p_partkey as varchar), 12, '8') end as ean
  from part
)"""

ORACLE_SQL = {
    "match_best_single": f"""with {_LOTS}, {_REQ}, {_CAND}, scored as (
        select *, least(wanted, quantity) as take, case when quantity >= wanted then 'exact' else 'partial' end as kind, limit_cents - price_cents as unit_margin from cand
      ), final as (select *, unit_margin * take as total_margin, unit_margin * take * case kind when 'exact' then 100 else 85 end as score from scored)
      select buyer, part, supplier, take, kind, unit_margin, total_margin, score from final
      qualify row_number() over (partition by buyer, part order by score desc, price_cents, supplier) = 1""",
    "match_greedy_fill": f"""with {_LOTS}, {_REQ}, {_CAND}, {_TAKEN.format('')}, {_FILL}
      select buyer, part, filled, suppliers, cast((200 * cost + filled) // (2 * filled) as bigint) as unit_cost, limit_cents * filled - cost as total_margin, filled < wanted as short from fill""",
    # each supplier has one lot of a part, so the cap on suppliers is one on lots
    "match_sweep_supplier_cap": f"""with {_LOTS}, {_REQ}, {_CAND}, {_TAKEN.format('where place <= 3')}, {_FILL}
      select buyer, part, filled, suppliers as legs, suppliers, cost from fill where suppliers >= 2""",
    "match_pair_combinations": f"""with {_LOTS}, {_REQ}, {_CAND}, open as (select buyer, part from cand group by 1, 2 having max(quantity) < any_value(wanted))
      select a.buyer, a.part, a.supplier as supplier_a, b.supplier as supplier_b, a.wanted, a.quantity * a.price_cents + (a.wanted - a.quantity) * b.price_cents as cost,
             a.limit_cents * a.wanted - (a.quantity * a.price_cents + (a.wanted - a.quantity) * b.price_cents) as total_margin
      from cand a join cand b on a.buyer = b.buyer and a.part = b.part and a.place < b.place and b.place <= 8
      where (a.buyer, a.part) in (select (buyer, part) from open) and a.quantity + b.quantity >= a.wanted""",
    "match_triple_combinations": f"""with {_LOTS}, {_REQ}, {_CAND}, open as (select buyer, part from cand group by 1, 2 having max(quantity) < any_value(wanted)),
      pool as materialized (select c.* from cand c join open using (buyer, part) where place <= 8)
      select a.buyer, a.part, a.supplier as supplier_a, b.supplier as supplier_b, c.supplier as supplier_c, a.wanted
      from pool a join pool b on a.buyer = b.buyer and a.part = b.part and a.place < b.place join pool c on a.buyer = c.buyer and a.part = c.part and b.place < c.place
      where a.quantity + b.quantity + c.quantity >= a.wanted and greatest(a.quantity + b.quantity, a.quantity + c.quantity, b.quantity + c.quantity) < a.wanted""",
    "match_place_split": f"""with {_LOTS}, {_REQ}, {_CAND}, top as (
        select *, row_number() over (partition by supplier, part order by limit_cents desc, buyer) as turn from cand
      ), given as (
        select *, greatest(0, least(wanted, quantity - coalesce(sum(wanted) over (partition by supplier, part order by turn rows between unbounded preceding and 1 preceding), 0))) as give from top where turn <= 3
      ) select supplier, part, cast(sum(give) as bigint) as placed, count(*) as buyers, cast(sum(give * (limit_cents - price_cents)) as bigint) as total_margin
      from given where give > 0 group by 1, 2 having count(*) > 1""",
    "board_rows": _BOARDS + "select * from board",
    "board_tiles": _BOARDS + "select count(*) filter (where state <> 'no_supply') as live_matches, count(*) filter (where state = 'no_supply') as unmet, cast(coalesce(sum(total_margin) filter (where state <> 'no_supply'), 0) as bigint) as opportunity from board",
    "board_rank_best": _BOARDS + f"select buyer, part, state, filled, total_margin from board order by {_BEST} limit 300",
    "board_rank_new": _BOARDS + f"select buyer, part, state, matched_at from board order by matched_at desc nulls last, {_BEST} limit 300",
    "board_supplier_filter": f"with {_LOTS}, {_REQ}, {_CAND}, {_OPTIONS.format('where list_contains(who, 7)')} select buyer, part, filled, suppliers from chosen",
    "board_facets": f"with {_LOTS} select distinct brand, category from lots",
    "board_search_words": "select p_partkey, p_name, p_brand from part where strpos(lower(p_name || ' ' || p_brand || ' ' || p_size || 'gb'), 'a') > 0 and strpos(lower(p_name || ' ' || p_brand || ' ' || p_size || 'gb'), '1') > 0",
    "offers_filtered_page": f"with {_LOTS} select supplier, part, quantity, price_cents from lots where grade = 'A' and quantity > 10 order by seen_at desc, supplier, part limit 500",
    "cheapest_lots": f"with {_LOTS}, p as (select *, row_number() over (partition by brand order by price_cents, supplier, part) as place from lots) select brand, place, supplier, part, price_cents from p where place <= 8",
    "sibling_network_inference": f"""with {_LOTS} select l.supplier, l.part, case when l.part % 7 = 0 then '5g' when exists (select 1 from lots x where x.supplier = l.supplier and x.brand = l.brand and x.part % 7 = 0) then '4g' end as network from lots l""",
    "reconcile_actions": f"with {_SNAP} select * from act",
    "reconcile_undecided": f"with {_SNAP} select case when kind = 'close' then 'keep' else kind end as kind, count(*) as n from act group by 1",
    "reconcile_counts": f"with {_SNAP} select kind, count(*) as n, count(*) filter (where needs_review) as needing_review from act group by 1",
    "reconcile_applied": f"""with {_SNAP} select supplier, part, coalesce(n.quantity, o.quantity) as quantity, coalesce(n.price_cents, o.price_cents) as price_cents
      from act a left join new n using (supplier, part) left join old o using (supplier, part) where a.kind <> 'close'""",
    "reconcile_field_changes": f"""with {_SNAP}
      select supplier, part, 'price' as field, cast(old_price as varchar) as old, cast(new_price as varchar) as new from act where kind = 'update' and old_price is distinct from new_price
      union all select supplier, part, 'quantity', cast(old_quantity as varchar), cast(new_quantity as varchar) from act where kind = 'update' and old_quantity is distinct from new_quantity
      union all select supplier, part, 'status', 'live', 'sold' from act where kind = 'close'""",
    "import_undo": f"with {_SNAP} select supplier, part, case kind when 'insert' then 'withdrawn' else 'reopened' end as undo from act where kind in ('insert', 'close')",
    "list_diff": f"with {_SNAP}, {_DIFF} select * from diff",
    "list_diff_summary": f"""with {_SNAP}, {_DIFF}, n as (select supplier, count(*) filter (where kind = 'appeared') as a, count(*) filter (where kind = 'vanished') as g, count(*) filter (where kind in ('price', 'quantity')) as c from diff group by 1)
      select supplier, case when a + g + c = 0 then 'identical' else concat_ws(', ', case when a > 0 then a || ' new' end, case when g > 0 then g || ' gone' end, case when c > 0 then c || ' changed' end) end as summary from n""",
    "list_fingerprint": f"""with {_SNAP}, r as (select supplier, part || '|' || quantity || '|' || (price_cents // 100) || '.' || lpad(cast(price_cents % 100 as varchar), 2, '0') || '|EUR' as row from new)
      select supplier, count(*) as n_rows, sha256(count(*) || chr(10) || string_agg(row, chr(10) order by row)) as fingerprint from r group by 1""",
    "habitual_categories": f"with {_LOTS}, t as (select supplier, category, count(*) as n from lots group by 1, 2) select supplier, category, n from t where category is not null and (n >= 2 or n >= 0.1 * (select sum(n) from t u where u.supplier = t.supplier))",
    "latest_prior_list": "select user_id, event_id, ts from events e where not exists (select 1 from events f where f.user_id = e.user_id and (f.ts > e.ts or (f.ts = e.ts and f.event_id > e.event_id)))",
    "same_day_lists": """with e as (select event_id, user_id, ts, json_extract_string(props, '$.k') as k, row_number() over (partition by user_id order by ts, event_id) as i from events)
      select a.event_id, a.user_id, case when b.event_id is null or cast(a.ts as date) <> cast(b.ts as date) then 'apply' when a.k is not distinct from b.k then 'same' else 'hold' end as decision
      from e a left join e b on a.user_id = b.user_id and b.i = a.i - 1""",
    "late_lists": """with m as (select user_id, event_type, max(ts) as last from events group by 1, 2)
      select event_id, case when last = ts then 'current' when cast(last as date) <> cast(ts as date) then 'superseded' else 'behind' end as standing from events join m using (user_id, event_type)""",
    "confirmed_today": "select user_id, strftime(ts, '%Y-%m-%d') as day, count(distinct event_type) as categories, count(*) as lists from events group by 1, 2",
    "review_verdict": """with r as (select source, count(*) as n, count(*) filter (where quality = 0 or toxic = 1) as flagged from documents join labels using (doc_id) group by 1)
      select *, case when flagged >= 0.25 * n then 'suspect' when flagged > 0 then 'check' else 'healthy' end as verdict from r""",
    "review_flagged": "select doc_id, source, substring(text, 1, 400) as preview from documents join labels using (doc_id) where quality = 0 or toxic = 1 order by doc_id desc limit 300",
    "supplier_summary": f"""with {_LOTS}, p as (select *, row_number() over (partition by supplier order by seen_at desc, part) as i from lots)
      select s_suppkey, count(supplier) as live, max(seen_at) as last_seen, coalesce(string_agg(cast(price_cents as varchar), ',' order by i) filter (where i <= 5), '') as recent_prices
      from supplier left join p on supplier = s_suppkey group by 1""",
    "clients_with_live": "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'O')",
    "deal_committed": f"""with {_LEGS} select o_custkey, cast(coalesce(sum(q * unit_cost) filter (where o_orderstatus <> 'F'), 0) as bigint) as committed, count(distinct o_orderkey) filter (where o_orderstatus <> 'F') as open_count
      from legs join orders on o_orderkey = l_orderkey group by 1""",
    "deal_reference": "select o_orderpriority, coalesce(max(o_orderkey), 0) + 1 as next_reference from orders group by 1",
    "deal_stale": "select o_orderkey, cast(floor((epoch(timestamp '2024-02-01') - floor(epoch(o_orderdate))) / 86400) as bigint) as days, floor((epoch(timestamp '2024-02-01') - floor(epoch(o_orderdate))) / 86400) >= 8 as stale from orders where o_orderstatus = 'O'",
    "in_play": f"""with {_LOTS} select supplier, part, exists (select 1 from lineitem join orders on o_orderkey = l_orderkey where o_orderstatus = 'O' and o_totalprice > 100000 and l_suppkey = supplier and l_partkey = part) as in_play from lots""",
    "retention_redact": "select event_id, case when ts < timestamp '2024-01-15' then '' else props end as props from events",
    "retention_orphans": "select c_custkey from customer c where not exists (select 1 from orders where o_custkey = c_custkey) and not exists (select 1 from events where user_id = c_custkey)",
    "ingest_once": "select min(event_id) as event_id, user_id from events group by user_id, event_type, floor(epoch(ts))",
    "norm_money": f"""with {_COMPOSED} select p_partkey, case when p_partkey % 5 < 4 then c end as price_cents,
      case p_partkey % 5 when 0 then 'EUR' when 1 then 'USD' when 2 then 'GBP' when 3 then 'AED' end as currency,
      case p_partkey % 5 when 1 then 'per_lot' when 2 then 'per_unit' else 'unknown' end as basis, case when p_partkey % 5 = 2 then 'EXW' end as incoterm,
      case when p_partkey % 5 = 3 then false end as vat_included from composed""",
    "norm_quantity": "select p_partkey, case when p_size > 0 then p_size end as quantity from part",
    "norm_ean": f"with {_COMPOSED} select p_partkey, ean from composed",
    "identity_key": f"with {_COMPOSED} select p_partkey, case when ean is not null then 'ean:' || ean || '|' else 'spec:' || lower(p_brand) || '|' || lower(p_name) || '|' end || p_size || '||||||' as identity_key from composed",
    "extract_rows": f"""with {_COMPOSED} select p.p_brand as brand, p.p_name as description, c.ean, case when p.p_size > 0 then p.p_size end as quantity, c.c as price_cents, 'EUR' as currency, p.p_type as section
      from part p join composed c using (p_partkey)""",
    "completeness_decision": """with b as (select user_id, cast(ts as date) as d, count(*) as n, min(event_type) as t from events group by 1, 2),
      w as (select *, cast(3 * (sum(n) over (partition by user_id) // count(*) over (partition by user_id)) as bigint) as typical from b)
      select user_id, strftime(d, '%Y-%m-%d') as day, n, typical,
             case when t = 'view' then false when t = 'click' and not (n <= 5 and n < 0.5 * typical) then true when n < 0.4 * typical then null
                  when t = 'click' and n <= 5 and n < 0.5 * typical then null when t = 'click' then true when n <= 5 then null else true end as complete from w""",
    "settle_decision": f"""with {_SNAP}, c as (select supplier, count(*) filter (where was and not here) as would_close, count(*) filter (where was) as live from side group by 1)
      select *, case when would_close = 0 or would_close < 10 or would_close < 0.4 * live or supplier % 3 = 0 then 'replace' else 'add' end as decision from c""",
    "import_verdict": f"""with {_SNAP}, c as (select supplier, count(*) as n, count(*) filter (where quantity > 48) as flagged, (select count(*) from old o where o.supplier = n.supplier) as before from new n group by 1)
      select supplier, n, flagged, case when flagged >= 0.25 * n or n <= 0.5 * before then 'suspect' when n <= 0.8 * before or flagged > 0 then 'check' else 'healthy' end as verdict from c""",
    "stream_ingest_dedup": "select distinct user_id, event_type from events",
    "stream_board_equals_batch": _BOARDS + "select * from board",
    "match_near_miss": """with p as (select p_partkey as k, p_brand, p_type, p_size, lower(split_part(p_name, ' ', 1)) as colour from part where p_partkey is not null and p_brand is not null and p_type is not null),
      c as (select p_brand, p_type, p_size, colour, min(k) as k from p group by 1, 2, 3, 4)
      select r.k as r, s.k as s, 'pair' as kind, concat_ws(',', case when r.p_size is distinct from s.p_size then 'capacity' end, case when r.colour <> s.colour then 'colour' end) as differences
      from p r join p s on r.p_brand = s.p_brand and r.p_type = s.p_type and r.k <> s.k where r.p_size is distinct from s.p_size or r.colour <> s.colour
      union all select p.k, c.k, 'member', '' from p join c on p.p_brand = c.p_brand and p.p_type = c.p_type and p.p_size is not distinct from c.p_size and p.colour is not distinct from c.colour""",
    "quoted_history": "select doc_id, md5(regexp_replace(coalesce(text, ''), '\\s+$', '')) as kept_md5 from documents",
    "company_match": "select c_custkey as subject_id, s_suppkey as company_id from customer left join supplier on s_name = 'Supplier#' || lpad(cast(c_custkey % 150 as varchar), 9, '0')",
    "norm_product": """select p_partkey, case p_partkey % 4 when 0 then 8 when 1 then 12 end as ram_gb, case p_partkey % 4 when 0 then 256 when 1 then 128 when 2 then 1024 end as capacity_gb,
      case p_partkey % 4 when 2 then 'Open Market' when 3 then 'Enterprise Edition' end as edition, case p_partkey % 4 when 0 then '5g' when 1 then '4g' end as network,
      p_brand || ' ' || case p_partkey % 4 when 0 then '8/256GB 5G' when 1 then '12GB RAM 128GB LTE' when 2 then '1TGB OM' else 'Ent.Ed' end as bare from part""",
}
