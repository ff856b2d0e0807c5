"""DuckDB SQL for the core queries, written from the definitions and sharing no code with the operators."""

from __future__ import annotations

#: arcs (edge, vertex, o1, o2, o3) and domains edges, vertices (id) of each hypergraph
GRAPHS = {
    "G1": """arcs as materialized (select l_orderkey as edge, l_partkey as vertex, l_linenumber as o1, l_partkey as o2, l_suppkey as o3 from lineitem),
edges as materialized (select o_orderkey as id from orders), vertices as materialized (select p_partkey as id from part)""",
    "G2": r"""pairs as materialized (select distinct doc_id, t from (select doc_id, unnest(string_split_regex(lower(text), '\s+')) as t from documents) where t != ''),
tokens as materialized (select t, row_number() over (order by encode(t)) - 1 as id from (select distinct t from pairs)),
arcs as materialized (select doc_id as edge, id as vertex, 0 as o1, 0 as o2, 0 as o3 from pairs join tokens using (t)),
edges as materialized (select doc_id as id from documents), vertices as materialized (select id from tokens)""",
    "G3": """types as materialized (select event_type, row_number() over (order by event_type) - 1 as id from (select distinct event_type from events)),
arcs as materialized (select user_id as edge, id as vertex, event_id as o1, 0 as o2, 0 as o3 from events join types using (event_type)),
edges as materialized (select unnest(range((select max(user_id) + 1 from events))) as id), vertices as materialized (select id from types)""",
}

ARCS = "select l_orderkey as row_id, l_partkey as nbr from lineitem"
ARCS_BACK = "select l_partkey as row_id, l_orderkey as nbr from lineitem"
SUM_CHECK = "select sum(l_partkey)::bigint as decoded_sum, sum(l_partkey)::bigint as original_sum, 0::bigint as diff from lineitem"

#: the automatic side: enc (row_id, nbr, o1..o3), nodes (id, degree), syms (id, freq), dims (nv, nh, h, n, ns)
SIDE = """dims as materialized (select nv, nh, nv <= nh as h, case when nv <= nh then nh else nv end as n, case when nv <= nh then nv else nh end as ns
    from (select (select count(*) from vertices) as nv, (select count(*) from edges) as nh)),
enc as materialized (select case when h then edge else vertex end as row_id, case when h then vertex else edge end as nbr, o1, o2, o3 from arcs, dims),
nodes as materialized (select i.id, count(e.row_id)::bigint as degree from (select id from edges, dims where h union all select id from vertices, dims where not h) i left join enc e on e.row_id = i.id group by i.id),
syms as materialized (select i.id, count(e.nbr)::bigint as freq from (select id from vertices, dims where h union all select id from edges, dims where not h) i left join enc e on e.nbr = i.id group by i.id)"""


def graph(name: str, more: str = "", recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{GRAPHS[name]},\n{SIDE}" + (f",\n{more}" if more else "") + "\n"


def ranked(pct: float) -> str:
    return f"""par as materialized (select least(ns, greatest(0, trunc(ns * ({pct!r}::double * 0.01::double) + 0.5::double)))::bigint as k from dims),
ranked as materialized (select row_number() over (order by freq desc, id) as rk, id, freq from syms),
fb as materialized (select k, max_sym, case when max_sym = 0 then 1 else length(bin(max_sym)) end as fallback_bits
    from (select k, coalesce((select max(id) from ranked where rk > k), 0) as max_sym from par))"""


def degree(name: str, side: str) -> str:
    domain = "edges" if side == "edge" else "vertices"
    return graph(name) + f"select d.id, count(a.{side})::bigint as degree from {domain} d left join arcs a on a.{side} = d.id group by d.id"


def side_choice(name: str) -> str:
    return graph(name) + "select nv::bigint as nv, nh::bigint as nh, h as encode_h, n::bigint as n from dims"


def symbol_freq(name: str) -> str:
    return graph(name) + "select id, freq from syms"


def topk(name: str, pct: float) -> str:
    return graph(name, ranked(pct)) + "select rk::bigint as rk, id, freq from ranked, par where rk <= k"


def fallback_bits(name: str, pct: float) -> str:
    return graph(name, ranked(pct)) + "select k, max_sym::bigint as max_sym, fallback_bits::bigint as fallback_bits from fb"


def _cost(pct: float) -> str:
    """A cte ``cost`` (bits_hi) by popping the two lightest of a sorted list."""
    return ranked(pct) + """,
heap(l, cost) as (select list_sort(list(freq)), case when count(*) = 1 then sum(freq)::bigint else 0 end from ranked, par where rk <= k
  union all select list_sort(list_append(l[3:], l[1] + l[2])), cost + (l[1] + l[2]) from heap where len(l) > 1),
cost as (select coalesce(max(cost), 0)::bigint as bits_hi from heap)"""


def huffman_cost(name: str, pct: float) -> str:
    return graph(name, _cost(pct), recursive=True) + "select bits_hi from cost"


_SPLIT = """split as materialized (select e.row_id, count(*) filter (rk <= k)::bigint as huff_count, count(*) filter (rk > k)::bigint as low_count
    from enc e join ranked r on r.id = e.nbr, par group by e.row_id)"""


def encode_split(name: str, pct: float) -> str:
    return graph(name, ranked(pct) + ",\n" + _SPLIT) + "select row_id, huff_count, low_count, (low_count * fallback_bits)::bigint as low_bits from split, fb"


def entry_meta(name: str, pct: float) -> str:
    return graph(name, ranked(pct) + ",\n" + _SPLIT) + "select id as row_id, degree, coalesce(huff_count, 0)::bigint as huff_count from nodes left join split on row_id = id"


def block_index(name: str, pct: float, block: int = 1024) -> str:
    return graph(name, ranked(pct) + ",\n" + _SPLIT) + f"""select block_id, coalesce(sum(bits) over (order by block_id rows between unbounded preceding and 1 preceding), 0)::bigint as lo_start_bit
from (select id // {block} as block_id, sum(coalesce(low_count, 0) * fallback_bits)::bigint as bits from (nodes left join split on row_id = id), fb group by 1)"""


def codec_stats(name: str, pct: float) -> str:
    return graph(name, _cost(pct) + ",\n" + _SPLIT, recursive=True) + """select k, fallback_bits::int as fallback_bits, bits_hi, bits_lo, tree_bytes, content_bytes,
  content_bytes // 1024 as content_kb, tree_bytes // 1024 as tree_kb, (content_bytes + tree_bytes) // 1024 as total_kb
from (select k, fallback_bits, bits_hi, bits_lo, case when k > 0 then (2 * k - 1) * 24 else 0 end::bigint as tree_bytes,
    (n * ((case when maxd < 65536 then 2 else 4 end) + 2) + (bits_hi + 7) // 8 + (bits_lo + 7) // 8)::bigint as content_bytes
  from fb, cost, dims, (select max(degree) as maxd from nodes), (select (sum(low_count) * (select fallback_bits from fb))::bigint as bits_lo from split))"""


def doc_token_roundtrip() -> str:
    return graph("G2") + "select row_id::bigint as row_id, nbr::bigint as nbr from enc"


def decode_order(pct: float) -> str:
    return graph("G1", ranked(pct)) + """select row_id, row_number() over (partition by row_id order by (rk > k), o1, o2, o3, nbr) - 1 as pos, nbr
from enc join ranked on ranked.id = nbr, par"""


def _reach(sources, step: str) -> str:
    """``found`` (src, id, dist): all that ``step`` (row_id, nbr) reaches, round by round for as long as a round adds something."""
    start = " union all ".join(f"select 0 as t, {s}::bigint as src, {s}::bigint as id, 0 as dist" for s in sources)
    return f"""hops as materialized ({step}),
walk(t, src, id, dist) as ({start} union all
  select t + 1, src, id, dist from (select any_value(t) as t, src, id, min(dist) as dist, count(*) over () as c
    from (select t, src, id, dist from walk union all select w.t, w.src, h.nbr, w.dist + 1 from walk w join hops h on h.row_id = w.id) group by src, id)
  where c > (select count(*) from walk)),
found as materialized (select src, id, min(dist) as dist from walk group by src, id)"""


_HOPS = "select distinct row_id, nbr from enc, dims where nbr between 0 and n - 1"


def bfs(name: str, sources, keep_src: bool = False) -> str:
    grid = " union all ".join(f"select {s}::bigint as src" for s in sources)
    pick = "g.src, " if keep_src else ""
    return graph(name, _reach(sources, _HOPS), recursive=True) + f"select {pick}nodes.id, f.dist::int as dist from nodes cross join ({grid}) g left join found f on f.src = g.src and f.id = nodes.id"


def bfs_levels(name: str, src: int) -> str:
    return graph(name, _reach([src], _HOPS), recursive=True) + "select dist::int as dist, count(*)::bigint as n_nodes from found group by dist"


def _peeled(k: int) -> str:
    """``core{k}`` (id, live): rounds for as long as one removes a node."""
    return f"""peel{k}(t, id, degree, live) as (select 0, id, degree, degree >= {k} from nodes union all
  select t + 1, id, degree, new from (select p.t, p.id, p.degree, p.degree - coalesce(x.c, 0) >= {k} as new, bool_or(p.live and p.degree - coalesce(x.c, 0) < {k}) over () as moved
    from peel{k} p left join (select e.nbr as id, count(*) as c from enc e join peel{k} q on q.id = e.row_id where not q.live group by 1) x on x.id = p.id) where moved),
core{k} as materialized (select id, live from peel{k} where t = (select max(t) from peel{k}))"""


def kcore(name: str, k: int) -> str:
    return graph(name, _peeled(k), recursive=True) + f"select id, live as in_core from core{k}"


def kcore_size(name: str, k: int) -> str:
    return graph(name, _peeled(k), recursive=True) + f"select count(*) filter (live)::bigint as remain from core{k}"


def core_number(name: str, k_max: int) -> str:
    joins = " ".join(f"join core{k} using (id)" for k in range(2, k_max + 1))
    total = " + ".join(f"core{k}.live::int" for k in range(1, k_max + 1))
    return graph(name, ",\n".join(_peeled(k) for k in range(1, k_max + 1)), recursive=True) + f"select id, ({total})::int as core from core1 {joins}"


def pagerank(name: str, iters: int, alpha: float = 0.85) -> str:
    parts = ["p0 as materialized (select id, degree, (1.0::double / n) as pr from nodes, dims)"]
    for i in range(1, iters + 1):
        parts.append(f"""p{i} as materialized (select p.id, p.degree, (1 - {alpha}::double) / n + {alpha}::double * (coalesce(s.s, 0) + d.d / n) as pr
  from p{i - 1} p left join (select e.nbr as id, sum(q.pr / q.degree) as s from enc e join p{i - 1} q on q.id = e.row_id group by 1) s on s.id = p.id,
  (select coalesce(sum(pr) filter (degree = 0), 0) as d from p{i - 1}) d, dims)""")
    return graph(name, ",\n".join(parts)) + f"select id, round(pr, 10) as pr from p{iters}"


def pagerank_dangling(name: str) -> str:
    return graph(name) + "select round(count(*) filter (degree = 0) * (1.0::double / any_value(n)), 10) as dangling from nodes, dims"


def _sweep(pcts) -> str:
    """``sizes`` (pct, k, fallback_bits, bits_hi, bits_lo); Huffman costs by popping the two lightest of a sorted list, for all pcts at once."""
    every = " union all ".join(f"select {p!r}::double as pct" for p in pcts)
    return f"""pcts as ({every}), ranked as materialized (select row_number() over (order by freq desc, id) as rk, id, freq from syms),
ks as materialized (select pct, least(ns, greatest(0, trunc(ns * (pct * 0.01::double) + 0.5::double)))::bigint as k from pcts, dims),
rest as materialized (select pct, k, coalesce(max(id) filter (rk > k), 0) as m, coalesce(sum(freq) filter (rk > k), 0) as low, coalesce(sum(freq) filter (rk <= k), 0) as high from ks, ranked group by pct, k),
heap(k, l, cost) as (select ks.k, list_sort(list(freq)), 0::hugeint from (select distinct k from ks) ks, ranked where rk <= ks.k group by ks.k having count(*) > 1
  union all select k, list_sort(list_append(l[3:], l[1] + l[2])), cost + (l[1] + l[2]) from heap where len(l) > 1),
cost as materialized (select k, max(cost)::bigint as cost from heap group by k),
sizes as materialized (select pct, rest.k, (case when m = 0 then 1 else length(bin(m)) end)::int as fallback_bits,
    (case when rest.k = 0 then 0 when rest.k = 1 then high else cost.cost end)::bigint as bits_hi,
    (low * (case when m = 0 then 1 else length(bin(m)) end))::bigint as bits_lo from rest left join cost on cost.k = rest.k)"""


def pct_sweep(name: str, pcts) -> str:
    return graph(name, _sweep(pcts), recursive=True) + "select pct, k, fallback_bits, bits_hi, bits_lo from sizes"


def best_allocation(name: str, pcts) -> str:
    return graph(name, _sweep(pcts), recursive=True) + """select pct, k, fallback_bits, bits_hi, bits_lo, total_bytes from (select *,
  ((bits_hi + 7) // 8 + (bits_lo + 7) // 8 + case when k > 0 then (2 * k - 1) * 24 else 0 end)::bigint as total_bytes from sizes) order by total_bytes, pct limit 1"""


def entry_totals(name: str, pct: float) -> str:
    return graph(name, _cost(pct) + ",\n" + _SPLIT, recursive=True) + """select (select count(*) from nodes)::bigint as n_rows, (select sum(degree) from nodes)::bigint as degree,
  (select sum(huff_count) from split)::bigint as huff_count, bits_hi as bit_count from cost"""


def block_bytes(name: str, pct: float, block: int = 1024) -> str:
    return graph(name, ranked(pct) + ",\n" + _SPLIT) + f"""select block_id, bits_lo, (bits_lo + 7) // 8 as lo_bytes, n_rows, n_arcs
from (select id // {block} as block_id, sum(low_count * fallback_bits)::bigint as bits_lo, count(*)::bigint as n_rows, sum(degree)::bigint as n_arcs from (nodes join split on row_id = id), fb group by 1)"""


_TWO = "select distinct a.vertex as row_id, b.vertex as nbr from arcs a join arcs b using (edge)"


def bipartite_bfs(name: str, src: int) -> str:
    return graph(name, _reach([src], _TWO), recursive=True) + "select v.id, f.dist::int as dist from vertices v left join found f on f.id = v.id"


def bipartite_components(name: str) -> str:
    """Smallest labels passed on round by round for as long as one changes."""
    return graph(name, f"""two as materialized ({_TWO}),
label(t, id, low) as (select 0, id, id from vertices union all
  select t + 1, id, new from (select l.t, l.id, least(l.low, coalesce(m.low, l.low)) as new, bool_or(coalesce(m.low, l.low) < l.low) over () as moved
    from label l left join (select two.nbr as id, min(k.low) as low from label k join two on two.row_id = k.id group by 1) m on m.id = l.id) where moved),
last as materialized (select id, low from label where t = (select max(t) from label))""", recursive=True) + """select 'vertex' as kind, id::bigint as id, low::bigint as component from last
union all select 'hyperedge', e.id::bigint, min(l.low)::bigint from edges e left join arcs a on a.edge = e.id left join last l on l.id = a.vertex group by e.id"""


def bipartite_pagerank(name: str, iters: int, alpha: float = 0.85) -> str:
    parts = ["size as materialized (select edge, count(*) as size from arcs group by edge), deg as materialized (select v.id, count(a.vertex) as degree from vertices v left join arcs a on a.vertex = v.id group by v.id)",
             "p0 as materialized (select id, degree, 1.0::double / nv as pr from deg, dims)"]
    for i in range(1, iters + 1):
        parts.append(f"""h{i} as materialized (select edge, sum(pr / degree) / any_value(size) as h from arcs join p{i - 1} p on p.id = vertex join size using (edge) group by edge),
p{i} as materialized (select p.id, p.degree, (1 - {alpha}::double) / nv + {alpha}::double * (coalesce(s.s, 0) + d.d / nv) as pr from p{i - 1} p
  left join (select vertex as id, sum(h) as s from arcs join h{i} using (edge) group by 1) s on s.id = p.id, (select coalesce(sum(pr) filter (degree = 0), 0) as d from p{i - 1}) d, dims)""")
    return graph(name, ",\n".join(parts)) + f"select id, round(pr, 10) as pr from p{iters}"


def bipartite_kcore(name: str, k: int) -> str:
    return graph(name, f"""peel(t, edge, vertex) as (select 0, edge, vertex from (select distinct edge, vertex from arcs) union all
  select t + 1, edge, vertex from (select p.t, p.edge, p.vertex, count(*) over () as c from peel p where p.edge in (select edge from peel group by edge having count(*) >= 2)
      and p.vertex in (select vertex from peel where edge in (select edge from peel group by edge having count(*) >= 2) group by vertex having count(*) >= {k}))
  where c < (select count(*) from peel)),
last as materialized (select edge, vertex from peel where t = (select max(t) from peel)),
live as materialized (select edge from last group by edge having count(*) >= 2),
kept as materialized (select vertex from last where edge in (select edge from live) group by vertex having count(*) >= {k})""", recursive=True) + "select id, id in (select vertex from kept) as in_core from vertices"
