"""The query catalogue: a Spark callable per operator and, where SQL can say it, the same in plain SQL.

The SQL side defines the stand-in views itself, so it shares nothing with the Spark side but the tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

VIEWS = {
    "tiles": "select o_orderkey as tile, o_custkey as slide, o_orderkey % 3 as sample from orders",
    "ftiles": """select *, case when slide % 10 = 0 then 'test' when slide % 10 < 3 then 'val' else 'train' end as fold from tiles""",
    "slides": "select o_custkey as slide, 6144 as w, 4096 as h, count(*) as n_tiles from orders group by o_custkey",
    "objs": """select l_orderkey as tile, slide, sample, case l_returnflag when 'N' then 0 when 'A' then 1 else 2 end as class
        from lineitem join tiles on tile = l_orderkey""",
    "boxes": """select tile, slide, obj, class, x0, y0, w, h, x0 + (tile % 3) * 2048 as sx0, y0 + (tile % 2) * 2048 as sy0
        from (select l_orderkey as tile, o_custkey as slide, rn as obj,
                     case l_returnflag when 'N' then 0 when 'A' then 1 else 2 end as class,
                     (l_partkey * 37 + l_suppkey * 101 + rn * 911) % 1500 as x0,
                     (l_partkey * 53 + l_suppkey * 71 + rn * 577) % 1500 as y0,
                     32 + cast(l_quantity as int) * 8 as w,
                     32 + (l_partkey * 7 + rn * 13) % 400 as h
              from (select *, row_number() over (partition by l_orderkey
                           order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as rn from lineitem) l
              join orders on o_orderkey = l_orderkey) b""",
    "nboxes": """select tile, slide, obj, class, (x0 + w / 2.0) / 2048 as xc, (y0 + h / 2.0) / 2048 as yc, w / 2048.0 as w, h / 2048.0 as h
        from (select tile, slide, obj, class, x0::double as x0, y0::double as y0, w::double as w, h::double as h from boxes) b""",
    "preds": """select tile, slide, obj as pred, x0 + (tile * 7 + obj) % 61 - 30 as x0, y0 + (tile * 11 + obj) % 61 - 30 as y0,
               w::bigint as w, h, ((tile * 31 + obj * 17) % 1000)::double / 1000.0::double as conf from boxes where (tile + obj) % 10 <> 0
        union all
        select tile, slide, obj + 1000000000000, 1900, 1900, 100, 100, ((tile * 13 + obj) % 1000)::double / 1000.0::double from boxes where (tile + obj) % 11 = 0""",
    "rects": """select slide, k as sample_n, k * 2048 as x0, 0 as y0, (k + 1) * 2048 as x1, 4096 as y1
        from slides cross join (values (0), (1), (2)) t(k)""",
    "vertices": """select tile, slide, obj, class, k as ord, sx0 + cast(floor(w * fx / 2.0) as bigint) as x, sy0 + cast(floor(h * fy / 2.0) as bigint) as y
        from boxes cross join (values (0,0,0),(1,1,0),(2,2,0),(3,2,1),(4,2,2),(5,1,2),(6,0,2),(7,0,1),(8,0,0)) t(k, fx, fy)""",
    "instances": """select vec_id as instance, case when vec_id < 200 then 1000 + vec_id // 8 else vec_id % 25 end as slide,
               label % 3 as class, embedding from embeddings""",
    "elements": """select instance, slide, class, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as dim from instances""",
    "runs": "select user_id as exp, event_id, ts, event_type as status, value from events",
    "epochs": """select exp, row_number() over (partition by exp order by ts, event_id) as epoch, value as "precision",
               (event_id % 100)::double / 100.0::double as recall from runs""",
    "names": """select *, 'S' || slide || '_PAS_sample' || sample || '_' || (tile % 7) || '_' || (tile % 5) as name from ftiles""",
    "statuses": """select t.tile, t.slide, t.sample, t.fold, t.tile not in (select tile from objs) as is_empty from ftiles t""",
    "matches": """select p.*, b.obj, b.class, b.n_matches from preds p left join (
            select tile, pred, obj, class, n_matches from (
                select p.tile, p.pred, b.obj, b.class, count(*) over (partition by p.tile, p.pred) as n_matches,
                       row_number() over (partition by p.tile, p.pred order by
                           power(p.x0 + p.w / 2.0 - (b.x0 + b.w / 2.0), 2) + power(p.y0 + p.h / 2.0 - (b.y0 + b.h / 2.0), 2), b.obj) as r
                from preds p join boxes b on b.tile = p.tile
                 and p.x0 + p.w / 2.0 between b.x0 and b.x0 + b.w and p.y0 + p.h / 2.0 between b.y0 and b.y0 + b.h) where r = 1
        ) b using (tile, pred)""",
    "verdicts": """select tile, pred, coalesce(class, 3)::int as truth, ((tile * 5 + pred * 3) % 4)::int as predicted from matches""",
    "bagrank": """select instance, slide, class, row_number() over (partition by slide order by md5(concat(instance, ':10')), instance) as rank,
               count(*) over (partition by slide) as size from instances""",
    "bags": """select slide, instance, (rank - 1) // 9 as bag_n, ((rank - 1) % 9)::int as ord from bagrank
        union all
        select slide, instance, size // 9, (size % 9 + r - 1)::int from (
            select *, row_number() over (partition by slide order by md5(concat(instance, ':10b')), instance) as r
            from bagrank where size % 9 > 0 and rank <= size - size % 9) where r <= 9 - size % 9""",
    "kbags": "select concat_ws('_', slide, bag_n) as bag, * from bags",
    "ilabels": """select slide, least(floor(u::double / (h + u) * 4), 3)::int as label from (
            select slide, count(*) filter (class = 0) as h, count(*) filter (class = 1) as u from instances group by slide) where h + u > 0""",
    "lbags": "select bag, b.slide, label from (select bag, min(slide) as slide from kbags group by bag) b join ilabels using (slide)",
    "bagelements": "select bag, e.* from kbags join elements e using (instance)",
}


def with_views(body: str) -> str:
    """Put the views a statement uses in front of it, each after the ones it needs itself."""
    order: list[str] = []

    def need(text: str, own: str | None = None) -> None:
        for name in VIEWS:
            if name != own and re.search(rf"\b{name}\b", text) and name not in order:
                need(VIEWS[name], name)
                order.append(name)

    need(body)
    head = ", ".join(f"{n} as ({VIEWS[n]})" for n in order)
    lead = re.match(r"\s*with\s+", body)
    if lead and head:
        return f"with {head}, {body[lead.end():]}"
    return f"with {head} {body}" if head else body


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_views(sql)
        return fn

    return register
