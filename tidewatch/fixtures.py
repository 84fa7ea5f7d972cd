"""Views in the engine's input shapes over the driver's tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .storage import spread

AS_OF = "2024-01-31 00:00:00"
TABLES = {"fx_event": ("events", "nation"), "fx_source": ("events",), "fx_event_source": ("events",), "fx_headline": ("documents",), "fx_fix": ("events",), "fx_grid": ("orders",), "fx_landing": ("orders", "customer", "nation"), "fx_page": ("pages",), "fx_pipeline": ("supplier", "nation"), "fx_port": ("customer", "nation"), "fx_route": ("customer", "nation"), "fx_dependent": ("supplier", "nation")}

VIEWS = {
    "fx_event": """select event_id as id,
 concat('x-', cast(case when event_id % 4 = 3 then event_id - 1 else event_id end as varchar(20))) as external_id,
 concat('Report ', event_id) as title,
 case event_type when 'error' then 'explosion' when 'signup' then 'drone' when 'purchase' then 'missile'
                 when 'click' then 'airstrike' else case when event_id % 2 = 0 then 'alert' else 'fire' end end as event_type,
 cast(1 + cast(regexp_extract(props,'([0-9]+)',1) as bigint) % 5 as int) as severity,
 cast((cast(regexp_extract(props,'([0-9]+)',1) as bigint)*7) % 101 as int) as confidence_score,
 case event_id % 3 when 0 then 'exact' when 1 then 'approximate' else 'area' end as geolocation_precision,
 cast(12 as double) + cast((event_id*37) % 3000 as double)/100 as latitude,
 cast(25 as double) + cast((event_id*53) % 4000 as double)/100 as longitude,
 n_name as country, ts as occurred_at, event_id % 20 <> 0 as is_active
from {events} join {nation} on user_id % 25 = n_nationkey""",
    "fx_source": """select source_id, concat('name', source_id) as name,
 case source_id % 5 when 0 then 'news' when 1 then 'social' when 2 then 'satellite' when 3 then 'manual' else 'api' end as source_type,
 case when source_id % 50 = 0 then null else concat('http://s', source_id % 400, '/a') end as url,
 cast((source_id*13) % 101 as int) as reliability_score, first_ts as created_at
 from (select event_id % 500 as source_id, min(ts) as first_ts from {events} group by event_id % 500) q""",
    "fx_event_source": """select event_id, event_id % 500 as source_id from {events}
 union select event_id, (event_id*7+1) % 500 as source_id from {events} where event_id % 3 = 0""",
    "fx_headline": """select id, concat(phrase, case when id % 2 = 1 then concat(' ', body) else '' end) as title, case when id % 2 = 0 then body else '' end as description, concat(phrase, ' ', body) as story,
 source, tier, link, published_at from (select doc_id as id, case case when doc_id < 200 and doc_id % 2 = 0 then 0 else doc_id % 12 end
 when 0 then 'BREAKING: missile strike reported near Tehran' when 1 then 'Drone attack hits oil refinery in Iraq, casualties feared'
 when 2 then 'Ceasefire talks resume in Cairo' when 3 then 'Quarterly earnings lift shares of startup'
 when 4 then 'Large explosion in Beirut port, dozens killed' when 5 then 'Protest and clashes in Baghdad after curfew'
 when 6 then 'NATO summit discusses sanctions on Russia' when 7 then 'Earthquake strikes near coast, tsunami warning'
 when 8 then 'Opinion: what the Suez Canal means' when 9 then 'CVE-2024-12345 exploited by APT28 in data breach'
 when 10 then 'Airstrikes continue over Gaza, air raid sirens in Tel Aviv' else 'Troops deployed to border, minor incident' end as phrase, replace(text, chr(10), ' ') as body, source, cast(1 + cast(substr(source,4) as int) % 4 as int) as tier,
 concat('http://', source, '.example.org/', doc_id) as link, cast('2024-01-31 00:00:00' as {ts})
  - case when doc_id < 200 then doc_id * 30 else 6000 + (doc_id - 200) * 600 end * interval '1' second as published_at
 from {documents}) q""",
    "fx_fix": """select event_id as fix_id, user_id % 40 as object_id, case event_id % 2 when 0 then 'aircraft' else 'vessel' end as kind,
 cast(12 as double) + cast((event_id*37) % 3000 as double)/100 as lat, cast(25 as double) + cast((event_id*53) % 4000 as double)/100 as lon, ts as updated_at from {events}""",
    "fx_grid": """select cast(12 + o_orderkey % 30 as double) + 0.5 as lat, cast(25 + o_orderkey % 40 as double) + 0.5 as lon, sum(cast(floor(o_totalprice) as bigint)) as population
 from {orders} group by 1, 2""",
    "fx_landing": """select concat('cable', c_custkey % 60) as cable_id, n_name as country,
 cast(1 + count(*) % 9 as double) / 10 as capacity_share, count(*) % 2 = 0 as redundant
 from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
 group by 1, 2""",
    "fx_pipeline": """select distinct concat('pipe', s_suppkey % 50) as pipeline_id, n_name as country from {supplier} join {nation} on s_nationkey = n_nationkey""",
    "fx_port": """select concat('port', n) as port_id, country, case n % 6 when 0 then 'oil' when 1 then 'lng' when 2 then 'container' when 3 then 'mixed' when 4 then 'naval' else 'ferry' end as kind, cast(1 + n % 30 as int) as rank,
 cast(12 + n % 30 as double) + 0.5 as p_lat, cast(40 + n % 25 as double) + 0.25 as p_lon
 from (select c_custkey % 97 as n, min(n_name) as country from {customer} join {nation} on c_nationkey = n_nationkey group by 1) q""",
    "fx_route": """select concat('port', c_custkey % 97) as port_id, n_name as country, cast(1 + count(*) % 9 as double) / 10 as strength from {customer} join {nation} on c_nationkey = n_nationkey group by 1, 2""",
    "fx_dependent": """select concat('h', 1 + s_suppkey % 4) as chokepoint_id, n_name as country, cast(1 + count(*) % 9 as double) / 10 as strength, cast(count(*) % 4 as double) / 10 as redundancy
 from {supplier} join {nation} on s_nationkey = n_nationkey group by 1, 2""",
    "fx_page": """select page_id, url, html, concat('<meta property="og:image" content="http://img.example/', page_id, '.png">') as head from {pages}""",
    "fx_box": """select cast(seq as int) as seq, country, cast(min_lat as double) as min_lat, cast(max_lat as double) as max_lat,
 cast(min_lon as double) as min_lon, cast(max_lon as double) as max_lon from (values
  (1,'BOX_A',31.2,31.6,34.2,34.6),
  (2,'BOX_B',29.0,37.4,38.8,48.7),
  (3,'BOX_C',25.0,39.8,44.0,63.3),
  (4,'BOX_D',12.0,19.0,42.0,54.0)) as t(seq,country,min_lat,max_lat,min_lon,max_lon)""",
    "fx_hotspot": """select id, name, cast(lat as double) as lat, cast(lon as double) as lon, status from (values
  ('h1','Alpha',26.5,56.2,'active'),
  ('h2','Bravo',33.3,44.4,'monitoring'),
  ('h3','Charlie',15.3,44.2,'active'),
  ('h4','Delta',35.7,51.4,'stable')) as t(id,name,lat,lon,status)""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables below sf_dir."""
    sql = VIEWS[name].replace("{ts}", "timestamp_ntz").replace("varchar(20)", "string")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES.get(name, ())}
    if "documents" in tables:
        tables["documents"] = spread(tables["documents"].select("doc_id", "text", "source"))
    return spark.sql(sql, **tables)


def with_views(*names: str) -> str:
    """The head of a DuckDB statement that defines views."""
    plain = {t: t for tables in TABLES.values() for t in tables} | {"ts": "timestamp"}
    return "with " + ",\n".join(f"{n} as ({VIEWS[n].format(**plain)})" for n in names)
