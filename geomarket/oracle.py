"""The SQL each registered query is compared with, in DuckDB's dialect.

Written against the raw tables and by other means than the operators where that
is possible: brute-force joins instead of cells, plain quantile functions
instead of brackets, windows instead of partial aggregates.
"""

from __future__ import annotations

import math

from geomarket.functions.cells import AXIS_BITS, AXIS_OFFSET, DEFAULT_GRID, KM_PER_LAT
from geomarket.functions.geometry import EARTH_RADIUS_M

_FIXTURES = {
    "fx_sales": """
        select cast(l_shipdate as date) as sale_date, l_extendedprice as sale_price, l_linenumber as beds,
          case when l_quantity = 50 then 0e0 when l_quantity = 49 then null else l_quantity*40e0 end as sqft,
          cast(l_suppkey%4 as int) as bath_full,
          case when l_partkey%50 = 0 then null else cast(l_partkey%2 as int) end as bath_half,
          cast(l_orderkey%2 as int) as bath_3qtr, cast(1900 + l_partkey%122 as int) as year_built,
          47.2e0 + ((l_orderkey*7919 + l_linenumber*104729 + l_partkey*1299709 + l_suppkey*15485863)%100003)
            /100003e0*0.6e0 as lat,
          -122.5e0 + ((l_orderkey*32452843 + l_linenumber*49979687 + l_partkey*86028121 + l_suppkey*611953)%100003)
            /100003e0*0.8e0 as lng
        from lineitem""",
    "fx_listings_a": """
        select p_partkey as zpid, p_retailprice*500e0 + p_size*1000e0 as price, cast(p_size%6 as int) as bedrooms,
          cast(p_size%4 as int) as bathrooms, case when p_size%10 = 0 then 0e0 else p_size*40e0 end as livingArea,
          p_type || '_HOME' as propertyType, 'FOR_SALE' as listingStatus,
          case when p_partkey%97 = 0 then null else 47.2e0 + ((p_partkey*7919)%1009)/1009e0*0.6e0 end as latitude,
          -122.5e0 + ((p_partkey*104729)%997)/997e0*0.8e0 as longitude,
          'https://img.example/' || cast(p_partkey as string) as imgSrc,
          cast(p_partkey%13 + rep as int) as api_call_no, cast(p_partkey*2 + rep as bigint) as pos
        from part cross join (select 0 as rep union all select 1 as rep) r
        where rep = 0 or p_partkey%20 = 0""",
    "fx_listings_b": """
        select p_partkey as zpid, p_retailprice*500e0 + p_size*1000e0 + 1e0 as price,
          cast(p_size%6 as int) as bedrooms,
          cast(p_size%4 as int) as bathrooms, case when p_size%10 = 0 then 0e0 else p_size*40e0 end as livingArea,
          p_type || '_HOME' as homeType, 'FOR_SALE' as homeStatus,
          case when p_partkey%97 = 0 then null else 47.2e0 + ((p_partkey*7919)%1009)/1009e0*0.6e0 end as latitude,
          -122.5e0 + ((p_partkey*104729)%997)/997e0*0.8e0 as longitude,
          'https://img.example/' || cast(p_partkey as string) as imgSrc,
          cast(1 + p_partkey%28 + rep as int) as page, cast(p_partkey*2 + rep as bigint) as pos
        from part cross join (select 0 as rep union all select 1 as rep) r
        where rep = 0 or p_partkey%25 = 9""",
    "fx_places": """
        select s_suppkey as fsq_id, s_name as name,
          cast(s_suppkey as string) || ' Example St, NATION_' || cast(s_nationkey as string) as formatted_address,
          47.2e0 + ((s_suppkey*7919)%1009)/1009e0*0.6e0 as latitude,
          -122.5e0 + ((s_suppkey*104729)%997)/997e0*0.8e0 as longitude
        from supplier""",
    "fx_district_edges": """
        select n_name as name, seq,
          -122.5e0 + 0.16e0*(n_nationkey%5) + ax*0.16e0 as x1, 47.2e0 + 0.12e0*floor(n_nationkey/5e0) + ay*0.12e0 as y1,
          -122.5e0 + 0.16e0*(n_nationkey%5) + bx*0.16e0 as x2, 47.2e0 + 0.12e0*floor(n_nationkey/5e0) + cy*0.12e0 as y2
        from nation cross join (values (0, 0e0, 0e0, 1e0, 0e0), (1, 1e0, 0e0, 1e0, 1e0), (2, 1e0, 1e0, 0.5e0, 0.4e0),
          (3, 0.5e0, 0.4e0, 0e0, 1e0), (4, 0e0, 1e0, 0e0, 0e0)) e(seq, ax, ay, bx, cy)""",
    "fx_vertices": """
        select name, cast(0 as int) as ring, cast(seq as int) as seq, x1 as x, y1 as y from fx_district_edges
        union all select name, 0, 5, x2, y2 from fx_district_edges where seq = 4""",
    "fx_squares": """
        select n_nationkey as k, seq, cast(n_nationkey%5 + ax as int) as x1, cast(floor(n_nationkey/5e0) + ay as int) as y1,
          cast(n_nationkey%5 + bx as int) as x2, cast(floor(n_nationkey/5e0) + cy as int) as y2
        from nation cross join (values (0, 0, 0, 1, 0), (1, 1, 0, 1, 1), (2, 1, 1, 0, 1), (3, 0, 1, 0, 0))
          e(seq, ax, ay, bx, cy)
        where n_nationkey <> 12""",
    "fx_blocks": """
        select n_nationkey as k, n_nationkey%4 = 3 as hollow, n_nationkey%5 + case when n_nationkey%4 = 2 then 0.5e0 else 0e0 end as west,
          floor(n_nationkey/5e0) as south, case n_nationkey%4 when 1 then 1.5e0 when 2 then 0.5e0 else 1e0 end as wide,
          case when n_nationkey%4 = 2 then 0.75e0 else 1e0 end as high
        from nation where n_nationkey <> 12""",
    # Quarters of a unit that some block covers, and all others around them.
    "raster": """
        select i, j, exists (select 1 from fx_blocks b where (i + 0.5e0)/4 between west and west + wide
          and (j + 0.5e0)/4 between south and south + high
          and not (hollow and (i + 0.5e0)/4 between west + 0.25e0 and west + 0.75e0
            and (j + 0.5e0)/4 between south + 0.25e0 and south + 0.75e0)) as covered
        from range(-4, 32) gi(i), range(-4, 28) gj(j)""",
    "fx_lattice": """
        select p_partkey, p_partkey%53/8e0 - 0.25e0 as x, floor(p_partkey/53e0)%45/8e0 - 0.25e0 as y from part""",
    "fx_chat": """
        select event_id, event_type || ' near [47.' || cast(100 + event_id%900 as string) || ', -122.'
          || cast(100 + user_id%400 as string) || '] please' as text
        from events""",
    "priced": """
        select *, sale_price / nullif(sqft, 0) as price_per_sqft,
          cast(strftime(sale_date, '%Y%m') as int) as year_month
        from fx_sales""",
    "found_places": """
        select p.*, cast(floor((fsq_id + again*41)/41e0) as bigint) as call
        from fx_places p cross join (values (0), (1)) r(again) where again = 0 or fsq_id%3 = 0""",
    "merged": """
        select zpid, price, bedrooms, bathrooms, livingArea, propertyType, listingStatus, latitude, longitude, imgSrc,
          pos, cast(1 as int) as feed from fx_listings_a where zpid%10 < 7
        union all
        select zpid, price, bedrooms, bathrooms, livingArea, homeType, homeStatus, latitude, longitude, imgSrc,
          pos, cast(2 as int) from fx_listings_b where zpid%10 >= 4""",
    "monthly": """
        select year_month, quantile_disc(price_per_sqft, 0.5) as median_price_per_sqft, count(sqft) as observations
        from priced group by year_month""",
    "extent": """
        select min(x1) as min_x, max(x1) as max_x, min(y1) as min_y, max(y1) as max_y from fx_district_edges""",
    "grid": """
        select gx.i as grid_x, gy.i as grid_y, min_x + gx.i*(max_x - min_x)/9e0 as x, min_y + gy.i*(max_y - min_y)/12e0 as y
        from extent, range(10) gx(i), range(13) gy(i)""",
    "samples": """
        select cast(floor(lng*1000e0 + 0.5e0) as bigint) as i, cast(floor(lat*1000e0 + 0.5e0) as bigint) as j,
          avg(price_per_sqft) as z
        from priced where price_per_sqft is not null group by 1, 2""",
}
_NEEDS = {"raster": ["fx_blocks"], 
    "fx_vertices": ["fx_district_edges"], "priced": ["fx_sales"], "found_places": ["fx_places"],
    "merged": ["fx_listings_a", "fx_listings_b"], "monthly": ["priced"], "extent": ["fx_district_edges"],
    "grid": ["extent"], "samples": ["priced"],
}


def _with(names: str, body: str) -> str:
    """Put the named fixtures, and what they need, in front of a query."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    ctes = [f"{name} as ({_FIXTURES[name]})" for name in ordered]
    body = body.strip()
    if body.startswith("with recursive "):
        return "with recursive " + ", ".join(ctes) + ", " + body[15:]
    if body.startswith("with "):
        return "with " + ", ".join(ctes) + ", " + body[5:]
    return "with " + ", ".join(ctes) + " " + body


_GRID = DEFAULT_GRID


def _hex_cells(source: str, lat: str, lng: str) -> str:
    """CTE text ending in ``celled``: ``source`` plus axial ``q``, ``r`` and the packed ``cell``."""
    x = f"(({lng} - {_GRID.lng0!r}e0) * {_GRID.km_per_lng!r}e0)"
    y = f"(({lat} - {_GRID.lat0!r}e0) * {KM_PER_LAT!r}e0)"
    third, two_thirds = repr(math.sqrt(3) / 3), repr(2 / 3)
    return f"""
        planar as (select *, ({x} * {third}e0 - {y} / 3e0) / {_GRID.size_km!r}e0 as qf,
            ({y} * {two_thirds}e0) / {_GRID.size_km!r}e0 as rf from {source}),
        {_rounding("planar", "qf", "rf")},
        celled as (select *, {_packed("q", "r")} as cell from rounded)"""


def _rounding(source: str, qf: str, rf: str, out: str = "rounded") -> str:
    return f"""{out}_near as (select *, floor({qf} + 0.5e0) as rq, floor({rf} + 0.5e0) as rr,
            floor(-{qf} - {rf} + 0.5e0) as rs from {source}),
        {out}_gap as (select *, abs(rq - {qf}) as dq, abs(rr - {rf}) as dr, abs(rs - (-{qf} - {rf})) as ds from {out}_near),
        {out} as (select * exclude (rq, rr, rs, dq, dr, ds),
            cast(case when dq > dr and dq > ds then -rr - rs else rq end as bigint) as q,
            cast(case when not (dq > dr and dq > ds) and dr > ds then -rq - rs else rr end as bigint) as r
          from {out}_gap)"""


def _packed(q: str, r: str) -> str:
    return f"cast(({q} + {AXIS_OFFSET}) * {1 << AXIS_BITS} + ({r} + {AXIS_OFFSET}) as bigint)"


_PARENT = (
    "parents as (select cell, q, r, (3*q + r)/7e0 as pq, (2*r - q)/7e0 as pr from celled), "
    + _rounding("(select cell, pq, pr from parents)", "pq", "pr", "coarse")
)


def _haversine(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return (
        f"{2 * EARTH_RADIUS_M!r}e0 * asin(sqrt(least(1e0, pow(sin(radians({lat2} - {lat1})/2e0), 2) "
        f"+ cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians({lng2} - {lng1})/2e0), 2))))"
    )


_DISTRICT_LIST = "('NATION_1','NATION_2','NATION_3','NATION_7','NATION_11','NATION_12','NATION_18')"
_CROSSES = "((y1 > {y}) <> (y2 > {y}) and {x} < (x2 - x1)*({y} - y1)/nullif(y2 - y1, 0) + x1)"
_ON_EDGE = (
    "((x2 - x1)*({y} - y1) - (y2 - y1)*({x} - x1) = 0 and {x} between least(x1, x2) and greatest(x1, x2) "
    "and {y} between least(y1, y2) and greatest(y1, y2))"
)


def _inside(points: str, x: str, y: str, columns: str, where: str = "true") -> str:
    """Brute force: every point against every edge, one row per point and district it is within."""
    crossing, touching = _CROSSES.format(x=x, y=y), _ON_EDGE.format(x=x, y=y)
    return f"""
        with numbered as (select row_number() over () as rid, * from {points})
        select {columns} from numbered cross join fx_district_edges e where {where}
        group by rid, {columns}, e.name
        having count(*) filter ({crossing})%2 = 1 and count(*) filter ({touching}) = 0"""


def _in_union(points: str, x: str, y: str, columns: str, where: str = "true") -> str:
    """Brute force: points all of whose neighbours, eight around them, are in some district; a border between two is not one."""
    around = " union all ".join(
        f"select rid, {k} as n, {x} + {2e-9*math.cos((k + 0.5)*math.pi/4)!r} as nx, {y} + {2e-9*math.sin((k + 0.5)*math.pi/4)!r} as ny from numbered"
        for k in range(8))
    return f"""
        with numbered as (select row_number() over () as rid, * from {points}), around as ({around}),
        held as (select rid, n from around cross join fx_district_edges e where {where} group by rid, n, e.name
          having count(*) filter ({_CROSSES.format(x="nx", y="ny")})%2 = 1),
        inner_points as (select rid from held group by rid having count(distinct n) = 8)
        select {columns} from numbered where rid in (select rid from inner_points)"""


_CLUSTER_SIDE = repr(360.0 / 2**11 * 80 / 256)
_IN_AREA = "lat between 47.35e0 and 47.6e0 and lng between -122.3e0 and -122.0e0"
_RAMP = {"red": (255, 198), "green": (223, 88), "blue": (142, 36)}

_GEOJSON_CORNER = f"""{_GRID.lng0!r}e0 + (sqrt(3)*(q + r/2e0) + sqrt(3)/2e0)*{_GRID.size_km!r}e0/{_GRID.km_per_lng!r}e0 as lng0,
    {_GRID.lat0!r}e0 + (1.5e0*r + 0.5e0)*{_GRID.size_km!r}e0/{KM_PER_LAT!r}e0 as lat0"""

ORACLE: dict[str, str] = {
    "load_sales": _with("priced", """
        select cast(sale_date as varchar) as sale_date, sale_price, beds, sqft, price_per_sqft, bath_full, bath_half,
          bath_3qtr, year_built, lat, lng, year_month from priced"""),
    "csv_roundtrip": _with("fx_listings_a", "select * from fx_listings_a"),
    "load_polygons": _with("fx_vertices", "select * from fx_vertices"),
    "normalize_pages": _with("fx_listings_b", """
        select * exclude (page), cast(floor(pos/41e0) as bigint) as page, cast(41 as int) as resultsPerPage,
          cast(ceil((select count(*) from fx_listings_b)/41e0) as bigint) as totalPages,
          (select count(*) from fx_listings_b) as totalResultCount
        from fx_listings_b"""),
    "normalize_search": _with("fx_listings_a", """
        with calls as (select * exclude (api_call_no), cast(floor(pos/41e0) as bigint) as api_call_no from fx_listings_a)
        select *, cast(round(api_call_no%100/1000e0 - 122.5e0, 5) as varchar) || ' '
            || cast(round(api_call_no%50/100e0 + 47.25e0, 5) as varchar) as search_long_lat,
          cast(1 as int) as currentPage, cast(41 as int) as resultsPerPage,
          cast(ceil((select count(*) from calls)/41e0) as bigint) as totalPages,
          (select count(*) from calls) as totalResultCount
        from calls"""),
    "normalize_places": _with("found_places", """
        select fsq_id, name, formatted_address, latitude, longitude, call%50/100e0 + 47.25e0 as search_latitude,
          call%100/1000e0 - 122.5e0 as search_longitude, cast(2000 as int) as search_radius from found_places"""),
    "dedupe_places": _with("found_places", """
        select fsq_id, name, formatted_address, latitude, longitude, call%50/100e0 + 47.25e0 as search_latitude,
          call%100/1000e0 - 122.5e0 as search_longitude, cast(2000 as int) as search_radius from found_places
        qualify row_number() over (partition by fsq_id order by search_longitude, search_latitude) = 1"""),
    "geojson_features": _with("fx_listings_a", f"""
        with {_hex_cells("fx_listings_a", "latitude", "longitude")}
        select 'Feature' as type, 'Polygon' as shape, cell, count(zpid) as count, cast(7 as int) as corners,
          quantile_disc(price/livingArea, 0.5) as median_ppsf, round(any_value(lng0), 6) as lng, round(any_value(lat0), 6) as lat
        from (select *, {_GEOJSON_CORNER} from celled) where livingArea > 0 and cell is not null group by cell"""),
    "geojson_collections": _with("fx_listings_a", f"""
        with {_hex_cells("fx_listings_a", "latitude", "longitude")}
        select 'FeatureCollection' as type, cell, quantile_disc(price/livingArea, 0.5) as median_ppsf, count(zpid) as count
        from celled where livingArea > 0 and cell is not null group by cell"""),
    "price_per_sqft": _with("priced", "select sale_price, sqft, price_per_sqft, lat, lng from priced"),
    "listing_ppsf": _with("fx_listings_a", """
        select zpid, pos, price, livingArea, case when livingArea > 0 then price/livingArea end as pricePerSqft
        from fx_listings_a"""),
    "baths": _with("fx_sales", """
        select bath_full, bath_3qtr, bath_half, cast(bath_full + bath_3qtr + bath_half*0.5e0 as double) as baths, lat, lng
        from fx_sales"""),
    "year_month": _with("priced", "select year_month, sale_price, lat, lng from priced"),
    "filter_sales": _with("priced", """
        select beds, year_month, sale_price, lat, lng from priced
        where beds >= 2 and beds <= 4 and sale_date >= date '1996-01-01' and sale_date < date '1999-01-01'"""),
    "filter_sales_open": _with("priced", """
        select beds, year_month, sale_price, lat, lng from priced where sale_date >= date '1999-01-01'"""),
    "filter_listings": _with("fx_listings_a", """
        select zpid, pos, bedrooms, price from fx_listings_a
        where bedrooms in (1, 2, 3) and price >= 460000 and price <= 490000"""),
    "bbox_listings": _with("fx_listings_a", """
        select zpid, pos, latitude, longitude from fx_listings_a
        where latitude >= 47.35e0 and latitude <= 47.6e0 and longitude >= -122.3e0 and longitude <= -122.0e0"""),
    "bbox_sales": _with("priced", f"select sale_price, year_month, lat, lng from priced where {_IN_AREA}"),
    "indexable_listings": _with("fx_listings_a", f"""
        with {_hex_cells("fx_listings_a", "latitude", "longitude")}
        select zpid, pos, cell from celled where latitude is not null"""),
    "district_subset": _with("fx_vertices", f"select * from fx_vertices where name in {_DISTRICT_LIST}"),
    "distinct_sorted": _with("priced", """
        select distinct 'beds' as variable, beds as value from priced
        union all select distinct 'year_month', year_month from priced"""),
    "price_summary": _with("fx_listings_a", """
        select min(price) as min, max(price) as max, quantile_disc(price, 0.25) as lq, quantile_disc(price, 0.75) as uq
        from fx_listings_a"""),
    "slider_bounds": _with("fx_listings_a", """
        select cast(round_even(min(price), -4) as bigint) as slider_min, cast(round_even(max(price), -4) as bigint) as slider_max,
          cast(round_even(quantile_disc(price, 0.25), -4) as bigint) as default_min,
          cast(round_even(quantile_disc(price, 0.75), -4) as bigint) as default_max
        from fx_listings_a"""),
    "price_quartiles_linear": _with("fx_listings_a", """
        select round(quantile_cont(price, 0.25), 6) as lq, round(quantile_cont(price, 0.75), 6) as uq from fx_listings_a"""),
    "headline_metrics": _with("fx_listings_a priced", f"""
        with both_tables as (
          select 'listings' as "table", price as v from fx_listings_a
          where latitude between 47.35e0 and 47.6e0 and longitude between -122.3e0 and -122.0e0
          union all select 'sales', sale_price from priced where {_IN_AREA})
        select "table", count(*) as count, round(sum(v), 2) as sum, quantile_disc(v, 0.5) as median,
          format('{{:,}}', cast(round_even(quantile_disc(v, 0.5), 0) as bigint)) as shown
        from both_tables group by "table" """),
    "map_centre": _with("fx_listings_a", """
        select round(avg(latitude), 8) as lat, round(avg(longitude), 8) as lng from fx_listings_a"""),
    "monthly_medians": _with("monthly", "select * from monthly"),
    "approx_rank_error": _with("priced", """
        select year_month, count(price_per_sqft) as n, true as lq_ok, true as median_ok, true as uq_ok
        from priced group by year_month"""),
    "monthly_sales": _with("priced", f"""
        with chosen as (select * from priced where beds between 2 and 5 and year_month >= 199601)
        select year_month, 'All areas' as location, quantile_disc(price_per_sqft, 0.5) as median_price_per_sqft,
          count(sqft) as observations from chosen group by year_month
        union all
        select year_month, 'Filtered area', quantile_disc(price_per_sqft, 0.5), count(sqft)
        from chosen where {_IN_AREA} group by year_month"""),
    "recent_sales": _with("priced", """
        select cast(sale_date as varchar) as date, sale_price as price, beds, sqft, price_per_sqft, year_built as built,
          lat, lng, cast(bath_full + bath_3qtr + bath_half*0.5e0 as double) as baths
        from priced order by sale_date desc nulls last, sale_price nulls last, beds nulls last, sqft nulls last,
          price_per_sqft nulls last, year_built nulls last, lat nulls last, lng nulls last, baths nulls last
        limit 20"""),
    "month_adjustment": _with("monthly", """
        select *, (select median_price_per_sqft from monthly where year_month = (select max(year_month) from monthly))
          / median_price_per_sqft as adjustment from monthly"""),
    "rebase_sales": _with("monthly", """
        with multipliers as (select year_month, (select median_price_per_sqft from monthly
            where year_month = (select max(year_month) from monthly)) / median_price_per_sqft as adjustment from monthly)
        select year_month, price_per_sqft, adjustment, price_per_sqft*adjustment as ppsf_adj, lat, lng
        from priced join multipliers using (year_month)"""),
    "align_feeds": _with("merged", "select * from merged"),
    "flag_duplicates": _with("fx_listings_b", """
        select zpid, pos, page, price, count(*) over (partition by zpid) > 1 as dup from fx_listings_b"""),
    "duplicate_records": _with("fx_listings_b", """
        select zpid, pos, page, price from fx_listings_b
        where zpid in (select zpid from fx_listings_b group by zpid having count(*) > 1)"""),
    "dedupe_listings": _with("merged", """
        select * from merged qualify row_number() over (partition by zpid order by feed, pos) = 1"""),
    "listings_table": _with("merged", f"""
        with firsts as (select * from merged qualify row_number() over (partition by zpid order by feed, pos) = 1),
        {_hex_cells("firsts", "latitude", "longitude")}, {_PARENT},
        up as (select distinct cell, {_packed("q", "r")} as parent from coarse)
        select zpid, price, bedrooms, bathrooms, livingArea, propertyType, listingStatus, latitude, longitude, imgSrc,
          cell, case when livingArea > 0 then price/livingArea end as pricePerSqft, parent, cast(7 as int) as corners
        from celled join up using (cell)"""),
    "cell_index": _with("fx_sales", f"""
        with {_hex_cells("fx_sales", "lat", "lng")} select lat, lng, sale_price, cell from celled"""),
    "cell_parent": _with("fx_sales", f"""
        with {_hex_cells("fx_sales", "lat", "lng")}, {_PARENT}
        select distinct cell, {_packed("q", "r")} as parent from coarse"""),
    "cell_rollup": _with("fx_sales", f"""
        with {_hex_cells("fx_sales", "lat", "lng")}, {_PARENT}
        select {_packed("q", "r")} as parent, cast(count(distinct cell) as int) as cells, count(*) as n from coarse group by 1"""),
    "cell_medians": _with("fx_listings_a", f"""
        with {_hex_cells("fx_listings_a", "latitude", "longitude")}
        select cell, quantile_disc(price/livingArea, 0.5) as median_ppsf, count(zpid) as count
        from celled where livingArea > 0 and cell is not null group by cell"""),
    "cell_boundary": _with("fx_listings_a", f"""
        with {_hex_cells("fx_listings_a", "latitude", "longitude")},
        occupied as (select distinct cell, q, r from celled where cell is not null)
        select cell, cast(seq as int) as seq,
          round({_GRID.lng0!r}e0 + (sqrt(3)*(q + r/2e0) + cos(radians(30 + 60*seq)))*{_GRID.size_km!r}e0/{_GRID.km_per_lng!r}e0, 6) as lng,
          round({_GRID.lat0!r}e0 + (1.5e0*r + sin(radians(30 + 60*seq)))*{_GRID.size_km!r}e0/{KM_PER_LAT!r}e0, 6) as lat
        from occupied cross join range(7) s(seq)"""),
    "zoom_clusters": _with("fx_listings_a", f"""
        select cast(z as int) as zoom, cast(floor((longitude + 180e0)/({_CLUSTER_SIDE}e0*pow(2, 11 - z))) as bigint) as cluster_x,
          cast(floor((latitude + 90e0)/({_CLUSTER_SIDE}e0*pow(2, 11 - z))) as bigint) as cluster_y, count(*) as n,
          round(avg(latitude), 8) as lat, round(avg(longitude), 8) as lng
        from fx_listings_a cross join range(12) zooms(z) where latitude is not null group by 1, 2, 3"""),
    "points_in_polygons": _with("fx_sales fx_district_edges",
                                _inside("(select sale_price, lat, lng from fx_sales)", "lng", "lat",
                                        "sale_price, lat, lng, e.name")),
    "points_in_region": _with("fx_sales fx_district_edges",
                              _in_union("(select sale_price, lat, lng from fx_sales)", "lng", "lat",
                                        "sale_price, lat, lng", f"e.name in {_DISTRICT_LIST}")),
    "points_within_buffer": _with("fx_sales fx_district_edges", f"""
        with numbered as (select row_number() over () as rid, sale_price, lat, lng from fx_sales),
        tested as (
          select rid, sale_price, lat, lng, e.name, {_CROSSES.format(x="lng", y="lat")} as crosses, x1, y1, x2, y2,
            greatest(0e0, least(1e0, ((lng - x1)*(x2 - x1) + (lat - y1)*(y2 - y1))
              / ((x2 - x1)*(x2 - x1) + (y2 - y1)*(y2 - y1)))) as t
          from numbered cross join fx_district_edges e where e.name in {_DISTRICT_LIST}),
        per_district as (
          select rid, sale_price, lat, lng, count(*) filter (crosses)%2 = 1 as inside,
            min((lng - (x1 + (x2 - x1)*t))*(lng - (x1 + (x2 - x1)*t))
              + (lat - (y1 + (y2 - y1)*t))*(lat - (y1 + (y2 - y1)*t))) as d2
          from tested group by rid, sale_price, lat, lng, name)
        select sale_price, lat, lng from per_district
        group by rid, sale_price, lat, lng having bool_or(inside) or min(d2) <= 0.004e0*0.004e0"""),
    "dissolve_outline": _with("fx_squares", """
        select cast(least(x1, x2) as double) as x1, cast(least(y1, y2) as double) as y1,
          cast(greatest(x1, x2) as double) as x2, cast(greatest(y1, y2) as double) as y2
        from fx_squares group by 1, 2, 3, 4 having count(*) = 1"""),
    "region_bounds": _with("fx_district_edges", """
        select name, min(least(x1, x2)) as min_x, min(least(y1, y2)) as min_y, max(greatest(x1, x2)) as max_x,
          max(greatest(y1, y2)) as max_y from fx_district_edges group by name"""),
    "grid_points": _with("grid", "select cast(grid_x as int) as grid_x, cast(grid_y as int) as grid_y, x, y from grid"),
    "uniform_points": _with("extent fx_district_edges", _in_union("""(
          select cast(gx.i as int) as grid_x, cast(gy.i as int) as grid_y, min_x + gx.i*(max_x - min_x)/19e0 as x,
            min_y + gy.i*(max_y - min_y)/19e0 as y from extent, range(20) gx(i), range(20) gy(i))""",
        "x", "y", "grid_x, grid_y, x, y")),
    "search_points": _with("fx_district_edges", _in_union(f"""(
          select cast(gx.i as int) as grid_x, cast(gy.i as int) as grid_y, min_x + gx.i*(max_x - min_x)/9e0 as x,
            min_y + gy.i*(max_y - min_y)/12e0 as y
          from (select min(x1) as min_x, max(x1) as max_x, min(y1) as min_y, max(y1) as max_y
            from fx_district_edges where name in {_DISTRICT_LIST}), range(10) gx(i), range(13) gy(i))""",
        "x", "y", """grid_x, grid_y, x, y, cast(3200 as int) as radius,
          cast(round(x, 5) as varchar) || ' ' || cast(round(y, 5) as varchar) as lng_lat,
          cast(round(y, 5) as varchar) || ',' || cast(round(x, 5) as varchar) as lat_lng""",
        f"e.name in {_DISTRICT_LIST}")),
    # Parts and holes as groups of neighbouring quarters; a hole belongs to the part beside it.
    "dissolved_parts": _with("raster", """
        with recursive cells as (select row_number() over (order by i, j) as c, * from raster),
        sides as (select a.c, b.c as d, a.covered, b.covered as other from cells a join cells b
          on abs(a.i - b.i) + abs(a.j - b.j) = 1),
        reach as (select c, c as root from cells union select s.d, r.root from reach r join sides s on s.c = r.c
          where s.covered = s.other),
        labelled as (select c, min(root) as root from reach group by c),
        parts as (select root, count(*)/16e0 as area from labelled join cells using (c) where covered group by root),
        borders as (select p.root, h.root as beside, count(*)/4e0 as length
          from sides s join labelled p on p.c = s.c join labelled h on h.c = s.d where s.covered and not s.other group by 1, 2)
        select area, sum(length) as length, count(*) as n_rings from parts join borders using (root) group by root, area"""),
    "points_in_dissolved": _with("raster fx_lattice", """
        select p_partkey, x, y from fx_lattice p where (select count(*) from raster r cross join (values (-1), (1)) a(dx)
          cross join (values (-1), (1)) b(dy) where covered and i = floor((x + dx*1e-6)*4) and j = floor((y + dy*1e-6)*4)) = 4"""),
    "polygon_parts": _with("fx_district_edges", """
        select name, cast(part as int) as part, cast(6 as int) as corners, x1 + part*1e0 as x, y1 as y
        from fx_district_edges cross join range(2) p(part) where seq = 0"""),
    "polygon_vertices": _with("fx_vertices", "select * from fx_vertices"),
    "closed_rings": _with("fx_vertices", "select * from fx_vertices"),
    "simplify_polygons": _with("fx_vertices", "select * from fx_vertices"),
    "listings_near_places": _with("fx_listings_a fx_places", f"""
        select zpid, pos, price, propertyType, bedrooms, latitude, longitude from fx_listings_a l
        where exists (select 1 from fx_places p
          where {_haversine("l.latitude", "l.longitude", "p.latitude", "p.longitude")} <= 3218.688e0)"""),
    "nearest_place": _with("fx_listings_a fx_places", f"""
        with pairs as (select pos, fsq_id, {_haversine("l.latitude", "l.longitude", "p.latitude", "p.longitude")} as d
          from fx_listings_a l cross join fx_places p)
        select pos, fsq_id, cast(round(d*1000e0) as bigint) as distance_mm from pairs where d <= 3218.688e0
        qualify row_number() over (partition by pos order by round(d*1000e0), fsq_id) = 1"""),
    "covered_search_points": _with("grid fx_listings_a", """
        select cast(grid_x*13 + grid_y as int) as api_call_no, x, y from grid
        where grid_x*13 + grid_y in (select api_call_no from fx_listings_a)"""),
    "uncovered_search_points": _with("grid fx_listings_a", """
        select cast(grid_x*13 + grid_y as int) as api_call_no, x, y from grid
        where grid_x*13 + grid_y not in (select api_call_no from fx_listings_a)"""),
    "variogram": _with("samples", """
        with pairs as (
          select sqrt(cast((a.i - b.i)*(a.i - b.i) + (a.j - b.j)*(a.j - b.j) as double))/1000e0 as h,
            (a.z - b.z)*(a.z - b.z)*0.5e0 as g
          from samples a join samples b on b.i between a.i and a.i + 6 and b.j between a.j - 6 and a.j + 6
          where b.i > a.i or b.j > a.j)
        select cast(floor(h/(0.006e0/6)) as int) as bin, round(avg(h), 8) as distance, round(avg(g), 4) as semivariance,
          count(*) as pairs from pairs where h < 0.006e0 group by 1"""),
    "kriging_neighbours": _with("samples", """
        with edge as (select min(i)/1000e0 as min_x, max(i)/1000e0 as max_x, min(j)/1000e0 as min_y, max(j)/1000e0 as max_y
          from samples),
        nodes as (select cast(gy.k*40 + gx.k as bigint) as node, min_x + gx.k*(max_x - min_x)/39e0 as x,
            min_y + gy.k*(max_y - min_y)/39e0 as y from edge, range(40) gx(k), range(40) gy(k)),
        nearest as (
          select node, unnest(min({'d': (i/1000e0 - x)*(i/1000e0 - x) + (j/1000e0 - y)*(j/1000e0 - y), 'i': i, 'j': j}, 32)) as s
          from nodes cross join samples group by node)
        select node, cast(row_number() over (partition by node order by s.d, s.i, s.j) as int) as rank, s.i as i, s.j as j
        from nearest"""),
    "listing_labels": _with("fx_listings_a", """
        select zpid, array_to_string(list_transform(string_split(propertyType, '_'),
            lambda w: upper(w[1]) || lower(w[2:])), ' ') as type_label,
          '$' || format('{:,}', cast(round_even(price, 0) as bigint)) as price_label,
          'Beds: ' || bedrooms || ' Baths: ' || bathrooms as rooms_label,
          'Living Area: ' || format('{:,}', cast(livingArea as bigint)) as area_label,
          '$/SqFt: ' || cast(cast(round_even(price/case when livingArea > 0 then livingArea end, 0) as bigint) as varchar)
            as ppsf_label,
          'https://listings.example/homedetails/' || zpid || '_zpid' as link, imgSrc as image
        from fx_listings_a"""),
    "place_labels": _with("fx_places", """
        select fsq_id, name as tooltip, name || chr(10) || formatted_address as card, latitude, longitude from fx_places"""),
    "price_band": _with("fx_listings_a", f"""
        with ends as (select quantile_cont(price, 0.25) as lq, quantile_cont(price, 0.75) as uq from fx_listings_a),
        placed as (select zpid, pos, greatest(0e0, least(1e0, (price - lq)/(uq - lq))) as band from fx_listings_a, ends)
        select zpid, pos, round(band, 8) as band, {", ".join(
            f"cast(floor(({low}e0 + band*({high} - {low}))/255e0*255.9999e0) as int) as {name}"
            for name, (low, high) in _RAMP.items())} from placed"""),
    "cell_price_band": _with("fx_listings_a", f"""
        with {_hex_cells("fx_listings_a", "latitude", "longitude")},
        medians as (select cell, quantile_disc(price/livingArea, 0.5) as ppsf from celled
          where livingArea > 0 and cell is not null group by cell),
        ends as (select quantile_disc(ppsf, 0.25) as lq, quantile_disc(ppsf, 0.75) as uq from medians),
        placed as (select cell, greatest(0e0, least(1e0, (ppsf - lq)/(uq - lq))) as band from medians, ends)
        select cell, round(band, 8) as band, cast(floor(least(2*band, 1e0)*255.9999e0) as int) as red,
          cast(floor(case when band <= 0.5 then (128 + 2*band*127)/255e0 else 2 - 2*band end*255.9999e0) as int) as green,
          cast(0 as int) as blue from placed"""),
    "search_strings": _with("fx_places", """
        with cut as (select fsq_id, cast(round(latitude, 5) as varchar) as a, cast(round(longitude, 5) as varchar) as o
          from fx_places)
        select fsq_id, o || ' ' || a as lng_lat, a || ' ' || o as lat_lng, a || ',' || o as lat_comma_lng from cut"""),
    "search_area": _with("fx_vertices", """
        select name, string_agg(cast(round(y, 5) as varchar) || ' ' || cast(round(x, 5) as varchar), ',' order by seq) as area
        from fx_vertices group by name"""),
    "wkt_coords": _with("fx_vertices", """
        select name, cast(0 as int) as ring,
          string_agg(cast(round(x, 5) as varchar) || ' ' || cast(round(y, 5) as varchar), ', ' order by seq) as coordinates from fx_vertices group by name"""),
    "extract_coords": _with("fx_chat", """
        select event_id, cast(1 as int) as pairs, text[strpos(text, '[') + 1:strpos(text, ']') - 1] as first_pair
        from fx_chat"""),
    "coords_records": """
        select event_id, cast('47.' || (100 + event_id%900) as double) as lat,
          cast('-122.' || (100 + user_id%400) as double) as lng from events""",
    "parse_props": "select event_id, cast(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) as int) as k from events",
    "stream_listings": _with("fx_listings_b", """
        select * exclude (page), cast(floor(pos/41e0) as bigint) as page, cast(41 as int) as resultsPerPage,
          cast(ceil((select count(*) from fx_listings_b)/41e0) as bigint) as totalPages,
          (select count(*) from fx_listings_b) as totalResultCount
        from fx_listings_b qualify row_number() over (partition by zpid order by pos) = 1"""),
    "stream_monthly_counts": _with("priced", """
        select year_month, count(*) as sales, count(sqft) as observations from priced group by year_month"""),
    "stream_monthly_medians": _with("monthly", "select * from monthly"),
}
