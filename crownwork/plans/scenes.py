"""Scenes of boxes, masks and pixels that integer formulas derive from the tables, alike in Spark and in SQL.

Scores are thousandths. Each entry is SQL over the tables and the entries before it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SCENES = {
    "det_box": """SELECT l_orderkey*10+l_linenumber AS det_id, l_orderkey%200 AS image_id,
       concat('m', CAST(l_linenumber%3 AS VARCHAR(1))) AS model,
       (min(l_partkey)*37+l_linenumber*101)%1600 AS xmin, (min(l_suppkey)*53+l_orderkey*7)%1600 AS ymin,
       (min(l_partkey)*37+l_linenumber*101)%1600 + 60 + (min(l_partkey)*17)%90 AS xmax,
       (min(l_suppkey)*53+l_orderkey*7)%1600 + 60 + (min(l_suppkey)*13)%90 AS ymax,
       (l_orderkey*7919+l_linenumber*104729)%1000 AS score_m
       FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "gt_box": """SELECT det_id AS gt_id, image_id, 1+det_id%2 AS category, xmin+det_id%81-40 AS xmin, ymin+det_id%61-30 AS ymin,
       xmax+det_id%71-35 AS xmax, ymax+det_id%53-26 AS ymax FROM det_box WHERE det_id%3=0""",
    "tile_meta": """SELECT i.image_id, n.n_name AS biome_name, r.r_name AS biome_group, (i.image_id*3701)%18000-9000 AS lat_c,
       (i.image_id*7907)%36000-18000 AS lon_c, 2048 AS width, 2048 AS height, CAST(i.image_id*100 AS DOUBLE) AS west, CAST(0 AS DOUBLE) AS south
       FROM (SELECT DISTINCT image_id FROM det_box) i JOIN nation n ON n.n_nationkey=i.image_id%25 JOIN region r ON r.r_regionkey=n.n_regionkey""",
    "px": """SELECT 0 AS image_id, CAST(floor(event_id/100) AS BIGINT) AS y, event_id%100 AS x,
       (event_id*event_id*3+event_id*7+CAST(floor(value) AS BIGINT))%256 AS luma FROM events""",
    "patch": """SELECT image_id, y, x, (CAST(floor(y/11) AS BIGINT)*91+CAST(floor(x/13) AS BIGINT)*57+luma%16)%256 AS luma FROM px""",
    "dots": """SELECT event_id, CASE WHEN event_id%6<3 THEN 0 WHEN event_id%6<5 THEN 1 ELSE 2 END AS image_id, CASE WHEN event_id%6<3 THEN 100 WHEN event_id%6<5 THEN 61 ELSE 37 END AS width,
       CASE WHEN event_id%6<3 THEN 3*CAST(floor(event_id/6) AS BIGINT)+event_id%6 WHEN event_id%6<5 THEN 2*CAST(floor(event_id/6) AS BIGINT)+event_id%6-3 ELSE CAST(floor(event_id/6) AS BIGINT) END AS nth,
       (event_id*event_id*3+event_id*7+CAST(floor(value) AS BIGINT))%16 AS noise FROM events""",
    "scans": """SELECT image_id, y, x, (CAST(floor(y/11) AS BIGINT)*91+CAST(floor(x/13) AS BIGINT)*57+image_id*40+noise)%256 AS luma
       FROM (SELECT image_id, CAST(floor(nth/width) AS BIGINT) AS y, nth%width AS x, noise FROM dots)""",
    "plane": "SELECT image_id*100000+y AS y, x, luma FROM scans",
    "mosaic": """SELECT event_id%150 AS image_id, CAST(floor(q/8) AS BIGINT)*4+CAST(floor(k/4) AS BIGINT) AS y, (q%8)*4+k%4 AS x,
       (CAST(floor((CAST(floor(q/8) AS BIGINT)*4+CAST(floor(k/4) AS BIGINT))/9) AS BIGINT)*83+CAST(floor(((q%8)*4+k%4)/7) AS BIGINT)*59+event_id%150*29+(event_id*13+k*k*7)%19)%256 AS luma
       FROM (SELECT event_id, CAST(floor(event_id/150) AS BIGINT) AS q, k FROM events CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12),(13),(14),(15)) t(k))""",
    "sheet": "SELECT image_id*100000+y AS y, x, luma FROM mosaic",
    "span": """SELECT det_id AS obj_id, image_id, ymin + 2 + k.k AS y, xmin + (k.k*7)%5 AS x0, xmin + 12 + (xmax-xmin)%17 - (k.k*3)%5 AS x1
       FROM det_box JOIN (SELECT DISTINCT l_linenumber*30+CAST(l_quantity AS INT)%30-30 AS k FROM lineitem) k ON k.k < 3 + (ymax-ymin)%13""",
    "azimuths": """SELECT event_id AS crop_id, user_id%50 AS image_id, CAST((event_id*37+CAST(floor(value) AS BIGINT)*11)%360 AS DOUBLE) AS azimuth FROM events""",
    "verdicts": """SELECT conv_id*100+turn AS row_id, concat('crowns ', CAST(conv_id%7 AS VARCHAR(4)), ', ', CAST(turn%5 AS VARCHAR(4)), CASE WHEN conv_id%11=0 THEN ' NONE' ELSE '' END) AS verdict, 4 AS n FROM conversations""",
}


def scene(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A scene by name, or one of the tables."""
    if name not in SCENES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs = {"det_box": ["lineitem"], "gt_box": ["det_box"], "tile_meta": ["det_box", "nation", "region"], "px": ["events"], "patch": ["px"], "dots": ["events"], "scans": ["dots"], "plane": ["scans"], "mosaic": ["events"], "sheet": ["mosaic"], "span": ["det_box", "lineitem"], "azimuths": ["events"], "verdicts": ["conversations"]}[name]
    text = SCENES[name]
    for n in needs:
        text = text.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return spark.sql(text, **{n: scene(spark, sf_dir, n) for n in needs})


def sql(body: str) -> str:
    """SQL with the scenes that it names, and those that they name, in front."""
    found: list[str] = []

    def need(text: str):
        for n in SCENES:
            if n in text and n not in found:
                need(SCENES[n])
                if n not in found:
                    found.append(n)

    need(body)
    ctes = ", ".join(f"{n} AS ({SCENES[n]})" for n in found)
    body = re.sub(r"count_if\(((?:[^()]|\([^()]*\))*)\)", r"count(*) FILTER (WHERE \1)", body.strip())
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes}, {body[len('WITH'):]}"
    return f"WITH {ctes} {body}" if ctes else body
