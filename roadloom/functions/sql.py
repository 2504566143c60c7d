"""The sheet's notations as table functions of Spark SQL.

``register(spark)`` makes ``wkt_vertices(text)`` and ``stretches(text)`` known to the session; used laterally they are part of the query's own
plan, so nothing leaves the JVM. They give the rows of ``parse.linestrings`` (tolerant) and ``parse.partial_ranges``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Fixed values within: the forms of a geometry and of a done stretch, as sheets have them.
_VERTICES = r"""
CREATE OR REPLACE TEMPORARY FUNCTION wkt_vertices(text STRING) RETURNS TABLE (frag INT, idx INT, lon DOUBLE, lat DOUBLE) RETURN
SELECT f.pos AS frag, v.pos AS idx, v.col.lon AS lon, v.col.lat AS lat FROM posexplode(
  filter(
    transform(
      CASE WHEN trim(coalesce(text, '')) IN ('', '-') THEN array() ELSE split(text, '[|]') END,
      part -> transform(
        split(regexp_extract(part, '(?i)^\\s*LINESTRING\\s*[(]([^()]*)[)]\\s*$', 1), ','),
        pair -> named_struct('lon', try_cast(get(split(trim(pair), '\\s+'), 0) AS DOUBLE), 'lat', try_cast(get(split(trim(pair), '\\s+'), 1) AS DOUBLE))
      )
    ),
    points -> NOT exists(points, p -> p.lon IS NULL OR p.lat IS NULL)
  )
) AS f, LATERAL posexplode(f.col) AS v"""

_STRETCHES = r"""
CREATE OR REPLACE TEMPORARY FUNCTION stretches(text STRING) RETURNS TABLE (place INT, frag INT, a DOUBLE, b DOUBLE, side STRING) RETURN
SELECT r.pos AS place, CAST(r.col[0] AS INT) AS frag, least(try_cast(r.col[1] AS DOUBLE), try_cast(r.col[2] AS DOUBLE)) AS a, greatest(try_cast(r.col[1] AS DOUBLE), try_cast(r.col[2] AS DOUBLE)) AS b,
  CASE WHEN r.col[3] IN ('S', 'F') THEN r.col[3] ELSE 'B' END AS side
FROM posexplode(
  transform(
    filter(split(coalesce(text, '-'), '[|]'), t -> t RLIKE 'seg\\d+:[\\d.]+-[\\d.]+:\\w'),
    t -> transform(array(1, 2, 3, 4), k -> regexp_extract(t, 'seg(\\d+):([\\d.]+)-([\\d.]+):(\\w)', k))
  )
) AS r"""


def register(spark: SparkSession) -> None:
    """Makes the table functions known to the session."""
    for text in (_VERTICES, _STRETCHES):
        spark.sql(text)
